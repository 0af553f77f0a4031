"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import stored, table
from .filters import bloom
from .spans import GOLD, LOWER, hashes, mix, slices, small_batches, spaced, texts, words



#: Fixed value: words are runs of [^\x20\x09-\x0D]+.
NO_SPACE = np.ones(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a sequence's k-word shingles; fewer words are one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mix(h * GOLD + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def superminhash(items: np.ndarray, m: int = 128, block: int = 4096) -> np.ndarray:
    """Each item deals rank j + r to a slot of its own random permutation, j = 0, 1, ...; a slot keeps the least.

    All items of a block take step j together; the steps stop once j exceeds the largest kept rank.
    """
    sig = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), block):
        x = items[at : at + block]
        perm, row = np.tile(np.arange(m, dtype=np.int16), (len(x), 1)), np.arange(len(x))
        for j in range(m):
            if j > int(sig.max() >> np.uint64(48)):
                break
            draw = mix(x + np.uint64(j + 1) * GOLD)
            k = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            slot = perm[row, k]
            perm[row, k] = perm[:, j]
            rank = (np.uint64(j) << np.uint64(48)) | (mix(draw) >> np.uint64(16))
            np.minimum.at(sig, slot, rank)
    return sig


def _words_of(b: pa.RecordBatch, rows: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, word hashes, first): some rows of a batch at a time; row from + i has the words first[i] : first[i + 1]."""
    offsets, data = texts(b.column("text"))
    for lo, hi in slices(offsets):
        if rows is not None and not rows[lo:hi].any():
            continue
        at, buf = spaced(offsets[lo : hi + 1], data)
        buf = LOWER.take(buf)
        starts, ends, first = words(buf, at, NO_SPACE)
        yield lo, hi, hashes(buf, starts, ends - starts), first


def _sketch(batches: Iterator[pa.RecordBatch], k: int, m: int, rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            for lo, hi, h, first in _words_of(b):
                n, sets, bands = [], [], []
                for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                    s = shingles(h[x:y], k)
                    n.append(len(s))
                    if not len(s):
                        sets.append(None)
                        bands.append(None)
                        continue
                    sig = superminhash(s, m).reshape(-1, rows)
                    band = np.arange(len(sig), dtype=np.uint64)
                    for c in range(rows):
                        band = mix(band * GOLD + sig[:, c])
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band.view(np.int64))
                made = [pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in columns), *made], names=[*columns, "n_shingles", "set_id", "bands"])


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, items): the sorted shingle hashes of the documents in `ids` (doc_id), made from their whole texts.

    A Bloom filter of the ids, 8 MB at most, picks the texts, so they are not shuffled; the few others that it
    lets through have no pair to be joined with. A text repeated under one doc_id gives one set.
    """
    known = docs.sparkSession.sparkContext.broadcast(bloom(ids.distinct().select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                mine = known.value.has(b.column("key").to_numpy())
                for lo, hi, h, first in _words_of(b, mine):
                    at = lo + np.flatnonzero(mine[lo:hi])
                    items = [shingles(h[first[i - lo] : first[i - lo + 1]], k).tobytes() for i in at.tolist()]
                    sids = [xxhash.xxh3_128_digest(x) for x in items]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(sids, pa.binary()), pa.array(items, pa.binary())], names=["rep", "sid", "items"])

    found = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "rep long, sid binary, items binary")
    return stored(found.dropDuplicates(["rep", "sid"]).drop("sid"))


def _linked(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets, in `found`, are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    x = found.select(F.col("rep").alias("a"), F.col("items").alias("ia"))
    y = found.select(F.col("rep").alias("b"), F.col("items").alias("ib"))
    return stored(pairs.join(x, "a").join(y, "b").where(similar("ia", "ib")).select("a", "b").distinct())


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def common_counts(found: DataFrame, slots: int = 64) -> DataFrame:
    """(rep, live, counts): how many of a set's items are in another set of `found` too, in all and by hash slot.

    An intersection has at most sum(min(counts_a, counts_b)) items, as an item in one set only is in none and
    equal items are in equal slots.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for rep, items in zip(x["rep"], x["items"]):
                yield pd.DataFrame({"h": np.frombuffer(items, np.int64), "rep": rep})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for rep, items, alone in zip(x["rep"], x["items"], x["alone"]):
                h = np.frombuffer(items, np.uint64)
                if alone is not None:
                    h = np.setdiff1d(h, np.asarray(alone, dtype=np.int64).view(np.uint64), assume_unique=True)
                out.append((rep, len(h), np.bincount((h % np.uint64(slots)).astype(np.int64), minlength=slots).astype(np.int32)))
            yield pd.DataFrame(out, columns=["rep", "live", "counts"])

    lone = found.mapInPandas(spread, "h long, rep long").groupBy("h").agg(F.count("*").alias("df"), F.min("rep").alias("rep"))
    alone = lone.where("df = 1").groupBy("rep").agg(F.collect_list("h").alias("alone"))
    return stored(found.join(alone, "rep", "left").mapInPandas(count, "rep long, live long, counts array<int>"))


def components(edges: DataFrame, nodes: DataFrame, salts: int = 16) -> DataFrame:
    """(v, c): the smallest node that each node of `nodes` (v) reaches; labels spread and jump until nothing changes.

    A hub's neighbours, and the members of a large component, are dealt over `salts` tasks.
    """
    salt, every = F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")
    both = stored(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct().select("v", "w", salt))
    labels = stored(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("c")))
    while True:
        told = labels.select(F.col("v").alias("w"), "c", every)
        heard = both.join(told, ["w", "s"]).groupBy("v").agg(F.min("c").alias("d"))
        near = stored(labels.join(heard, "v").select("v", F.least("c", "d").alias("e"), "c", salt))
        # only labels that are themselves relabelled jump
        jump = near.select("e").distinct().join(near.select(F.col("v").alias("e"), F.col("e").alias("f")), "e").where("e <> f")
        new = near.join(jump.select("e", "f", every), ["e", "s"], "left")
        new = stored(new.select("v", F.least("e", F.coalesce("f", "e")).alias("n"), "c"))
        labels = new.select("v", F.col("n").alias("c"))
        if new.where("n <> c").isEmpty():
            break
    return nodes.join(labels, "v", "left").select("v", F.coalesce("c", "v").alias("c"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept, and the string columns `carried`.

    Documents of equal shingle sets are one class, linked at once; only class representatives go on. Classes
    that share a band (4 equal slots of a 128-slot signature, 32 bands; a pair at 0.75 shares none with a
    chance of about 5e-6) are candidates, confirmed on full sets. First each document is compared with one
    band's centre; then, only where that leaves more than one component in a band, with the other centres, and
    at last members of different components with each other. Pairs inside one component cannot change the result
    and are not made. After the first step only those are confirmed that an upper bound of their common shingles
    allows: shingles of one candidate only are in no intersection, and the others are counted by hash slot. A
    document whose shared shingles cannot reach the similarity with any set is not paired at all. Null or empty text
    has no shingles and is its own component; an empty table gives an empty result. Equal rows get equal results. A
    doc_id repeated with different texts is not one node: each row has its own text's component, and only where the
    doc_id is the least of several sets are these linked. A null doc_id is kept, and has the component of its set.
    """
    m = bands * rows
    small_batches(docs.sparkSession, 1000)
    columns = ["doc_id", *carried]
    marked, docs = docs.select(*dict.fromkeys([*columns, "text"])), docs.select("doc_id", "text")
    made = StructType.fromDDL("n_shingles long, set_id binary, bands array<long>")
    sketched = stored(marked.mapInArrow(lambda bs: _sketch(bs, k, m, rows, columns), StructType([*marked.select(*columns).schema, *made])))
    # one row per distinct set: a group of copies is reduced before its rows meet
    classes = sketched.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes)
    members = sketched.select("doc_id", "n_shingles", "set_id", *carried)
    reps = (
        sketched.select(F.col("doc_id").alias("rep"), "set_id", F.col("n_shingles").alias("n"), "bands")
        .join(classes, ["rep", "set_id"], "left_semi").dropDuplicates(["rep", "set_id"])
    )
    band = stored(reps.select("rep", "n", F.explode("bands").alias("band")))
    shared = band.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    band = stored(band.join(stored(shared), "band"))
    # a document in the most populous bands is the likeliest middle of its group: it is their centre
    middle = band.groupBy("rep").agg((-F.sum("m")).alias("o"))
    band = stored(band.select("band", "rep", "n").join(stored(middle), "rep"))
    centre = band.groupBy("band").agg(F.min(F.struct("o", "rep", "n")).alias("s"))
    band = stored(band.select("band", "rep", "n").join(stored(centre), "band"))
    nodes = classes.select(F.col("rep").alias("v")).distinct()

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (band, rep, c) of the bands that hold several components."""
        several = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        return stored(rows.join(stored(several.select("band")), "band", "left_semi"))

    def side(x: DataFrame, n: str) -> DataFrame:
        return x.select(*(F.col(o).alias(t + n) for o, t in (("band", "band_"), ("rep", ""), ("n", "n"), ("c", "c"), ("live", "l"), ("counts", "k"))))

    def pairs_of(x: DataFrame, y: DataFrame, *others: Column) -> DataFrame:
        """Distinct (a, b), a < b, of rows in a band whose components differ and whose bounds allow a link."""
        reach = percent * (F.col("na") + F.col("nb"))
        most = F.aggregate(F.zip_with("ka", "kb", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
        allowed = F.when((100 + percent) * F.least("la", "lb") >= reach, (100 + percent) * most >= reach).otherwise(False)
        at = (F.col("band_a") == F.col("band_b")) & (F.col("ca") != F.col("cb")) & allowed
        for other in others:
            at = at & other
        return x.join(y, at).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # first every document with one centre, the least of those that fit its size
    first = band.where((F.col("rep") != F.col("s.rep")) & (100 * F.least("n", "s.n") >= percent * F.greatest("n", "s.n")))
    first = first.groupBy("rep", "n").agg(F.min("s").alias("s")).select("rep", F.col("s.rep").alias("m"))
    first = stored(first.select(F.least("rep", "m").alias("a"), F.greatest("rep", "m").alias("b")).distinct())
    edges, tried = _linked(first, _sets(ends(first), docs, k), percent), first
    comp = stored(components(edges, nodes))
    rows = mixed(band.select("band", "rep", "n", F.col("s.rep").alias("centre")).join(comp.withColumnRenamed("v", "rep"), "rep"))
    # what cannot reach the similarity with any other candidate leaves, and then bands with one component left
    found = _sets(rows.select(F.col("rep").alias("doc_id")), docs, k)
    able = common_counts(found).where(F.col("live") > 0)
    rows = mixed(rows.join(able, "rep").where(100 * F.col("live") >= percent * F.col("n")))
    for whole in (False, True):
        # in bands that still hold several components: all with the centre; then all members across components
        if whole:
            pairs = pairs_of(side(rows, "a"), side(rows, "b"), F.col("a") < F.col("b"))
        else:
            pairs = pairs_of(side(rows, "a"), side(rows.where("rep = centre"), "b"))
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        more = _linked(pairs, found, percent)
        edges, tried = edges.union(more), tried.union(pairs)
        if not more.isEmpty():
            comp = stored(components(edges, nodes))
            rows = rows if whole else mixed(rows.drop("c").join(comp.withColumnRenamed("v", "rep"), "rep"))
    by_set = classes.join(comp.withColumnRenamed("v", "rep"), "rep").select("set_id", "c")
    own = members.join(by_set, "set_id", "left")
    return own.select(
        "doc_id", "n_shingles", F.coalesce("c", "doc_id").cast(LongType()).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.lit(True)).alias("kept"),
        *carried,
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
g as materialized (select distinct doc_id, hash(array_to_string(list_slice(w, p, p + 4), ' ')) as h from (select doc_id, w, unnest(range(1, cast(greatest(len(w) - 4, 1) as bigint) + 1)) as p from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from g group by doc_id),
e as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.h = y.h and x.doc_id <> y.doc_id group by 1, 2) join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r(v, c) as (select doc_id, doc_id from n union select r.v, e.b from r join e on e.a = r.c),
m as (select v, min(c) as c from r group by v)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(c, doc_id) as component_id, doc_id = coalesce(c, doc_id) as kept from w left join n using (doc_id) left join m on m.v = doc_id"""
