"""Benchmark decontamination by winnowing: fingerprints of both sides are joined, then hits are extended."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored, table
from .filters import bloom
from .spans import GOLD, LOWER, hashes, mix, slices, small_batches, spaced, texts, words

#: Fixed value, on bytes of A-Z lower-cased UTF-8: a word is a run of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): text i has the words first[i] : first[i + 1]. No hash is 0."""
    at, buf = spaced(offsets, data)
    buf = LOWER.take(buf)
    starts, ends, first = words(buf, at, IS_WORD)
    h = hashes(buf, starts, ends - starts)
    h[h == 0] = 1
    return h, first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of k words from each place that has so many behind it, without regard to where texts end."""
    with np.errstate(over="ignore"):
        out = np.full(max(len(h) - k + 1, 0), k, dtype=np.uint64)
        for i in range(k if len(out) else 0):
            out = mix(out * GOLD + h[i : i + len(out)])
    return out


def winnow(g: np.ndarray, room: np.ndarray, k: int, span: int) -> np.ndarray:
    """Places of the least fingerprint, the rightmost among equals, of each window of `span` words; room: words up to the text's end."""
    n = len(g) - (span - k)
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span - k + 1):
        less = g[j : j + n] <= best
        best[less], at[less] = g[j : j + n][less], j
    inside = room[:n] >= span
    chosen = np.zeros(len(g), bool)
    chosen[(at + np.arange(n))[inside]] = True
    return np.flatnonzero(chosen)


def around(h: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray, before: int, behind: int) -> np.ndarray:
    """The word hashes from `before` words before each place to `behind` words behind, 0 beyond its text."""
    at = p[:, None] + np.arange(-before, behind)
    out = h[np.clip(at, 0, max(len(h) - 1, 0))]
    out[(at < first[:, None]) | (at >= last[:, None])] = 0
    return out


class Prints:
    """Fingerprints of texts: winnowed k-grams of those with `span` words or more, whole ones for the lengths in `short`."""

    def __init__(self, span: int, k: int, short: list[int] | None = None):
        self.span, self.k, self.short = span, k, short

    def __call__(self, offsets: np.ndarray, data: np.ndarray, allowed=None) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """How many words each text has, and arrays (kind, text, place in it, fingerprint, words around) of each kind. allowed: a filter."""
        h, first = word_hashes(offsets, data)
        count = np.diff(first)
        text = np.repeat(np.arange(len(count)), count)
        room = first[1:][text] - np.arange(len(h))
        before, behind, out = self.span - self.k, self.span, []

        def add(kind: int, p: np.ndarray, prints: np.ndarray) -> None:
            if allowed is not None:
                ok = allowed(prints)
                p, prints = p[ok], prints[ok]
            lo, hi = first[:-1][text[p]], first[1:][text[p]]
            if kind:
                lo, hi = p, p + kind
            out.append((kind, text[p], p - first[:-1][text[p]], prints, around(h, p, lo, hi, before, behind)))

        g = grams(h, self.k)
        p = winnow(g, room, self.k, self.span)
        add(0, p, g[p])
        for n in range(1, self.span) if self.short is None else self.short:
            g = grams(h, n)
            ok = (first[:-1][text[: len(g)]] == np.arange(len(g))) & (room[: len(g)] == n) if self.short is None else room[: len(g)] >= n
            p = np.flatnonzero(ok)
            add(n, p, g[p])
        return count, text, out


FOUND = "n_words long, hit_ranges array<struct<lo:long,hi:long>>, item_ids array<long>"


def joined(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _binary(x: np.ndarray) -> pa.Array:
    """Each row of x as a binary value."""
    size = x.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(x))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, the columns `carried`, n_words, hit_ranges, item_ids.

    Fingerprints are winnowed k-grams, so a span of `span` words that both sides have is found by one fingerprint at
    the same place of it on both. The two tables of fingerprints, with the words around each, are joined, and each match is
    extended over the words that agree; it counts from `span` words on. The words around a fingerprint cover every
    span that holds it, and words are compared by 64-bit hashes. An item of fewer words is one window, found by its own hash.
    Nothing of the benchmark is gathered but a Bloom filter of 8 MB at most, which keeps documents' other
    fingerprints out of the join. Null or empty texts have no words; every row gives a row, with equal values for equal
    texts, also where a doc_id is null or repeated; an item repeated, or null, adds nothing; empty tables work.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wide = (2 * span - k) * 8
    columns = ["doc_id", *carried]

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = texts(b.column("text"))
            for lo, hi in slices(offsets):
                for kind, text, _, prints, words_ in Prints(span, k)(offsets[lo : hi + 1], data)[2]:
                    ids = b.column("item_id").slice(lo, hi - lo).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(text), kind, np.int32)), pa.array(prints.view(np.int64)), _binary(words_)], names=["item_id", "kind", "print", "item_words"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    prints = stored(items.mapInArrow(of_items, "item_id long, kind int, print long, item_words binary").distinct())
    short = sorted(r.kind for r in prints.where("kind > 0").select("kind").distinct().collect())  # span - 1 at most
    known = spark.sparkContext.broadcast(bloom(prints, "print"))  # 8 MB at most

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = texts(b.column("text"))
            for lo, hi in slices(offsets):
                count, _, found = Prints(span, k, short)(offsets[lo : hi + 1], data, known.value.has)
                text = np.concatenate([f[1] for f in found])
                order = np.argsort(text, kind="stable")
                kinds = np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found])
                fields = [kinds[order], *(np.concatenate([f[i] for f in found])[order] for i in (2, 3))]
                arrays = [pa.array(fields[0]), pa.array(fields[1].astype(np.int64)), pa.array(fields[2].view(np.int64)), _binary(np.concatenate([f[4] for f in found])[order])]
                structs = pa.StructArray.from_arrays(arrays, names=["kind", "at", "print", "doc_words"])
                ends = np.searchsorted(text[order], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in ["row", *columns]), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), structs)],
                    names=["row", *columns, "n_words", "found"],
                )

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, wide // 8) for c in ("doc_words", "item_words"))
            same = (x == y) & (x != 0)
            left = np.cumprod(same[:, span - k - 1 :: -1] if span > k else same[:, :0], axis=1).sum(axis=1)
            right = np.cumprod(same[:, span - k :], axis=1).sum(axis=1)
            kind, at = b.column("kind").to_numpy(), b.column("at").to_numpy()
            ok = np.where(kind > 0, right == kind, left + right >= span)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(keep), pa.array((at - left)[ok]), pa.array((at + right)[ok]), b.column("item_id").take(keep)], names=["row", "lo", "hi", "item_id"]
            )

    source = docs.select(*dict.fromkeys([*columns, "text"])).withColumn("row", F.monotonically_increasing_id())
    found = "found array<struct<kind:int,at:long,print:long,doc_words:binary>>"
    schema = StructType([StructField("row", LongType()), *docs.select(*columns).schema, *StructType.fromDDL(f"n_words long, {found}")])
    scanned = stored(source.mapInArrow(of_docs, schema))  # once for the row numbers to stay
    marks = scanned.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
    hits = marks.join(prints, ["print", "kind"]).select("row", "kind", "at", "doc_words", "item_words", "item_id")
    hits = stored(hits.mapInArrow(extended, "row long, lo long, hi long, item_id long"))
    ranges = hits.select("row", "lo", "hi").distinct().groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("hit_ranges"))
    ids = hits.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            spans = [[{"lo": lo, "hi": hi} for lo, hi in joined((r["lo"], r["hi"]) for r in x)] for x in b.column("hit_ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, kind)], names=["row", "hit_ranges"])

    ranges = ranges.mapInArrow(merge, "row long, hit_ranges array<struct<lo:long,hi:long>>")
    hit = stored(ranges.join(ids, "row"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    free = scanned.where("size(found) = 0").withColumns({"hit_ranges": F.lit(None).cast("array<struct<lo:long,hi:long>>"), "item_ids": F.lit(None).cast("array<long>")})
    # only rows with a candidate meet the hits
    rows = free.drop("found").unionByName(scanned.where("size(found) > 0").drop("found").join(hit, "row", "left"))
    return rows.select(*columns, "n_words", none("hit_ranges", "array<struct<lo:long,hi:long>>"), none("item_ids", "array<long>"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; see decontaminate for nulls, empty texts and repeated rows."""
    return digest(decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
iw as (select distinct item_id, least(10, len(w)) as n, unnest([list_slice(w, p, p + least(10, len(w)) - 1) for p in range(1, len(w) - least(10, len(w)) + 2)]) as g from i where len(w) > 0),
ns as (select distinct n from iw),
dw as (select row, n, p, list_slice(w, p, p + n - 1) as g from (select row, w, n, unnest(range(1, cast(len(w) - n + 2 as bigint))) as p from d, ns where len(w) >= n)),
hit as (select distinct row, item_id, p, dw.n from dw join iw on dw.n = iw.n and dw.g = iw.g),
hw as (select row, count(distinct q) as n_hit from (select row, unnest(range(p, p + n)) as q from hit) group by row),
hi as (select row, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from (select distinct row, item_id from hit) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from d left join hw using (row) left join hi using (row)"""
