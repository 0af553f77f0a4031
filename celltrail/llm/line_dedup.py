"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, the columns `carried`, n_lines, n_dropped, kept_text.

    Keys of at least min_chars code points that are in at least min_docs distinct doc_ids lose all lines except in
    the largest doc_id. Null or empty text is one empty line and is kept as an empty text; a repeated row
    counts as the same document and is treated like it; rows with a null doc_id keep all lines and are not counted. An
    empty table gives an empty result; columns not named are left out. Keys are compared by 128 bits of their SHA-256. A
    row is found again by two hashes of its doc_id and text, so only positions of lines meet it, not the lines.
    """
    columns = ["doc_id", *carried]
    row = [F.xxhash64("doc_id", "text").alias("ra"), F.xxhash64(F.lit(7), "text", "doc_id").alias("rb")]
    rows = docs.select(*columns, "text", *row)
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    places = (
        rows.where("doc_id is not null and text is not null")
        .select("doc_id", "ra", "rb", F.posexplode(lines_of("text")).alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars).select("doc_id", "ra", "rb", "pos", key.alias("k"))
        .where(F.length("k") >= min_chars).select("doc_id", "ra", "rb", "pos", F.unhex(F.substring(F.sha2("k", 256), 1, 32)).alias("h"))
    )
    places = stored(places)
    # distinct and counts are reduced before each shuffle; both sides of the next join are written tables, so a key that
    # holds many documents is split by the adaptive skew join
    frequent = places.select("h", "doc_id").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    frequent = stored(frequent.where(F.col("n") >= min_docs).select("h", "keeper"))
    # the positions to drop, as bits of 64 lines each
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))
    words = (
        places.join(frequent, "h").where("doc_id <> keeper").groupBy("ra", "rb", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
        .groupBy("ra", "rb").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("last"), F.sum(F.bit_count("bits")).alias("n_dropped"))
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
    drops = words.select("ra", "rb", "n_dropped", dense.alias("drops"))
    stays = lambda line, i: F.getbit(F.coalesce(F.get("drops", F.shiftright(i, 6)), F.lit(0).cast("long")), i.bitwiseAND(F.lit(63))) == 0
    kept = F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")
    return rows.join(drops, ["ra", "rb"], "left").select(
        *columns, F.size(lines_of("text")).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see line_dedup for nulls, empty texts, repeated rows and ties."""
    out = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEPT_SQL = f"""
lines as (select d.doc_id, p as pos, ls[p] as line, translate({_STRIP.format('ls[p]')}, '{_UP}', '{_LOW}') as k
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from {{docs}}) d, unnest(range(1, len(ls) + 1)) u(p)),
freq as (select k, max(doc_id) as keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
kept as (select l.doc_id, count(*) as n_lines,
    cast(count(*) filter (f.k is not null and l.doc_id <> f.keeper) as bigint) as n_dropped,
    coalesce(string_agg(l.line, chr(10) order by l.pos) filter (f.k is null or l.doc_id = f.keeper), '') as kept_text
  from lines l left join freq f on l.k = f.k group by l.doc_id)"""
SQL = f"with {KEPT_SQL.format(docs='documents')} select doc_id, n_lines, n_dropped, sha256(kept_text) as kept_sha256 from kept"
