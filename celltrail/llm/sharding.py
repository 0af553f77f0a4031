"""Sharding by proportional stratified interleaving; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 1024


def digits(bits: int, *parts) -> Column:
    """The first bits, a multiple of four, of an MD5 over the parts, as a number that is not negative; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, bits // 4), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to (doc_id, text, source).

    Rows are shuffled by a seeded hash within each source, given the fractional rank (rank + jitter) / n of their
    source, sorted by it, and cut into shards whose row counts differ by at most one (law `rows`). Null
    text has size 1 and the checksum of an empty text; null sources are a stratum; repeated rows each
    get a place; an empty table gives an empty result. Each ranking is done in 1,024 hash or rank ranges
    with counted offsets, so no task holds a whole source. The jitter, one per source, keeps many
    sources of few rows from meeting at one rank.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("u", digits(60, F.lit(str(seed)), "doc_id", "text_crc32", "size"))
    rows = rows.withColumn("b", F.shiftright("u", 50).cast("int"))  # the top 10 bits
    counts = rows.groupBy("source", "b").agg(F.count("*").alias("c"))
    by_source = Window.partitionBy("source")
    counts = counts.select(
        F.col("source").alias("s2"), F.col("b").alias("b2"),
        (F.sum("c").over(by_source.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
        F.sum("c").over(by_source).alias("n"),
    )
    u_order = [F.col("u"), F.col("doc_id"), F.col("text_crc32")]
    jitter = (digits(20, F.lit(str(seed)), F.lit("jitter"), "source") + 0.5) / (1 << 20)
    ranked = (
        rows.join(counts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
        .withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("source", "b").orderBy(*u_order)) - 1)
        .withColumn("f", (F.col("r") + jitter) / F.col("n"))
        .withColumn("g", F.least(F.floor(F.col("f") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "source", "u", "f", "g")
    )
    ranked = cut(ranked)
    everything = Window.orderBy("g")  # over at most 1,024 counts
    offsets = ranked.groupBy("g").agg(F.count("*").alias("c")).select(
        F.col("g"), (F.sum("c").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
        F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    place = F.col("before") + F.row_number().over(Window.partitionBy("g").orderBy("f", "source", *u_order)) - 1
    return (
        ranked.join(F.broadcast(offsets), "g")
        .withColumn("p", place)
        .withColumn("shard", F.expr(f"cast(((p + 1) * {shards} - 1) div total as int)"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            F.expr(f"p - (shard * total) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`; see interleave for nulls, repeated rows and ties."""
    return interleave(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


#: The CRC-32 table follows from its polynomial; the rest is the definition without ranges: two global rankings.
SQL = """
with t as (select list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
b as (select doc_id, source, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint)) as bytes from documents),
r as (select doc_id, source, size, xor(list_reduce(bytes, lambda c, b: xor(crc[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) as text_crc32 from b, t),
u as (select *, cast('0x' || md5(concat_ws('|', '17', doc_id, text_crc32, size))[1:15] as bigint) as u, (cast('0x' || md5(concat_ws('|', '17', 'jitter', source))[1:5] as bigint) + 0.5::double) / 1048576 as j from r),
f as (select *, (row_number() over (partition by source order by u, doc_id nulls first, text_crc32) - 1 + j) / count(*) over (partition by source) as f from u),
p as (select *, row_number() over (order by f, source nulls first, u, doc_id nulls first, text_crc32) - 1 as p, count(*) over () as n from f),
s as (select *, ((p + 1) * 16 - 1) // n as shard from p)
select doc_id, size, text_crc32, 'rows' as law, cast(shard as integer) as shard, cast(p - (shard * n) // 16 as bigint) as slot, cast(null as integer) as grown_shard from s"""
