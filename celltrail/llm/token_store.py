"""Token-id files: length-limited canonical Huffman blocks with bit-offset checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from .bpe import TOKENIZER, _ids, _mapped, codec, column, tokenizer_path
from .common import shared_folder, stored, stored_removed, table
from .spans import small_batches, texts

MAX_BITS, STEP, BLOCK = 16, 256, 262_144


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; more symbols raise the limit."""
    if len(counts) <= 1:
        return {s: 1 for s in counts}
    limit = max(limit, (len(counts) - 1).bit_length() + 1 if len(counts) > 1 << limit else 0)
    order = sorted(counts, key=lambda s: (counts[s], s))
    w = np.array([counts[s] for s in order], dtype=np.float64)
    # an item under len(w) is a leaf; packages are pairs of the previous list's neighbours
    lists, cur = [], (w, np.arange(len(w)))
    for _ in range(limit):
        lists.append(cur)
        n = len(cur[0]) // 2
        pack = cur[0][: 2 * n].reshape(n, 2).sum(axis=1)
        weight, kind = np.concatenate([w, pack]), np.concatenate([np.arange(len(w)), np.full(n, -1)])
        o = np.argsort(weight, kind="stable")
        cur = weight[o], kind[o]
    length, take = np.zeros(len(w), dtype=int), 2 * len(w) - 2
    for _, kind in reversed(lists):
        leaf = kind[:take]
        chosen = leaf[leaf >= 0]
        length[chosen] += 1
        take = 2 * int((leaf < 0).sum())
    return {s: int(x) for s, x in zip(order, length)}


class Code:
    """Canonical codes, by length and then symbol, of at most 25 bits; symbols are numbered in their order."""

    def __init__(self, symbols: np.ndarray, bits: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, self.length = symbols[order].astype(np.uint32), bits[order].astype(np.int64)
        self.top = int(max(self.length, default=1))
        rank = np.lexsort((self.symbols, self.length))
        room = np.int64(1) << (self.top - self.length[rank])  # of each code, in the decoding table
        at = np.cumsum(room) - room
        self.code = np.zeros(len(self.symbols), np.uint64)
        self.code[rank] = (at >> (self.top - self.length[rank])).astype(np.uint64)
        table = np.zeros(1 << self.top, np.int64)
        table[: int(room.sum())] = np.repeat(rank, room)
        self.symbol_at, self.bits_at = self.symbols[table], self.length[table]
        self.dense = None
        if len(self.symbols) and self.symbols[-1] < 1 << 22:
            self.dense = np.zeros(int(self.symbols[-1]) + 1, np.int32)
            self.dense[self.symbols] = np.arange(len(self.symbols))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, in words of 32, and the bit offset of every STEP-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        k = np.searchsorted(self.symbols, ids) if self.dense is None else self.dense[ids]
        n = self.length[k]
        ends = np.cumsum(n)
        starts = ends - n
        word = starts >> 5
        wide = self.code[k] << (64 - n - (starts & 31)).astype(np.uint64)  # over two words
        size = int(word[-1]) + 2
        # codes don't overlap, so sums of their parts set each bit once; 32 bits are exact in a float
        out = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=size)
        out[1:] += np.bincount(word, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)[: size - 1]
        return out.astype(np.uint64).astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)], starts[::STEP]

    def decode(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All stretches between two offsets go on together, one table lookup per id."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        fours = np.ndarray(len(raw) - 3, ">u4", raw, 0, (1,)).astype(np.uint32)
        out, at = np.zeros((STEP, len(offsets)), np.uint32), np.array(offsets, dtype=np.int64)
        last, mask, down = len(fours) - 1, np.uint32((1 << self.top) - 1), 32 - self.top
        for j in range(min(STEP, n)):
            word = fours[np.minimum(at >> 3, last)]
            k = (word >> (down - (at & 7)).astype(np.uint32)) & mask
            out[j] = self.symbol_at[k]
            at += self.bits_at[k]
        return out.T.reshape(-1)[:n]


def _tail(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _packed(counts: np.ndarray, ids: np.ndarray, end_id: int | None) -> list[pa.Array]:
    """narrow, ids: with the end id, in 16 bits each where all fit and else in 32."""
    ids, counts = _tail(ids, counts, end_id)
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    size = 2 if narrow else 4
    out = column(pa.binary(), size * np.concatenate([[0], np.cumsum(counts)]), ids.astype(f"<u{size}").view(np.uint8))
    return [pa.array(np.full(len(counts), narrow)), out]


NARROW = [("narrow", BooleanType()), ("ids", BinaryType())]


def pack(encoded: DataFrame, end_id: int | None = 2) -> DataFrame:
    """(doc_id, ids) -> doc_id, narrow, ids."""
    work = lambda o, d: _packed(np.diff(o) // 4, np.frombuffer(d[o[0] : o[-1]].tobytes(), "<u4"), end_id)
    return _mapped(encoded, ["doc_id"], "ids", NARROW, work)


def encode_packed(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int | None = 2) -> DataFrame:
    """bpe_encode() and pack() in one worker: (doc_id, text) -> doc_id, narrow, ids; null text has the end id only."""
    return _mapped(docs, ["doc_id"], "text", NARROW, lambda o, d: _packed(*codec(tokenizer_path(tokenizer)).encode(o, d), end_id))


def write_tokens(encoded: DataFrame, folder: str, end_id: int | None = None) -> None:
    """Writes rows (doc_id, ids), or those of encode_packed(), below `folder` in ascending doc_id order: `blocks`, `parts` and `code`.

    Ids, of any 32-bit value, are counted over all documents; the counts that the driver gets are one per vocabulary
    entry. Rows go into ranges of (doc_id, hash of the ids, row), so one doc_id's many rows are spread too, nulls first.
    A block takes whole documents until it has 262,144 ids, so only a longer document makes a longer block; it is
    decoded on its own, and from any checkpoint inside it. `parts` has the number of ids before each range, `blocks` the
    number before each block in its range. Null ids are none; repeated rows are written each; no row, no block.
    """
    spark = encoded.sparkSession
    small_batches(spark)

    def each(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        offsets, data = texts(b.column("ids"))
        for i, narrow in enumerate(b.column("narrow").to_pylist()):
            yield i, np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), "<u2" if narrow else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, large = np.zeros(1 << 16, np.int64), {}
        for b in batches:
            got = [x for _, x in each(b)]
            ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
            total += np.bincount(ids[ids < 1 << 16], minlength=1 << 16)
            for i, n in zip(*(x.tolist() for x in np.unique(ids[ids >= 1 << 16], return_counts=True))):
                large[i] = large.get(i, 0) + n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *large]), pa.array([*total[ids].tolist(), *large.values()])], names=["id", "n"])

    if "narrow" not in encoded.columns:
        encoded = pack(encoded, end_id)
    rows = stored(encoded.select("doc_id", "narrow", "ids").withColumn("row", F.monotonically_increasing_id()))  # encoded once, though counted, sampled for the ranges and packed
    counts = {r.id: r.n for r in rows.select("narrow", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    lengths = code_lengths(counts)
    spark.createDataFrame([(s, n) for s, n in lengths.items()], "id long, bits int").coalesce(1).write.parquet(f"{folder}/code")
    code = np.array(list(lengths), np.int64), np.array(list(lengths.values()), np.int64)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()), ("offsets", pa.list_(pa.int64()))])
        coder, part, at, held, docs, size = Code(*code), None, 0, [], [], 0

        def full() -> pa.RecordBatch:
            nonlocal at, held, docs, size
            data, offsets = coder.encode(np.concatenate(held))
            row = [part, at, size, docs, [len(x) for x in held], data, offsets]
            at, held, docs, size = at + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, kind)], schema=kind)

        for b in batches:
            part = b.column("part")[0].as_py() if part is None and b.num_rows else part
            names = b.column("doc_id").to_pylist()
            for i, ids in each(b):
                held.append(ids)
                docs.append(names[i])
                size += len(ids)
                if size >= BLOCK:
                    yield full()
        if held:
            yield full()

    order = ["doc_id", F.xxhash64("ids"), "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt.select("doc_id", "narrow", "ids", "part").mapInArrow(
        block, "part int, start long, n_ids long, doc_ids array<long>, lengths array<long>, data binary, offsets array<long>"
    ).write.parquet(f"{folder}/blocks")
    sums = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a range
    before, parts = 0, []
    for r in sorted(sums, key=lambda r: r.part):
        parts.append((r.part, before))
        before += r.n
    spark.createDataFrame(parts, "part int, before long").coalesce(1).write.parquet(f"{folder}/parts")


@lru_cache(maxsize=2)
def _coder(symbols: tuple[int, ...], bits: tuple[int, ...]) -> Code:
    return Code(np.array(symbols, np.int64), np.array(bits, np.int64))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the number of ids before it), ids (little-endian unsigned 32-bit); each block decodes on its own."""
    code = spark.read.parquet(f"{folder}/code").collect()  # one row a vocabulary entry
    symbols, bits = tuple(r.id for r in code), tuple(r.bits for r in code)
    before = {r.part: r.before for r in spark.read.parquet(f"{folder}/parts").collect()}  # one row a range
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(symbols, bits) if symbols else None
        for b in batches:
            for i in range(b.num_rows):
                part, start, n, docs, lengths, data, offsets = (b.column(c)[i] for c in ("part", "start", "n_ids", "doc_ids", "lengths", "data", "offsets"))
                n, lengths = n.as_py(), lengths.values.to_numpy()
                ids = coder.decode(data.as_py(), offsets.values.to_numpy(), n) if n else np.zeros(0, np.uint32)
                starts = before[part.as_py()] + start.as_py() + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(starts), _ids(lengths, ids)], names=["doc_id", "start", "ids"])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(run, "doc_id long, start long, ids binary")


def store(spark: SparkSession, encoded: DataFrame, folder: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Writes to `folder` (default: a new one in the shared checkpoint folder) and reads back."""
    if folder is None:
        folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    with stored_removed(spark):
        write_tokens(encoded, folder, end_id)
    return read_tokens(spark, folder)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded, stored and read back; see write_tokens for nulls, ties and repeated rows."""
    encoded = encode_packed(table(spark, sf_dir, "documents", "doc_id", "text"))
    return store(spark, encoded).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
