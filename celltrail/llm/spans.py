"""Array operations on the UTF-8 bytes of many texts at once, for Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

GOLD = np.uint64(0x9E3779B97F4A7C15)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PAD = b"\n" * 16


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Lets batches for Python workers end at `size` bytes (or one row), however long the rows are."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, nulls as empty; the bytes begin at the first offset."""
    binary = column.type in (pa.binary(), pa.large_binary())
    column = column.fill_null(b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + len]; 8 bytes or more must follow every span. Injective up to 8 bytes of one length."""
    eights = np.ndarray(max(len(data) - 7, 0), "<u8", data, 0, (1,))
    with np.errstate(over="ignore"):
        h = lens.astype(np.uint64) * GOLD
        live = np.flatnonzero(lens <= 4096)
        k = 0
        while len(live):
            rest = lens[live] - k
            h[live] = mix(h[live] ^ (eights[starts[live] + k] & KEEP[np.minimum(rest, 8)]))
            live, k = live[rest > 8], k + 8
        for i in np.flatnonzero(lens > 4096):
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lens[i]].data)
    return h


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of bytes that `is_word` has, where text i's runs are first[i] : first[i + 1].

    A byte that is none must stand between two texts.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word[data], [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line end after each, and padding behind the last."""
    out = b"\n".join(data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:]))
    n = np.diff(offsets) + 1
    return np.concatenate([[0], np.cumsum(n)]), np.frombuffer(out + PAD, np.uint8)


def gather(arena: np.ndarray, offs: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """arena[off : off + len] of all, one after another."""
    ends = np.cumsum(lens)
    return arena[np.repeat(offs - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
