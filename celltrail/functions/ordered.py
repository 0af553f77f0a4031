"""Order-dependent passes over each key's sorted rows, in batches, with only the state of the current key held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_sorted(df: DataFrame, key: str, order: list[str], fold: Callable, schema: str) -> DataFrame:
    """Rows of df dealt by `key` and sorted by `order` within it, passed to `fold`, which gives rows of `schema`.

    fold takes an iterator of rows (tuples in df's column order) of one partition and yields tuples; a key's rows
    follow one another. One shuffle; no key's rows are gathered, so a key may have any number of rows.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for row in fold(rows()):
            out.append(row)
            if len(out) == 8192:
                target = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                yield target
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
