"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none: in local mode a folder of our own, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="celltrail-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, partition by partition."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared checkpoint folder and reads it from there; partitions and order may differ."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    if WRITTEN.get() is not None:
        WRITTEN.get().append(path)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stored_removed(spark: SparkSession) -> Iterator[None]:
    """At its end, removes the tables that stored() wrote inside; results must have been written by then."""
    mine: list[str] = []
    token = WRITTEN.set(mine)
    try:
        yield
    finally:
        WRITTEN.reset(token)
        sc = spark.sparkContext
        for path in mine:
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other code point."""
    return F.translate(c, UPPER, LOWER)
