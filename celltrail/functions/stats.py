"""Seven-number summaries, entropy, the 80 % share, and the 3 x 3 grid of week and day parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(v: str, prefix: str) -> list[Column]:
    """Mean, sample std, median, biased skewness and excess kurtosis, min, max; undefined ones are 0."""
    flat = F.min(v) == F.max(v)
    parts = {
        "mean": F.avg(v), "std": F.stddev_samp(v), "median": F.median(v), "skewness": F.when(flat, 0.0).otherwise(F.skewness(v)),
        "kurtosis": F.when(flat, 0.0).otherwise(F.kurtosis(v)), "min": F.min(v), "max": F.max(v),
    }
    return [F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 6).alias(f"{prefix}__{name}") for name, c in parts.items()]


def entropy(df: DataFrame, keys: list[str], count: str, name: str) -> DataFrame:
    """Natural-log entropy of `count` within keys; counts of 0 or less are left out."""
    w = Window.partitionBy(*keys)
    p = F.col(count) / F.sum(count).over(w)
    return df.where(F.col(count) > 0).withColumn("_p", p).groupBy(*keys).agg(F.round(F.abs(-F.sum(F.col("_p") * F.log("_p"))), 6).alias(name))


def pareto(df: DataFrame, keys: list[str], value: str, name: str, share: float = 0.8) -> DataFrame:
    """The least share of rows, largest first, that holds `share` of the total; 0 for a total of 0 or less.

    The total is added up in the order of the running sum, so that rounding does not depend on how the rows arrive.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumns({"_total": total, "_run": run})
    k = F.sum((F.col("_run") < share * F.col("_total")).cast("int")) + 1
    return marked.groupBy(*keys).agg(F.when(F.max("_total") > 0, k / F.count("*")).otherwise(0.0).alias(name))


def cells(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Each row once for each of its four cells: all week or its week part, all day or its day part."""
    week = F.array(F.lit("allweek"), F.when(F.weekday(ts) < 5, "weekday").otherwise("weekend"))
    day = F.array(F.lit("allday"), F.when((F.hour(ts) >= 7) & (F.hour(ts) < 19), "day").otherwise("night"))
    return df.withColumn("week", F.explode(week)).withColumn("day", F.explode(day))
