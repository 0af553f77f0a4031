"""Evaluation: stratified folds, variance filter, Brier score and F1 report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Each class is dealt round in the order of a seeded hash, so class counts differ by at most one."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1) % folds).cast("int"))


def variances(rows: DataFrame, columns: list[str], threshold: float = 1e-5) -> DataFrame:
    """One row per column: population variance, and whether it is over the threshold."""
    one = rows.agg(*[F.var_pop(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns]))
    return one.select(pairs.alias("x")).select("x.feature", F.round("x.variance", 4).alias("variance"), (F.col("x.variance") > threshold).alias("kept"))


def f1_report(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class in the truth or the guesses; undefined ones are 0."""
    n = pairs.groupBy(truth, guess).agg(F.count("*").alias("n"))
    both = F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd")),
        F.struct(F.col(guess).alias("class"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd")),
    ))
    tp = F.when((F.col("prd") > 0) & (F.col(truth) == F.col(guess)), F.col("n")).otherwise(0)
    c = n.select(truth, guess, "n", both.alias("x")).select(truth, guess, "n", "x.*").groupBy("class").agg(F.sum("sup").alias("support"), F.sum("prd").alias("predicted"), F.sum(tp).alias("tp"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    t, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return c.select("class", ratio(t, p).alias("precision"), ratio(t, s).alias("recall"), ratio(2 * t, s + p).alias("f1"), "support")


def brier(rows: DataFrame, probabilities: str, label_index: str) -> DataFrame:
    hot = F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - (i == F.col(label_index)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    return rows.agg(F.round(F.avg(hot), 6).alias("brier"))


def f1_scores(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """macro_f1, over the classes of the truth or the guesses, and weighted_f1, by their support, of f1_report()."""
    r = f1_report(pairs, truth, guess)
    return r.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))
