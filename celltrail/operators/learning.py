"""Predicting demographics: assembling features, chaining targets, oversampling, boosted trees, calibration, evaluation, summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import cut
from . import graph, metrics

#: Targets in the order of prediction, each with the targets whose probabilities it gets, and the one that the simulation couples to another.
PARENTS = {
    "age_group": [], "gender": [], "education_level": ["age_group"], "occupation_category": ["age_group", "education_level"],
    "work_status": ["age_group", "occupation_category"], "income_bracket": ["education_level", "occupation_category"], "socio_demographic_class": ["education_level", "income_bracket"],
}
ARTIFACTS = {"work_status"}
VARIANTS = ["baseline", "baseline+mobility", "baseline+colocation", "baseline+social", "baseline+all_graphs"]
KEY = "phone_number"


def base_features(features: DataFrame, motifs: DataFrame | None = None) -> DataFrame:
    return features if motifs is None else features.join(motifs, KEY, "left")


def variant_features(base: DataFrame, graphs: DataFrame | None, variant: str) -> tuple[DataFrame, bool]:
    """The variant's columns, and whether the mobility graph is to be fitted in each fold."""
    prefixes = {"baseline+social": ["graph_social__"], "baseline+colocation": ["graph_colocation__"], "baseline+all_graphs": ["graph_social__", "graph_colocation__"]}.get(variant, [])
    if graphs is None or variant == "baseline":
        return base, False
    if prefixes:
        base = base.join(graphs.select(KEY, *(c for c in graphs.columns if c.startswith(tuple(prefixes)))), KEY, "left")
    return base, variant in ("baseline+mobility", "baseline+all_graphs")


def chain_features(features: DataFrame, predicted: dict[str, DataFrame], target: str) -> DataFrame:
    """Adds the probability columns of the target's parents that were predicted; rows without them are left out."""
    for parent in PARENTS.get(target, []):
        if parent in predicted:
            p = predicted[parent]
            features = features.join(p.select(KEY, *(c for c in p.columns if c.startswith(f"prob_{parent}__"))), KEY)
    return features


def encode_labels(rows: DataFrame, label: str, name: str = "y") -> DataFrame:
    """Adds the place of each label among all labels in alphabetic order, from 0; null labels get null."""
    kinds = rows.select(label).where(F.col(label).isNotNull()).distinct()
    return rows.join(kinds.withColumn(name, F.row_number().over(Window.orderBy(label)) - 1), label, "left")  # a row a class


def min_class_count(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("min_class_count"))


def smote(rows: DataFrame, seed: int = 42, k: int = 5) -> DataFrame:
    """(agent_id, x, y) with synthetic rows, of null id, until every class is as large as the largest.

    A synthetic row lies between a row of its class and one of that row's k nearest of the class. As many as are wanted are dealt evenly over the
    class's rows. If a class has one row only, nothing is added.
    """
    rows = rows.select("agent_id", "x", "y")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
    if not sizes or min(sizes.values()) <= 1:
        return rows
    most, k = max(sizes.values()), max(1, min(k, min(sizes.values()) - 1))
    out = [rows]
    for y, n in sizes.items():
        if n == most:
            continue
        mine = cut(rows.where(F.col("y") == y).select("agent_id", "x"))
        near = graph.nearest_rows(mine, mine, k).select(F.col("v").alias("agent_id"), "w").groupBy("agent_id").agg(F.sort_array(F.collect_list("w")).alias("near"))
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), "agent_id"), "agent_id")) - 1
        times = F.lit((most - n) // n) + F.when(F.col("place") < (most - n) % n, 1).otherwise(0)
        copies = mine.join(near, "agent_id").withColumn("place", place).withColumn("i", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
        u = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(seed + s), "agent_id", "i"), 11) / float(1 << 53)
        copies = copies.withColumn("w", F.element_at("near", (F.floor(u(1) * F.size("near")) + 1).cast("int"))).withColumn("t", u(2))
        made = copies.drop("agent_id").join(mine.select(F.col("agent_id").alias("w"), F.col("x").alias("other")), "w")
        made = made.select(F.lit(None).cast("long").alias("agent_id"), F.zip_with("x", "other", lambda a, b: a + F.col("t") * (b - a)).alias("x"), F.lit(y).alias("y"))
        out.append(made)
    return reduce(DataFrame.unionByName, out)


class Classifier:
    """Boosted trees, one against the rest for each class, with sigmoid calibration on rows held out of the training."""

    def __init__(self, iterations: int = 80, depth: int = 6, rate: float = 0.08, seed: int = 42):
        self.settings, self.seed = {"maxIter": iterations, "maxDepth": depth, "stepSize": rate, "seed": seed}, seed

    def fit(self, rows: DataFrame, n_classes: int) -> Classifier:
        """rows: (agent_id, x, y). About 15 % are kept for the calibration where that leaves ten on either side."""
        rows = cut(rows.select("agent_id", "x", "y"))
        kept = F.pmod(F.xxhash64(F.lit(self.seed), "agent_id"), F.lit(100)) < 15
        held, rest = rows.where(kept), rows.where(~kept)
        if min(held.count(), rest.count()) < 10:
            held = rest = rows
        train = cut(smote(rest, self.seed).select(array_to_vector("x").alias("features"), "y"))
        held = held.select(array_to_vector("x").alias("features"), "y")
        self.models, self.scales = [], []
        for y in range(n_classes if n_classes > 2 else 1):
            y = y if n_classes > 2 else 1
            with_label = lambda df, y=y: df.withColumn("label", (F.col("y") == y).cast("double"))
            model = GBTClassifier(**self.settings).fit(with_label(train))
            margin = lambda df, m=model: m.transform(df).withColumn("margin", F.slice(vector_to_array("rawPrediction"), 2, 1))
            marked = margin(with_label(held)).select(array_to_vector("margin").alias("margin"), "label")
            scale = None
            if marked.select("label").distinct().count() == 2:
                fitted = LogisticRegression(featuresCol="margin", regParam=1e-3).fit(marked)
                scale = float(fitted.coefficients[0]), float(fitted.intercept)
            self.models.append(model)
            self.scales.append(scale)
        self.n_classes = n_classes
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with plain and calibrated: arrays of a probability for each class, that come to 1."""
        out = rows.withColumn("features", array_to_vector("x"))
        for i, (model, scale) in enumerate(zip(self.models, self.scales)):
            out = model.transform(out)
            margin = F.element_at(vector_to_array("rawPrediction"), 2)
            out = out.withColumn(f"_u{i}", F.element_at(vector_to_array("probability"), 2))
            out = out.withColumn(f"_c{i}", 1 / (1 + F.exp(-(scale[0] * margin + scale[1]))) if scale else F.col(f"_u{i}")).drop("rawPrediction", "probability", "prediction")
        names = []
        for kind, name in (("u", "plain"), ("c", "calibrated")):
            p = [F.col(f"_{kind}{i}") for i in range(len(self.models))]
            p = [1 - p[0], p[0]] if self.n_classes == 2 else p
            total = reduce(lambda a, b: a + b, p)
            names.append(F.array(*(F.when(total > 0, x / total).otherwise(1.0 / len(p)) for x in p)).alias(name))
        return out.select(*rows.columns, *names)


def argmax(probabilities: str):
    """The first place, from 0, of the largest probability."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def to_matrix(rows: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """The columns as one array x, nulls as 0."""
    return rows.select("agent_id", *kept, F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns)).alias("x"))


def varying(rows: DataFrame, columns: list[str], threshold: float = 1e-5) -> list[str]:
    """Columns whose population variance over rows is above the threshold, in order."""
    kept = {r.feature for r in metrics.variances(rows.fillna(0), columns, threshold).where("kept").collect()}  # one row a column
    return [c for c in columns if c in kept]


def _prepared(train: DataFrame, others: DataFrame, dynamic: bool, target: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Training and other rows with the mobility graph fitted on the former, where asked for, and the columns that vary there."""
    if dynamic:
        knn = graph.MobilityKnn().fit(train)
        train = train.join(knn.transform(train, is_train=True), "agent_id")
        others = others.join(knn.transform(others), "agent_id")
    skip = {KEY, "agent_id", target, "y", "fold"}
    return train, others, varying(train, [c for c in train.columns if c not in skip])


def evaluate(features: DataFrame, people: DataFrame, target: str, predicted: dict[str, DataFrame] | None = None, folds: int = 5, seed: int = 42, dynamic: bool = False, **settings) -> tuple[dict, DataFrame]:
    """Cross-validation: the figures, and the out-of-fold calibrated probabilities by phone number.

    Each fold's graph, variance filter, oversampling, trees and calibration see its training rows only. Means and population stds are over folds.
    """
    rows = chain_features(features, predicted or {}, target).join(people.select(KEY, "agent_id", target).where(F.col(target).isNotNull()), KEY)
    rows = cut(metrics.stratified_folds(encode_labels(rows, target), KEY, "y", folds, seed))
    classes = [r[0] for r in rows.select(target).distinct().orderBy(target).collect()]  # one row a class
    parts, scores = [], []
    for fold in range(folds):
        train, test, columns = _prepared(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), dynamic, target)
        model = Classifier(seed=seed, **settings).fit(to_matrix(train, columns, "y"), len(classes))
        got = cut(model.predict(to_matrix(test, columns, KEY, "y")).select(KEY, "y", "plain", "calibrated"))
        parts.append(got)
        scores.append([metrics.f1_scores(got.withColumn("guess", argmax(p)), "y", "guess").first() for p in ("plain", "calibrated")])
    whole = reduce(DataFrame.unionByName, parts)
    value = lambda i, k, f: float(f([s[i][k] for s in scores]))
    brier = lambda p: metrics.brier(whole, p, "y").first()[0]
    figures = {
        "target": target, "uncal_macro_f1": value(0, "macro_f1", np.mean), "uncal_macro_f1_std": value(0, "macro_f1", np.std), "cal_macro_f1": value(1, "macro_f1", np.mean), "cal_macro_f1_std": value(1, "macro_f1", np.std),
        "uncal_weighted_f1": value(0, "weighted_f1", np.mean), "cal_weighted_f1": value(1, "weighted_f1", np.mean), "uncal_brier": brier("plain"), "cal_brier": brier("calibrated"), "is_known_artifact": target in ARTIFACTS,
    }
    named = whole.select(KEY, F.col("y"), argmax("calibrated").alias("guess"), *(F.col("calibrated")[i].alias(f"prob_{target}__{c}") for i, c in enumerate(classes)))
    at = F.array(*map(F.lit, classes))
    figures["report"] = report_text(metrics.f1_report(named.select(F.get(at, "y").alias("truth"), F.get(at, "guess").alias("guess")), "truth", "guess"))
    return figures, named.drop("y", "guess")


def final_predictions(features: DataFrame, people: DataFrame, targets: list[str] | None = None, seed: int = 42, dynamic: bool = False, **settings) -> DataFrame:
    """phone_number with the label and the class probabilities of each target, each fitted on all rows; chained ones get their parents' as fitted."""
    predicted: dict[str, DataFrame] = {}
    out = features.select(KEY)
    for target in targets or list(PARENTS):
        rows = chain_features(features, predicted, target).join(people.select(KEY, "agent_id", target), KEY)
        rows = cut(encode_labels(rows, target))
        known = rows.where("y is not null")
        classes = [r[0] for r in known.select(target).distinct().orderBy(target).collect()]  # one row a class
        if dynamic:
            rows = cut(rows.join(graph.MobilityKnn().fit(rows).transform(rows, is_train=True), "agent_id"))
            known = rows.where("y is not null")
        columns = varying(known, [c for c in rows.columns if c not in {KEY, "agent_id", target, "y"}])
        got = Classifier(seed=seed, **settings).fit(to_matrix(known, columns, "y"), len(classes)).predict(to_matrix(rows, columns, KEY))
        named = F.get(F.array(*map(F.lit, classes)), argmax("calibrated")).alias(f"predicted_{target}")
        predicted[target] = cut(got.select(KEY, named, *(F.col("calibrated")[i].alias(f"prob_{target}__{c}") for i, c in enumerate(classes))))
        out = out.join(predicted[target], KEY)
    return out


def experiments(base: DataFrame, graphs: DataFrame | None, people: DataFrame, seeds: tuple[int, ...] = (42, 123, 999), folds: int = 5, variants: list[str] | None = None, targets: list[str] | None = None, quick: bool = False, **settings) -> tuple[DataFrame, dict[str, str]]:
    """A record for each variant, seed and target, and the reports of the last variant at the first seed; quick: the first seed only."""
    records, reports, seeds = [], {}, seeds[:1] if quick else seeds
    for variant in variants or VARIANTS:
        features, dynamic = variant_features(base, graphs, variant)
        for seed in seeds:
            predicted: dict[str, DataFrame] = {}
            for target in targets or list(PARENTS):
                figures, predicted[target] = evaluate(features, people, target, predicted, folds, seed, dynamic, **settings)
                report = figures.pop("report")
                if variant == "baseline+all_graphs" and seed == seeds[0]:
                    reports[target] = report
                records.append({"variant": variant, "seed": seed, **{k: v for k, v in figures.items() if not k.endswith("_std")}})
    return base.sparkSession.createDataFrame(records), reports


def ablation_summary(records: DataFrame) -> DataFrame:
    """Over seeds: means, sample stds and the spread of each variant and target, rounded to four digits; undefined ones are 0."""
    v = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(name)
    return records.groupBy("variant", "target", "is_known_artifact").agg(
        v(F.avg("cal_macro_f1"), "cal_macro_f1_mean"), v(F.stddev_samp("cal_macro_f1"), "cal_macro_f1_std"), v(F.max("cal_macro_f1") - F.min("cal_macro_f1"), "cal_macro_f1_spread"),
        v(F.avg("uncal_macro_f1"), "uncal_macro_f1_mean"), v(F.stddev_samp("uncal_macro_f1"), "uncal_macro_f1_std"), v(F.avg("cal_brier"), "cal_brier_mean"), v(F.avg("uncal_brier"), "uncal_brier_mean"),
        v(F.avg("cal_weighted_f1"), "cal_weighted_f1_mean"),
    )


def results_summary(records: DataFrame) -> DataFrame:
    """The baseline beside all graphs for each target, with the differences."""
    def of(variant: str, prefix: str) -> DataFrame:
        return records.where(F.col("variant") == variant).groupBy("target").agg(
            F.avg("cal_macro_f1").alias(f"{prefix}_cal_macro_f1"), F.stddev_samp("cal_macro_f1").alias(f"{prefix}_cal_macro_f1_std"),
            F.avg("uncal_brier").alias(f"{prefix}_uncal_brier"), F.avg("cal_brier").alias(f"{prefix}_cal_brier"),
        )

    rows = of("baseline", "baseline").join(of("baseline+all_graphs", "all_graphs"), "target", "left")
    rows = rows.withColumns({
        "delta_f1_from_graphs": F.col("all_graphs_cal_macro_f1") - F.col("baseline_cal_macro_f1"), "brier_reduction_from_cal": F.col("all_graphs_uncal_brier") - F.col("all_graphs_cal_brier"),
    })
    figures = [c for c in rows.columns if c != "target"]
    return rows.select("target", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in figures), F.col("target").isin(*ARTIFACTS).alias("is_known_artifact"))


def report_text(report: DataFrame) -> str:
    """A report of metrics.f1_report() as text, one line a class."""
    rows = report.orderBy("class").collect()  # one row a class
    head = f"{'':>20} {'precision':>10} {'recall':>10} {'f1-score':>10} {'support':>10}"
    return "\n".join([head, *(f"{r['class']!s:>20} {r.precision:>10.2f} {r.recall:>10.2f} {r.f1:>10.2f} {r.support:>10}" for r in rows)])
