"""Social and co-location graphs as edge tables, with their topology."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import cut


def social_edges(comm: DataFrame, population: DataFrame) -> DataFrame:
    who = population.select("agent_id")
    return (
        comm.groupBy(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).agg(F.count("*").alias("weight"))
        .join(who.withColumnRenamed("agent_id", "src"), "src", "left_semi").join(who.withColumnRenamed("agent_id", "dst"), "dst", "left_semi")
        .select("src", "dst", "weight")
    )


def degree_strength(edges: DataFrame, population: DataFrame) -> DataFrame:
    end = F.explode(F.array(F.struct(F.col("src").alias("agent_id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("agent_id"), F.lit(0).alias("out"))))
    rows = edges.select(end.alias("e"), "weight").select("e.*", "weight")
    s = rows.groupBy("agent_id").agg(
        F.sum(1 - F.col("out")).alias("in_degree"), F.sum("out").alias("out_degree"), F.count("*").alias("total_degree"),
        F.sum((1 - F.col("out")) * F.col("weight")).alias("in_strength"), F.sum(F.col("out") * F.col("weight")).alias("out_strength"),
        F.sum("weight").alias("total_strength"),
    )
    return population.select("agent_id").join(s, "agent_id", "left").fillna(0)


def reciprocity(edges: DataFrame, population: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("mutual"))
    m = edges.join(back, ["src", "dst"], "left").groupBy(F.col("src").alias("agent_id")).agg(F.count("mutual").alias("m"))
    d = degree_strength(edges, population).select("agent_id", "total_degree")
    r = F.when(F.col("total_degree") > 0, 2 * F.coalesce("m", F.lit(0)) / F.col("total_degree")).otherwise(0.0)
    return d.join(m, "agent_id", "left").select("agent_id", F.round(r, 6).alias("reciprocity"))


def clustering(edges: DataFrame, population: DataFrame) -> DataFrame:
    """Undirected and unweighted; edges point to the end of larger (degree, id), so a hub has few out-edges."""
    und = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = und.select(F.explode(F.array("a", "b")).alias("agent_id")).groupBy("agent_id").agg(F.count("*").alias("d"))
    da, db = deg.select(F.col("agent_id").alias("a"), F.col("d").alias("da")), deg.select(F.col("agent_id").alias("b"), F.col("d").alias("db"))
    low = F.struct("da", "a") < F.struct("db", "b")
    o = und.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedge.join(und.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    t = closed.select(F.explode(F.array("u", "x", "y")).alias("agent_id")).groupBy("agent_id").agg(F.count("*").alias("t"))
    c = F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return population.select("agent_id").join(deg, "agent_id", "left").join(t, "agent_id", "left").select("agent_id", F.round(c, 6).alias("clustering"))


def neighbour_stats(edges: DataFrame, population: DataFrame, features: DataFrame, column: str) -> DataFrame:
    """Mean and population std of `column` over neighbours in either direction, without oneself."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    f = features.select(F.col("agent_id").alias("dst"), F.coalesce(column, F.lit(0)).alias("v"))
    s = both.join(f, "dst").groupBy(F.col("src").alias("agent_id")).agg(
        F.round(F.avg("v"), 6).alias(f"neighbor_mean_{column}"), F.round(F.stddev_pop("v"), 6).alias(f"neighbor_std_{column}")
    )
    return population.select("agent_id").join(s, "agent_id", "left").fillna(0)


def colocation_pairs(stays: DataFrame, grid: float = 300, salts: int = 16) -> DataFrame:
    """Pairs of agents that arrive in one grid cell within one hour of the clock, with the number of such cells.

    An agent counts once in a cell and hour. One side is dealt over `salts` tasks by its agent and the other goes to
    each of them, so a busy cell is spread; pairs are counted before they are shuffled.
    """
    at = stays.select(
        "agent_id", F.floor(F.col("lon") * 111320 / grid).alias("gx"), F.floor(F.col("lat") * 111320 / grid).alias("gy"),
        F.date_trunc("hour", "arrival_time").alias("hr"),
    ).distinct()
    a = at.withColumnRenamed("agent_id", "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    b = at.withColumnRenamed("agent_id", "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, ["gx", "gy", "hr", "salt"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


#: The features that are averaged over neighbours, and those that place a subscriber among the similar.
NEIGHBOUR_FEATURES = ["commute_distance_m", "entropy_of_places", "radius_of_gyration__allweek__allday", "number_of_interactions__allweek__allday__call", "amount_recharges__allweek__allday__mean"]
KNN_FEATURES = ["commute_distance_m", "number_of_places", "entropy_of_places", "radius_of_gyration__allweek__allday"]


def pagerank(edges: DataFrame, population: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """agent_id, pagerank: weighted power iteration from 1/N; what vertices without out-edges hold goes to all alike.

    It ends when the total change is under tolerance * N (never, where that is None), or after `iterations`. Each round is one join and one
    aggregate over what the last round wrote.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    out = cut(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    n = population.count()
    if not n:
        return population.select("agent_id", F.lit(None).cast("double").alias("pagerank"))
    # a vertex without out-edges sends its rank to nobody, that is to the row of null
    lost = population.select(F.col("agent_id").alias("src")).join(total, "src", "left_anti").select("src", F.lit(None).cast("long").alias("dst"), F.lit(1.0).alias("share"))
    out = cut(out.unionByName(lost))
    who = cut(population.select("agent_id"))
    ranks = who.withColumn("r", F.lit(1.0 / n))
    for i in range(iterations):
        sent = cut(out.join(ranks.withColumnRenamed("agent_id", "src"), "src").groupBy("dst").agg(F.sum(F.col("r") * F.col("share")).alias("s")))
        # a rank follows from what was sent, so only that is written
        idle = sent.where("dst is null").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("idle"))  # one row
        before, got = ranks, who.join(sent.withColumnRenamed("dst", "agent_id"), "agent_id", "left").crossJoin(F.broadcast(idle))
        ranks = got.select("agent_id", (alpha * (F.coalesce("s", F.lit(0.0)) + F.col("idle") / n) + (1 - alpha) / n).alias("r"))
        if tolerance is not None and i % 10 == 9:
            change = ranks.join(before.withColumnRenamed("r", "q"), "agent_id").agg(F.sum(F.abs(F.col("r") - F.col("q")))).first()[0]
            if change < tolerance * n:
                break
    return ranks.select("agent_id", F.round("r", 9).alias("pagerank"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(v, w): each distinct neighbour of each vertex, in either direction, without itself."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).union(edges.select("dst", "src")).where("v <> w").distinct()


def neighbour_table(neighbours: DataFrame, population: DataFrame, features: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    """Mean and population std of each feature over the neighbours (v, w); 0 without neighbours. One join for all features."""
    columns = columns or NEIGHBOUR_FEATURES
    f = features.select(F.col("agent_id").alias("w"), *columns).fillna(0)
    out = []
    for c in columns:
        name = f"{prefix}__neighbor_{c.split('__')[0]}"
        out += [F.round(F.avg(c) + 1e-9, 6).alias(f"{name}_mean"), F.round(F.stddev_pop(c) + 1e-9, 6).alias(f"{name}_std")]
    s = neighbours.join(f, "w").groupBy(F.col("v").alias("agent_id")).agg(*out)
    return population.select("agent_id").join(s, "agent_id", "left").fillna(0)


def social_features(edges: DataFrame, population: DataFrame, features: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """The 19 columns of the social graph, one row per subscriber, also of isolated ones."""
    p = "graph_social__"
    d = degree_strength(edges, population)
    names = {"total_degree": "degree", "in_degree": "in_degree", "out_degree": "out_degree", "total_strength": "strength", "in_strength": "in_strength", "out_strength": "out_strength"}
    rows = d.select("agent_id", *(F.col(a).cast("double" if "strength" in a else "long").alias(p + b) for a, b in names.items()))
    for part, c in ((clustering(edges, population), "clustering"), (pagerank(edges, population, iterations=iterations, tolerance=tolerance), "pagerank"), (reciprocity(edges, population), "reciprocity")):
        rows = rows.join(part.withColumnRenamed(c, p + c), "agent_id")
    return rows.join(neighbour_table(both_ways(edges), population, features, "graph_social"), "agent_id")


def colocation_features(pairs: DataFrame, population: DataFrame, features: DataFrame) -> DataFrame:
    """The 13 columns of the co-location graph from its pairs (a, b, weight); also from none."""
    p = "graph_colocation__"
    known = population.select("agent_id")
    pairs = pairs.join(known.withColumnRenamed("agent_id", "a"), "a", "left_semi").join(known.withColumnRenamed("agent_id", "b"), "b", "left_semi")
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("agent_id"), "weight")
    s = ends.groupBy("agent_id").agg(F.count("*").alias(p + "degree"), F.sum("weight").cast("double").alias(p + "strength"))
    rows = known.join(s, "agent_id", "left").fillna(0).join(clustering(edges, population).withColumnRenamed("clustering", p + "clustering"), "agent_id")
    return rows.join(neighbour_table(both_ways(edges), population, features, "graph_colocation"), "agent_id")


def standardise(rows: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """agent_id, x: the columns less their mean over `fitted`, by their population std, or by 1 where that is 0."""
    fitted = rows if fitted is None else fitted
    one = fitted.select(*columns).fillna(0).agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))))  # one row
    scale = lambda i: F.when(F.col(f"s_{i}") > 0, F.col(f"s_{i}")).otherwise(1.0)
    x = F.array(*((F.col(c) - F.col(f"m_{i}")) / scale(i) for i, c in enumerate(columns)))
    return rows.select("agent_id", *columns).fillna(0).crossJoin(F.broadcast(one)).select("agent_id", x.alias("x"))


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, per_block: int = 4096) -> DataFrame:
    """(v, w, distance): the k rows (agent_id, x) nearest to each query by Euclidean distance, never itself; ties to the smaller id.

    Both sides are dealt into blocks by a hash of the id; a pair of blocks is a task, which keeps k candidates a query.
    """
    nq, nr = (max(1, -(-t.count() // per_block)) for t in (queries, rows))
    deal = lambda n: F.pmod(F.xxhash64("agent_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("agent_id", "x", deal(nq).alias("qb"), every(nr).alias("rb"))
    r = rows.select("agent_id", "x", deal(nr).alias("rb"), every(nq).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"v": np.zeros(0, np.int64), "w": np.zeros(0, np.int64), "distance": np.zeros(0)})]
        if len(left) and len(right):
            right = right.sort_values("agent_id")
            b, ids = np.stack(right["x"]), right["agent_id"].to_numpy()
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                a, mine = np.stack(part["x"]), part["agent_id"].to_numpy()
                d = np.zeros((len(a), len(b)))
                for c in range(a.shape[1]):
                    d += (a[:, c, None] - b[None, :, c]) ** 2
                d[mine[:, None] == ids[None]] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(d, best, axis=1)
                out.append(pd.DataFrame({"v": np.repeat(mine, best.shape[1]), "w": ids[best].reshape(-1), "distance": np.sqrt(near.reshape(-1))}))
        out = pd.concat(out)
        return out[np.isfinite(out["distance"])]

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(search, "v long, w long, distance double")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("distance", "w"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("v", "w", "distance")


class MobilityKnn:
    """A graph of the k most similar subscribers, fitted on training rows only."""

    def __init__(self, k: int = 5, columns: list[str] | None = None, features: list[str] | None = None):
        self.k, self.columns, self.features = k, columns or KNN_FEATURES, features or NEIGHBOUR_FEATURES

    def fit(self, train: DataFrame) -> MobilityKnn:
        self.train = train
        self.scaled = cut(standardise(train, self.columns))
        self.near = cut(nearest_rows(self.scaled, self.scaled, self.k))
        edges = self.near.select(F.col("v").alias("src"), F.col("w").alias("dst"))
        self.coefficient = cut(clustering(edges, train))
        return self

    def transform(self, rows: DataFrame, is_train: bool = False) -> DataFrame:
        """The 13 columns of rows: links of training rows are those fitted, of others the k nearest training rows."""
        p = "graph_mobility__"
        near = self.near if is_train else nearest_rows(standardise(rows, self.columns, self.train), self.scaled, self.k)
        linked = near.join(self.coefficient.withColumnRenamed("agent_id", "w"), "w", "left")
        s = linked.groupBy(F.col("v").alias("agent_id")).agg(
            F.count("*").alias(p + "degree"), F.round(F.sum(1 / (1 + F.col("distance"))), 6).alias(p + "strength"), F.round(F.avg(F.coalesce("clustering", F.lit(0.0))), 6).alias(p + "clustering"),
        )
        mine = rows.select("agent_id")
        return mine.join(s, "agent_id", "left").fillna(0).join(neighbour_table(near.select("v", "w"), rows, self.train, "graph_mobility", self.features), "agent_id")


def graph_table(edges: DataFrame, pairs: DataFrame, population: DataFrame, features: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """phone_number and the 45 columns of the three graphs."""
    mobility = MobilityKnn().fit(features).transform(features, is_train=True)
    rows = social_features(edges, population, features, iterations, tolerance).join(colocation_features(pairs, population, features), "agent_id").join(mobility, "agent_id")
    return population.select("agent_id", "phone_number").join(rows, "agent_id").drop("agent_id")
