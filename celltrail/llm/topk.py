"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, pivots: int, step: int = 512):
    """(query_id, vec_id, score) of the k best candidates of each query.

    Vectors are lifted to one more dimension so that all candidates have one norm; the distance then falls as
    the inner product rises. |d(q, p) - d(c, p)| bounds d(q, c) from below for every pivot p; candidates
    are evaluated in order of their largest bound, until it exceeds the k-th distance found.
    """
    c, q = c.astype(np.float64), q.astype(np.float64)
    norm = (c * c).sum(axis=1)
    top = norm.max()
    lift = np.sqrt(top - norm)
    at = [int(norm.argmax())]
    table_ = []
    for _ in range(min(pivots, len(c))):  # each pivot is the candidate furthest from the pivots so far
        p = at[-1]
        d2 = norm + lift**2 + top - 2 * (c @ c[p] + lift * lift[p])
        table_.append(np.sqrt(np.maximum(d2, 0)))
        at.append(int(np.min(table_, axis=0).argmax()))
    at, dc = at[: len(table_)], np.array(table_)
    qn = (q * q).sum(axis=1)
    dq = np.sqrt(np.maximum(qn[:, None] + top - 2 * (q @ c[at].T), 0))
    for i in range(len(q)):
        bound = np.abs(dq[i][:, None] - dc).max(axis=0)
        order = np.argsort(bound, kind="stable")
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        for lo in range(0, len(order), step):
            part = order[lo : lo + step]
            if len(scores) == k:
                worst = np.sqrt(max(qn[i] + top - 2 * scores[-1], 0))
                if bound[part[0]] > worst + 1e-6 * (1 + worst):  # a tie is evaluated
                    break
            s, v = c[part] @ q[i], c_ids[part]
            own = v != q_ids[i]
            scores, ids = np.concatenate([scores, s[own]]), np.concatenate([ids, v[own]])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
        for s, v in zip(scores, ids):
            yield int(q_ids[i]), int(v), int(s)


def topk(queries: DataFrame, vectors: DataFrame, k: int = 5, pivots: int = 32, per_block: int = 8192) -> DataFrame:
    """(vec_id, v array<long>) each -> query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Queries and candidates are dealt into blocks of about per_block rows by a hash of the row; each pair of blocks is
    one task, and a query's partial results, k for each candidate block, are ranked at the end. Null vectors take no
    part; vectors whose length differs from the query's are not compared; a repeated vec_id is a candidate once per
    row, never of its own id; empty tables give an empty result.
    """
    vectors, queries = vectors.where("v is not null and vec_id is not null and size(v) > 0"), queries.where("v is not null and vec_id is not null and size(v) > 0")
    nc, nq = max(1, -(-vectors.count() // per_block)), max(1, -(-queries.count() // per_block))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    dim = F.size("v").alias("dim")
    c = vectors.select("vec_id", "v", dim, deal(nc, 1).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    q = queries.select("vec_id", "v", dim, deal(nq, 2).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            out = list(search_block(np.stack(left["v"]), left["vec_id"].to_numpy(), np.stack(right["v"]), right["vec_id"].to_numpy(), k, pivots))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["cb", "qb", "dim"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.when(e.isNotNull() & ~F.exists(e, bad), F.transform(e, lambda x: F.floor(256 * x.cast("double")).cast("long")))
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", v.alias("v"))
    return topk(rows.where("vec_id % 50 = 0"), rows)


SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
