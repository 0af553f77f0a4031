"""Stay points: runs of near pings, merged by grid cell, then joined by the pings left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, seconds


def runs(pings: DataFrame, delta: float = 200) -> DataFrame:
    """Adds run_id, which grows by one where two consecutive pings are not nearer than delta."""
    w = Window.partitionBy("agent_id").orderBy("timestamp", "ping_id")
    far = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) >= delta
    return pings.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn(
        "run_id", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("far")


def candidate_stays(pings: DataFrame, delta: float = 200, tau: float = 1200) -> DataFrame:
    return _candidates(runs(pings, delta), tau)


def _candidates(run: DataFrame, tau: float) -> DataFrame:
    span = seconds("departure_time") - seconds("arrival_time")
    return run.groupBy("agent_id", "run_id").agg(
        F.min("timestamp").alias("arrival_time"), F.max("timestamp").alias("departure_time"), F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"), F.count("*").alias("n_points"),
    ).where(span > tau)


def stay_clusters(candidates: DataFrame, grid: float = 200) -> DataFrame:
    """Candidates of one grid cell become one stay; stay_index is in the order of first appearance."""
    by_agent = Window.partitionBy("agent_id")
    first_lat = F.first("lat").over(by_agent.orderBy("run_id"))
    cell = candidates.withColumn("lat0", first_lat).withColumns({
        "r": F.floor(F.col("lat") * 111320 / grid), "c": F.floor(F.col("lon") * 111320 * F.cos(F.radians("lat0")) / grid),
    })
    return cell.groupBy("agent_id", "r", "c").agg(
        F.min("run_id").alias("first_run"), F.min("arrival_time").alias("arrival_time"), F.max("departure_time").alias("departure_time"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum("n_points").alias("n_points"),
    ).withColumn("stay_index", F.row_number().over(by_agent.orderBy("first_run")).cast("long")).drop("first_run", "r", "c")


def stay_points(pings: DataFrame, delta: float = 200, tau: float = 1200, grid: float = 200) -> DataFrame:
    """Merged stays, extended by each left-over ping whose nearest stay is nearer than delta."""
    run = runs(pings, delta)
    candidates = _candidates(run, tau)
    stays = stay_clusters(candidates, grid)
    left = run.join(candidates.select("agent_id", "run_id"), ["agent_id", "run_id"], "left_anti")
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    near = (
        left.join(stays.select("agent_id", "stay_index", F.col("lat").alias("slat"), F.col("lon").alias("slon")), "agent_id")
        .withColumn("d", d).where(F.col("d") < delta).groupBy("agent_id", "ping_id", "timestamp")
        .agg(F.min(F.struct("d", "stay_index")).alias("best"))
        .groupBy("agent_id", F.col("best.stay_index").alias("stay_index"))
        .agg(F.count("*").alias("more"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    )
    return stays.join(near, ["agent_id", "stay_index"], "left").select(
        "agent_id", "stay_index", F.least("arrival_time", "lo").alias("arrival_time"), F.greatest("departure_time", "hi").alias("departure_time"),
        "lat", "lon", (F.col("n_points") + F.coalesce("more", F.lit(0))).alias("n_points"),
    )
