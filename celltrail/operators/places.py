"""Places: stays clustered in order by the first near centroid, labels, anchors and daily motifs."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_M, haversine_m, seconds
from ..functions.ordered import scan_sorted
from ..functions.stats import entropy
from .trajectory import nearest_antenna


def places(stays: DataFrame, radius: float = 250) -> DataFrame:
    """Adds place_id: the first place within radius of its running mean, else a new one. Stays without a position are left out."""

    def near(lat: float, lon: float, place: list) -> bool:
        p1, p2 = math.radians(lat), math.radians(place[0] / place[2])
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(place[1] / place[2] - lon) / 2) ** 2
        return 2 * RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)) <= radius

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        agent, known = None, []
        for who, index, lat, lon in rows:
            if who != agent:
                agent, known = who, []
            hit = next((i for i, p in enumerate(known) if near(lat, lon, p)), len(known))
            if hit == len(known):
                known.append([0.0, 0.0, 0])
            known[hit] = [known[hit][0] + lat, known[hit][1] + lon, known[hit][2] + 1]
            yield who, index, hit

    rows = stays.where("lat is not null and lon is not null").select("agent_id", "stay_index", F.col("lat").cast("double"), F.col("lon").cast("double"))
    ids = scan_sorted(rows, "agent_id", ["stay_index"], fold, "agent_id long, stay_index long, place_id long")
    return stays.join(ids, ["agent_id", "stay_index"])


def weeks_of(sim_days: float) -> float:
    return max(sim_days / 7.0, 1.0)


def minutes():
    return F.greatest((seconds("departure_time") - seconds("arrival_time")) / 60, F.lit(1.0))


def place_stats(placed: DataFrame, sim_days: float = 14) -> DataFrame:
    weekday, h = F.weekday("arrival_time") < 5, F.hour("arrival_time")
    home = weekday & ((h >= 20) | (h < 7))
    return placed.groupBy("agent_id", "place_id").agg(
        F.round(F.sum(F.when(home, minutes()).otherwise(0.0)), 6).alias("home_minutes"),
        F.round(F.sum(F.when(weekday & ~home, minutes()).otherwise(0.0)), 6).alias("work_minutes"),
        (F.count_if(weekday) / F.lit(weeks_of(sim_days))).alias("visits_per_week"),
    )


def label_places(placed: DataFrame, sim_days: float = 14) -> DataFrame:
    """Adds place_label. Home has the most home minutes; work the most among the rest, if visited weekly, with no runner-up."""
    by = Window.partitionBy("agent_id")
    stats = place_stats(placed, sim_days)
    home = (F.row_number().over(by.orderBy(F.desc("home_minutes"), "place_id")) == 1) & (F.col("home_minutes") > 0)
    stats = stats.withColumn("is_home", home)
    can_work = ~F.col("is_home") & (F.col("work_minutes") > 0)
    work = can_work & (F.row_number().over(by.orderBy(can_work.cast("int").desc(), F.desc("work_minutes"), "place_id")) == 1) & (F.col("visits_per_week") >= 1)
    label = F.when(F.col("is_home"), "home").when(work, "work").otherwise("other")
    return placed.join(stats.select("agent_id", "place_id", label.alias("place_label")), ["agent_id", "place_id"])


def anchors(labelled: DataFrame) -> DataFrame:
    part = lambda c, k: F.avg(F.when(F.col("place_label") == k, F.col(c)))
    out = [F.round(part(c, k), 9).alias(f"inferred_{k}_{c}") for k in ("home", "work") for c in ("lat", "lon")]
    return labelled.groupBy("agent_id").agg(*out, F.bool_or(F.col("place_label") == "work").alias("has_inferred_work"))


ANCHOR_FEATURES = ["commute_distance_m", "has_inferred_work", "number_of_places", "entropy_of_places", "total_stay_duration_min", "mean_stay_duration_min", "percent_dwell_at_home", "percent_dwell_at_work"]


def anchor_features(labelled: DataFrame, population: DataFrame) -> DataFrame:
    """One row per subscriber; without stays all are 0."""
    a = anchors(labelled)
    commute = haversine_m(*[F.col(f"inferred_{k}_{c}") for k in ("home", "work") for c in ("lat", "lon")])
    dwell = labelled.withColumn("m", minutes())
    share = lambda k: F.round(F.sum(F.when(F.col("place_label") == k, F.col("m")).otherwise(0.0)) / F.sum("m"), 6)
    totals = dwell.groupBy("agent_id").agg(
        F.count_distinct("place_id").alias("number_of_places"), F.round(F.sum("m"), 4).alias("total_stay_duration_min"),
        F.round(F.avg("m"), 4).alias("mean_stay_duration_min"), share("home").alias("percent_dwell_at_home"), share("work").alias("percent_dwell_at_work"),
    )
    ent = entropy(dwell.groupBy("agent_id", "place_id").agg(F.sum("m").alias("m")), ["agent_id"], "m", "entropy_of_places")
    known = a.select(
        "agent_id", F.round(F.coalesce(F.when(F.col("has_inferred_work"), commute), F.lit(0.0)), 2).alias("commute_distance_m"),
        F.col("has_inferred_work").cast("int").alias("has_inferred_work"),
    ).join(totals, "agent_id").join(ent, "agent_id")
    return population.select("agent_id").join(known, "agent_id", "left").fillna(0).select("agent_id", *ANCHOR_FEATURES)


def home_antennas(population: DataFrame, anchor_rows: DataFrame, pings: DataFrame, antennas: DataFrame) -> DataFrame:
    """agent_id, home_antenna_id: the antenna nearest to the inferred home, else to the mean of night pings, of all pings, of the antennas."""
    night = (F.hour("timestamp") < 7) | (F.hour("timestamp") >= 20)
    mean = lambda c, x: F.avg(F.when(x, F.col(c)))
    at = pings.groupBy("agent_id").agg(*(mean(c, x).alias(f"{k}_{c}") for k, x in (("night", night), ("any", F.lit(True))) for c in ("lat", "lon")))
    middle = antennas.agg(F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"))  # one row
    rows = population.select("agent_id").join(anchor_rows.select("agent_id", "inferred_home_lat", "inferred_home_lon"), "agent_id", "left").join(at, "agent_id", "left").crossJoin(F.broadcast(middle))
    pick = lambda c: F.coalesce(f"inferred_home_{c}", f"night_{c}", f"any_{c}", f"mid_{c}").alias(c)
    near = nearest_antenna(rows.select("agent_id", pick("lat"), pick("lon")), antennas)
    return near.select("agent_id", F.col("antenna_id").alias("home_antenna_id"))


def daily_motifs(labelled: DataFrame) -> DataFrame:
    has = lambda k: F.bool_or(F.col("place_label") == k)
    code = F.when(has("work") & has("other"), 2).when(has("work"), 3).when(has("other"), 1).otherwise(0)
    return labelled.groupBy("agent_id", F.to_date("arrival_time").alias("date")).agg(code.alias("motif"), (F.count("*") - 1).alias("trips"))


def motif_features(labelled: DataFrame, population: DataFrame) -> DataFrame:
    """One row per subscriber; without stays a subscriber has motif 0 and stays at home."""
    days = daily_motifs(labelled)
    n = days.groupBy("agent_id", "motif").agg(F.count("*").alias("n"), F.sum("trips").alias("t"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("agent_id"))
    f = n.withColumn("p", p).groupBy("agent_id").agg(
        F.max_by("motif", F.struct("n", -F.col("motif"))).alias("motif__primary_id"),
        F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-12)), 6).alias("motif__entropy"),
        F.round(F.sum(F.when(F.col("motif").isin(1, 2), F.col("p")).otherwise(0.0)), 6).alias("motif__fraction_commute_tours"),
        F.round(F.sum(F.when(F.col("motif") == 0, F.col("p")).otherwise(0.0)), 6).alias("motif__fraction_stay_home_days"),
        F.count("*").alias("motif__distinct_motifs_count"), F.round(F.sum("t") / F.sum("n"), 6).alias("motif__mean_daily_trips"),
    )
    return population.select("agent_id", "phone_number").join(f, "agent_id", "left").drop("agent_id").fillna({"motif__fraction_stay_home_days": 1.0}).fillna(0)
