"""Trajectory cleaning: order-dependent passes over each agent's ordered pings, and the nearest antenna."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_M, seconds
from ..functions.ordered import scan_sorted

EDGE = 1 - 1e-9


def nearest_antenna(points: DataFrame, antennas: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds antenna_id by planar distance in degrees; ties go to the smaller id; null where a coordinate is.

    Distinct positions are put into a grid of about one a cell, and each cell gets the list of its own and its eight
    neighbours' antennas. A point looks at its cell's list; an antenna nearer than a cell's side cannot be outside it. Only
    points without such an antenna look at a grid of 4 times the side, and at last at all antennas. Whether a list
    table is broadcast is left to its size.
    """
    a = antennas.select("antenna_id", F.col("lat").alias("alat"), F.col("lon").alias("alon")).where("alat is not null and alon is not null")
    a = a.groupBy("alat", "alon").agg(F.min("antenna_id").alias("antenna_id"))  # of equal positions the smallest id wins anyway
    box = a.agg(F.count("*").alias("n"), *(f(c).alias(f"{g}_{c}") for c in ("alat", "alon") for f, g in ((F.min, "lo"), (F.max, "hi")))).first()  # one row
    points = points.drop("antenna_id")
    if not box.n:
        return points.withColumn("antenna_id", F.lit(None).cast("long"))
    h, w = box.hi_alat - box.lo_alat, box.hi_alon - box.lo_alon
    side = max(math.sqrt(h * w / box.n), max(h, w) / box.n, 1e-6)
    d2 = lambda t: F.pow(t["alat"] - F.col(lat), 2) + F.pow(t["alon"] - F.col(lon), 2)
    best = lambda c: F.array_min(F.transform(c, lambda t: F.struct(d2(t).alias("d"), t["antenna_id"].alias("id"))))
    listed = F.collect_list(F.struct("antenna_id", "alat", "alon")).alias("towers")
    out = points.withColumn("_best", F.lit(None).cast("struct<d:double,id:bigint>"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    for g in (side, 4 * side):
        cell = lambda c, g=g: F.floor(F.col(c) / g)
        lists = a.withColumn("s", F.explode(around)).groupBy((cell("alat") + F.col("s.i")).alias("_r"), (cell("alon") + F.col("s.j")).alias("_c")).agg(listed)
        todo = F.col("_best").isNull()
        out = out.withColumns({"_r": F.when(todo, cell(lat)), "_c": F.when(todo, cell(lon))}).join(lists, ["_r", "_c"], "left")
        found = best("towers")
        out = out.withColumn("_found", found).withColumn("_best", F.when(todo & (F.col("_found.d") < (g * EDGE) ** 2), F.col("_found")).otherwise(F.col("_best")))
        out = out.drop("_r", "_c", "towers", "_found")
    everything = a.agg(listed).withColumn("_all", F.lit(1))  # one row; only points far from all antennas meet it
    out = out.withColumn("_all", F.when(F.col("_best").isNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull(), 1)).join(everything, "_all", "left")
    return out.withColumn("antenna_id", F.coalesce("_best", best("towers"))["id"]).drop("_best", "_all", "towers")


TRACE = "agent_id long, ping_id long, timestamp timestamp_ntz, lat double, lon double"


def _trace(pings: DataFrame, *more: Column) -> DataFrame:
    return pings.select("agent_id", "ping_id", "timestamp", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), seconds("timestamp").alias("t"), *more)


def ping_pong(pings: DataFrame, max_seconds: float = 300, max_m: float = 800, min_m: float = 100) -> DataFrame:
    """Moves the middle of an A-B-A bounce to the midpoint of its ends; a moved ping is the next step's first.

    Pings are in the order of (timestamp, ping_id); agents with fewer than three stay as they are. A ping with a null
    coordinate is passed on and takes no part.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        def dist(p: tuple, q: tuple, scale: float) -> float:
            return math.hypot(math.radians(q[4] - p[4]) * scale, math.radians(q[3] - p[3]) * RADIUS_M)

        a = b = None
        for c in rows:
            if c[3] is None or c[4] is None:
                yield c[:5]
                continue
            if b is not None and b[0] != c[0]:
                yield b[:5]
                a = b = None
            if b is not None:
                if a is None:
                    yield b[:5]
                else:
                    if c[5] - a[5] <= max_seconds:
                        scale = RADIUS_M * math.cos(math.radians(a[3]))
                        d12, d23, d13 = dist(a, b, scale), dist(b, c, scale), dist(a, c, scale)
                        if max(d12, d23) > min_m and d13 <= max_m and d13 < min(d12, d23):
                            b = (*b[:3], (a[3] + c[3]) / 2, (a[4] + c[4]) / 2, b[5])
                    yield b[:5]
                a = b
            b = c
        if b is not None:
            yield b[:5]

    return scan_sorted(_trace(pings), "agent_id", ["timestamp", "ping_id"], fold, TRACE)


def kalman(pings: DataFrame, process_std: float = 5, measurement_std: float = 150) -> DataFrame:
    """Constant-velocity filter; both axes share one 2 x 2 covariance, so the state is seven numbers.

    The projection's reference is the agent's mean latitude. A ping with a null coordinate is passed on unchanged.
    """
    q, r = float(process_std**2), float(measurement_std**2)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        agent = state = None
        for row in rows:
            who, ping, ts, lat, lon, t, ref = row
            if lat is None or lon is None:
                yield row[:5]
                continue
            scale = RADIUS_M * math.cos(math.radians(ref))
            mx, my = math.radians(lon) * scale, math.radians(lat) * RADIUS_M
            if state is None or who != agent:
                agent, state = who, (mx, 0.0, my, 0.0, r, 0.0, r, t)
                yield row[:5]
                continue
            x, vx, y, vy, p11, p12, p22, before = state
            d = max(t - before, 1.0)
            a11 = p11 + 2 * d * p12 + d * d * p22 + q * d * d / 3
            a12 = p12 + d * p22 + q * d / 2
            a22 = p22 + q
            k1, k2 = a11 / (a11 + r), a12 / (a11 + r)
            px, py = x + d * vx, y + d * vy
            ex, ey = mx - px, my - py
            state = (px + k1 * ex, vx + k2 * ex, py + k1 * ey, vy + k2 * ey, (1 - k1) * a11, (1 - k1) * a12, a22 - k2 * a12, t)
            yield who, ping, ts, math.degrees(state[2] / RADIUS_M), math.degrees(state[0] / scale)

    ref = F.avg(F.when(F.col("lon").isNotNull(), F.col("lat"))).over(Window.partitionBy("agent_id")).alias("ref")
    return scan_sorted(_trace(pings, ref), "agent_id", ["timestamp", "ping_id"], fold, TRACE)


def particle_filter(pings: DataFrame, particles: int = 200, process_std: float = 5, measurement_std: float = 150, seed: int = 0) -> DataFrame:
    """Sequential Monte Carlo with a constant-velocity cloud, one seeded generator an agent, systematic resampling.

    Weights are each step's likelihoods; the cloud is resampled where the effective size falls under half. A trace keeps
    its length and its first ping; a ping with a null coordinate is passed on unchanged.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        agent = cloud = None
        for row in rows:
            who, ping, ts, lat, lon, t, ref = row
            if lat is None or lon is None:
                yield row[:5]
                continue
            scale = RADIUS_M * math.cos(math.radians(ref))
            seen = np.array([math.radians(lon) * scale, math.radians(lat) * RADIUS_M])
            if cloud is None or who != agent:
                agent, before, rng = who, t, np.random.default_rng(seed)
                cloud = np.concatenate([seen + rng.normal(0, measurement_std, (particles, 2)), rng.normal(0, process_std, (particles, 2))], axis=1)
                yield row[:5]
                continue
            d, before = max(t - before, 1.0), t
            cloud[:, 2:] += rng.normal(0, process_std * math.sqrt(d), (particles, 2))
            cloud[:, :2] += cloud[:, 2:] * d
            off = ((cloud[:, :2] - seen) ** 2).sum(axis=1)
            weight = np.exp(-0.5 * (off - off.min()) / measurement_std**2)
            weight /= weight.sum()
            x, y = weight @ cloud[:, :2]
            if 1 / (weight**2).sum() < particles / 2:
                at = (np.arange(particles) + rng.random()) / particles
                cloud = cloud[np.minimum(np.searchsorted(np.cumsum(weight), at), particles - 1)]
            yield who, ping, ts, math.degrees(y / RADIUS_M), math.degrees(x / scale)

    ref = F.avg(F.when(F.col("lon").isNotNull(), F.col("lat"))).over(Window.partitionBy("agent_id")).alias("ref")
    return scan_sorted(_trace(pings, ref), "agent_id", ["timestamp", "ping_id"], fold, TRACE)


def denoise(pings: DataFrame, method: str = "kalman", bounces: bool = True, **settings) -> DataFrame:
    """Bounce smoothing, where asked for, and then a filter: any method but `kalman` is the particle filter; antenna_id goes."""
    rows = ping_pong(pings) if bounces else pings.drop("antenna_id")
    return (kalman if method == "kalman" else particle_filter)(rows, **settings)
