"""Simulated antennas, subscribers, traces, communication and recharges: seeded, distributed, of the same shape as real tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2026-01-05"  # a Monday

#: Name, latitude, longitude, weight of homes, weight of jobs.
ZONES = [
    ("MG Road", 12.9757, 77.6086, 0.03, 0.11),
    ("Koramangala", 12.9352, 77.6245, 0.09, 0.10),
    ("Indiranagar", 12.9784, 77.6408, 0.08, 0.08),
    ("Whitefield", 12.9698, 77.7500, 0.10, 0.16),
    ("Electronic City", 12.8452, 77.6602, 0.07, 0.15),
    ("Jayanagar", 12.9308, 77.5838, 0.11, 0.05),
    ("HSR Layout", 12.9116, 77.6389, 0.09, 0.09),
    ("Marathahalli", 12.9569, 77.6974, 0.09, 0.12),
    ("Rajajinagar", 12.9911, 77.5555, 0.09, 0.04),
    ("Yelahanka", 13.1007, 77.5963, 0.08, 0.03),
    ("BTM Layout", 12.9166, 77.6101, 0.09, 0.04),
    ("Banashankari", 12.9250, 77.5468, 0.08, 0.03),
]
#: Categories and their probabilities.
AGES = {"18-24": 0.24, "25-34": 0.30, "35-44": 0.21, "45-59": 0.16, "60+": 0.09}
GENDERS = {"male": 0.52, "female": 0.48}
SCHOOL = ["primary", "secondary", "graduate", "postgraduate"]
SCHOOL_BY_AGE = {"18-24": [0.08, 0.30, 0.45, 0.17], "25-34": [0.10, 0.25, 0.40, 0.25], "35-44": [0.10, 0.25, 0.40, 0.25], "45-59": [0.25, 0.35, 0.28, 0.12], "60+": [0.25, 0.35, 0.28, 0.12]}
JOBS = ["informal_labor", "retail_service", "clerical", "professional", "unemployed", "student"]
JOBS_BY_SCHOOL = {
    "primary": [0.50, 0.32, 0.06, 0.03, 0.07, 0.02], "secondary": [0.25, 0.35, 0.18, 0.12, 0.06, 0.04],
    "graduate": [0.06, 0.16, 0.23, 0.48, 0.03, 0.04], "postgraduate": [0.02, 0.06, 0.15, 0.72, 0.02, 0.03],
}
INCOMES = ["low", "lower_mid", "upper_mid", "high"]
INCOME_BY_JOB = {
    "informal_labor": [0.50, 0.38, 0.10, 0.02], "retail_service": [0.25, 0.45, 0.24, 0.06], "clerical": [0.08, 0.32, 0.42, 0.18],
    "professional": [0.02, 0.10, 0.38, 0.50], "unemployed": [0.70, 0.25, 0.04, 0.01], "student": [0.55, 0.32, 0.10, 0.03],
}
DEGREE_FACTORS = [0.6, 0.9, 1.15, 1.5]
CLASSES = ["E", "D", "C", "B", "A"]
#: Mean days between recharges, mean and standard deviation of the amount.
RECHARGES = {"low": (3.0, 40.0, 15.0), "lower_mid": (5.0, 80.0, 25.0), "upper_mid": (9.0, 180.0, 60.0), "high": (16.0, 400.0, 150.0)}


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone string, lat double, lon double, density_weight double, employment_weight double")


def uniform(seed: int, *keys) -> Column:
    """In [0, 1), the same for the same keys whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * np.pi * uniform(seed + 7_000, *keys))


def pick(u: Column, names: Sequence, weights: Sequence[float]) -> Column:
    """The name whose share of the summed weights holds u."""
    ends = np.cumsum(weights) / np.sum(weights)
    out = F.lit(names[-1])
    for name, end in list(zip(names, ends))[-2::-1]:
        out = F.when(u < float(end), F.lit(name)).otherwise(out)
    return out


def pick_by(u: Column, by: Column, names: Sequence, weights: dict[str, Sequence[float]]) -> Column:
    out = None
    for key, w in weights.items():
        chosen = pick(u, names, w)
        out = F.when(by == key, chosen) if out is None else out.when(by == key, chosen)
    return out


def zone_value(name: Column, field: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for z in ZONES for x in (z[0], z[field]))), name)


def antennas(spark: SparkSession, n: int = 250, seed: int = 42) -> DataFrame:
    """antenna_id, lat, lon: around zones by homes and jobs."""
    rows = spark.range(n).select(F.col("id").alias("antenna_id"))
    rows = rows.withColumn("z", pick(uniform(seed, "antenna_id"), [z[0] for z in ZONES], [z[3] + z[4] for z in ZONES]))
    at = lambda f, k: (zone_value(F.col("z"), f) + 0.018 * normal(seed + k, "antenna_id"))
    return rows.select("antenna_id", at(1, 1).alias("lat"), at(2, 2).alias("lon"))


def population(spark: SparkSession, n_agents: int = 500, seed: int = 42) -> DataFrame:
    """One row an agent: age, then education, occupation, work status, income and class given those, and home and work."""
    u = lambda k: uniform(seed + k, "agent_id")
    c = F.col
    rows = spark.range(n_agents).select(c("id").alias("agent_id"), F.concat(F.lit("BLR"), (c("id") + 100_000_000).cast("string")).alias("phone_number"))
    rows = rows.withColumns({"age_group": pick(u(1), list(AGES), list(AGES.values())), "gender": pick(u(2), list(GENDERS), list(GENDERS.values()))})
    rows = rows.withColumn("education_level", pick_by(u(3), c("age_group"), SCHOOL, SCHOOL_BY_AGE))
    studies = (c("age_group") == "18-24") & c("education_level").isin("secondary", "graduate") & (u(4) < 0.35)
    rows = rows.withColumn("occupation_category", F.when(studies, "student").otherwise(pick_by(u(5), c("education_level"), JOBS, JOBS_BY_SCHOOL)))
    status = F.when((c("age_group") == "60+") & (u(6) < 0.6), "retired").when(c("occupation_category").isin("student", "unemployed"), c("occupation_category")).otherwise("employed")
    degree = c("education_level").isin("graduate", "postgraduate")
    raised = {k: [a * b for a, b in zip(w, DEGREE_FACTORS)] for k, w in INCOME_BY_JOB.items()}
    income = F.when(degree, pick_by(u(7), c("occupation_category"), INCOMES, raised)).otherwise(pick_by(u(7), c("occupation_category"), INCOMES, INCOME_BY_JOB))
    rows = rows.withColumns({"work_status": status, "income_bracket": income})
    level = lambda name, names: F.array_position(F.array(*map(F.lit, names)), c(name)) - 1
    score = level("income_bracket", INCOMES) + level("education_level", SCHOOL) + 0.6 * normal(seed + 8, "agent_id")
    rows = rows.withColumn("socio_demographic_class", F.element_at(F.array(*map(F.lit, CLASSES)), F.least(F.greatest(F.rint(score / 6 * 4), F.lit(0.0)), F.lit(4.0)).cast("int") + 1))
    names = [z[0] for z in ZONES]
    rows = rows.withColumn("home_zone", pick(u(9), names, [z[3] for z in ZONES]))
    rows = rows.withColumn("work_zone", F.when(c("work_status") == "employed", pick(u(10), names, [z[4] for z in ZONES])).otherwise(c("home_zone")))
    near = lambda z, f, k: zone_value(c(z), f) + 0.01 * normal(seed + k, "agent_id")
    return rows.select(
        "agent_id", "phone_number", "age_group", "gender", "education_level", "occupation_category", "work_status", "income_bracket", "socio_demographic_class",
        "home_zone", near("home_zone", 1, 11).alias("home_lat"), near("home_zone", 2, 12).alias("home_lon"), "work_zone", near("work_zone", 1, 13).alias("work_lat"), near("work_zone", 2, 14).alias("work_lon"),
    )


def mobility_traces(people: DataFrame, sim_days: int = 14, seed: int = 42) -> DataFrame:
    """agent_id, timestamp, lat, lon: at home at 0, 2, 4 and 6 h; on working days a way to work, hours there, a way back and the evening at home; else leisure or home every other hour from 7 h."""
    c = F.col
    days = people.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(sim_days - 1))))
    u = lambda k, *more: uniform(seed + k, "agent_id", "day", *more)
    works = ~(c("day") % 7).isin(5, 6) & c("work_status").isin("employed", "student")
    days = days.withColumns({"works": works, "leave": (7 + F.floor(3 * u(20))).cast("int"), "back": (18 + F.floor(3 * u(21))).cast("int")})
    hours = days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    h = c("h")
    home = h.isin(0, 2, 4, 6) | (c("works") & (h > c("back")))
    way = c("works") & ((h == c("leave")) | (h == c("back")))
    job = c("works") & (h > c("leave")) & (h < 18) & (u(22, "h") < 0.7)
    free = ~c("works") & (h >= 7) & (h % 2 == 1)
    kind = F.when(home, "home").when(way, "way").when(job, "work").when(free & (u(23, "h") < 0.35), "leisure").when(free, "home")
    rows = hours.withColumn("kind", kind).where("kind is not null").withColumn("z", pick(u(24, "h"), [z[0] for z in ZONES], [1.0] * len(ZONES)))
    jitter = F.when(c("kind") == "way", 0.01).when(c("kind") == "leisure", 0.008).otherwise(0.0008)

    def at(axis: str, field: int, k: int) -> Column:
        base = F.when(c("kind") == "home", c(f"home_{axis}")).when(c("kind") == "work", c(f"work_{axis}")).when(c("kind") == "way", (c(f"home_{axis}") + c(f"work_{axis}")) / 2)
        return base.otherwise(zone_value(c("z"), field)) + jitter * normal(seed + k, "agent_id", "day", "h")

    minute = F.floor(59 * u(25, "h"))
    when = F.expr(f"timestamp_ntz'{START} 00:00:00'")
    ts = F.timestamp_add("SECOND", (c("day") * 86400 + h * 3600 + minute * 60).cast("int"), when)
    return rows.select("agent_id", ts.alias("timestamp"), at("lat", 1, 26).alias("lat"), at("lon", 2, 27).alias("lon"))


def _poisson(u: Column, mean: float) -> Column:
    """The number of events whose cumulative probability first exceeds u."""
    p, ends, total = float(np.exp(-mean)), [], 0.0
    while total < 1 - 1e-12:
        total += p
        ends.append(total)
        p *= mean / len(ends)
    return F.aggregate(F.array(*map(F.lit, ends)), F.lit(0), lambda n, e: n + F.when(e <= u, 1).otherwise(0))


def social_ties(people: DataFrame, seed: int = 42, household: int = 3) -> DataFrame:
    """Distinct (a, b), a < b: households within a zone, 1.5 colleagues a head within a work zone, 0.8 others a head."""
    # households and the members that strangers draw from are parts of a zone cut by hashes, so no zone is one task
    sizes = lambda zone: people.groupBy(zone).agg(F.count("*").alias("size"))  # noqa: E731  a row a zone
    groups = people.join(F.broadcast(sizes("home_zone")), "home_zone")
    groups = groups.select("home_zone", "agent_id", F.floor(uniform(seed + 30, "agent_id") * F.ceil(F.col("size") / household)).alias("g"))
    homes = groups.withColumnRenamed("agent_id", "a").join(groups.withColumnRenamed("agent_id", "b"), ["home_zone", "g"]).where("a < b").select("a", "b")

    def partners(zone: str | None, share: float, k: int, part: int = 512) -> DataFrame:
        """Each agent draws twice among a random part of its zone."""
        inside = people.select("agent_id", (F.col(zone) if zone else F.lit("")).alias("zone"))
        inside = inside.join(F.broadcast(inside.groupBy("zone").agg(F.ceil(F.count("*") / part).alias("parts"))), "zone")
        members = inside.groupBy("zone", F.pmod(F.xxhash64(F.lit(seed + k), "agent_id"), "parts").alias("p")).agg(F.sort_array(F.collect_list("agent_id")).alias("members"))
        draws = inside.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).where(uniform(seed + k + 1, "agent_id", "i") < share / 2)
        met = draws.withColumn("p", F.floor(uniform(seed + k + 2, "agent_id", "i") * F.col("parts"))).join(members, ["zone", "p"])
        other = F.element_at("members", (F.floor(uniform(seed + k + 3, "agent_id", "i") * F.size("members")) + 1).cast("int"))
        met = met.select("agent_id", other.alias("o")).where("agent_id <> o")
        return met.select(F.least("agent_id", "o").alias("a"), F.greatest("agent_id", "o").alias("b"))

    return homes.union(partners("work_zone", 1.5, 40)).union(partners(None, 0.8, 50)).distinct()


def communication_events(people: DataFrame, sim_days: int = 14, seed: int = 42) -> DataFrame:
    """caller_id, callee_id, timestamp, event_type, duration_sec: 1 + Poisson(2 a week) events a tie, six in ten of them calls."""
    ties = social_ties(people, seed)
    u = lambda k, *more: uniform(seed + k, "a", "b", *more)
    events = ties.withColumn("n", _poisson(u(60), 2.0 * sim_days / 7) + 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    hour = F.least(F.greatest((14 + 5 * normal(seed + 61, "a", "b", "i")).cast("int"), F.lit(0)), F.lit(23))
    at = (F.floor(sim_days * u(62, "i")) * 86400 + hour * 3600 + F.floor(59 * u(63, "i")) * 60).cast("int")
    out, call = u(64, "i") < 0.5, u(65, "i") < 0.6
    return events.select(
        F.when(out, F.col("a")).otherwise(F.col("b")).alias("caller_id"), F.when(out, F.col("b")).otherwise(F.col("a")).alias("callee_id"),
        F.timestamp_add("SECOND", at, F.expr(f"timestamp_ntz'{START} 00:00:00'")).alias("timestamp"), F.when(call, "call").otherwise("text").alias("event_type"),
        F.when(call, F.floor(-120 * F.log(1 - u(66, "i")))).otherwise(0).cast("long").alias("duration_sec"),
    )


def recharge_events(people: DataFrame, sim_days: int = 14, seed: int = 42) -> DataFrame:
    """agent_id, timestamp, amount, balance_after: a renewal process an agent, by income; the balance is carried on, so each agent is one seeded loop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.datetime64(START, "us")
        for b in batches:
            rows = []
            for agent, income in zip(b.column("agent_id").to_pylist(), b.column("income_bracket").to_pylist()):
                gap, mean, spread = RECHARGES[income]
                rng = np.random.default_rng([seed, agent])
                t, balance = rng.exponential(gap), 0.0
                while t < sim_days:
                    amount = max(10.0, rng.normal(mean, spread))
                    balance = max(0.0, balance + amount - rng.uniform(0.3, 0.6) * amount)
                    rows.append((agent, start + np.timedelta64(int(t * 86_400_000_000), "us"), round(amount, 2), round(balance, 2)))
                    t += rng.exponential(gap)
            if rows:
                a, ts, x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.array(ts), pa.timestamp("us")), pa.array(x), pa.array(y)], names=["agent_id", "timestamp", "amount", "balance_after"])

    return people.select("agent_id", "income_bracket").mapInArrow(run, "agent_id long, timestamp timestamp_ntz, amount double, balance_after double")


def simulate(spark: SparkSession, n_agents: int = 500, sim_days: int = 14, n_antennas: int = 250, seed: int = 42) -> dict[str, DataFrame]:
    """The five tables by name."""
    people = population(spark, n_agents, seed)
    return {
        "population": people, "antennas": antennas(spark, n_antennas, seed), "mobility_traces": mobility_traces(people, sim_days, seed),
        "communication_events": communication_events(people, sim_days, seed), "recharge_events": recharge_events(people, sim_days, seed),
    }
