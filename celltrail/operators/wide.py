"""The wide indicator table: one row per subscriber and 876 named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import indicators as ind
from . import places
from .indicators import CELL

WEEKS, DAYS, CHANNELS = ["allweek", "weekday", "weekend"], ["allday", "day", "night"], ["call", "text"]
STATS = ["mean", "std", "median", "skewness", "kurtosis", "min", "max"]

#: The indicators of a cell as metric, what follows the week and day, and whether it is a count.
PER_CHANNEL = [
    ("number_of_interactions", True), ("number_of_interaction_in", True), ("number_of_interaction_out", True), ("number_of_contacts", True),
    ("percent_initiated_interactions", False), ("percent_nocturnal", False), ("entropy_of_contacts", False), ("percent_pareto_interactions", False),
]
PER_CHANNEL_STATS = ["interactions_per_contact", "balance_of_contacts", "interevent_time"]
PER_CELL = [
    ("active_days", "callandtext", True), ("percent_pareto_durations", "call", False), ("response_rate_text", "callandtext", False),
    ("percent_initiated_conversations", "callandtext", False), ("number_of_antennas", "", True), ("entropy_of_antennas", "", False),
    ("percent_at_home", "", False), ("radius_of_gyration", "", False), ("frequent_antennas", "", True), ("number_of_recharges", "", True),
    ("percent_pareto_recharges", "", False),
]
PER_CELL_STATS = [("call_duration", "call"), ("response_delay_text", "callandtext"), ("amount_recharges", ""), ("interevent_time_recharges", "")]
#: The indicators without a cell.
WHOLE = [("reporting__number_of_records", True), ("churn_rate__mean", False), ("churn_rate__std", False), ("average_balance_recharges", False)]
COUNTS = {"has_inferred_work", "number_of_places"}


def name_of(metric: str, week: str, day: str, *rest: str) -> str:
    """metric__week__day and what else there is, joined by double underscores."""
    return "__".join([metric, week, day, *(r for r in rest if r)])


def cell_columns(week: str, day: str) -> dict[str, bool]:
    """The 96 names of one cell, and whether each is a count."""
    out = {}
    for channel in CHANNELS:
        out |= {name_of(m, week, day, channel): count for m, count in PER_CHANNEL if channel == "call" or m != "percent_initiated_interactions"}
        out |= {name_of(m, week, day, channel, s): False for m in PER_CHANNEL_STATS for s in STATS}
    out |= {name_of(m, week, day, rest): count for m, rest, count in PER_CELL}
    return out | {name_of(m, week, day, rest, s): False for m, rest in PER_CELL_STATS for s in STATS}


def columns() -> dict[str, bool]:
    """All 876 names, and whether each is a count."""
    out = dict(WHOLE)
    for week in WEEKS:
        for day in DAYS:
            out |= cell_columns(week, day)
    return out | {c: c in COUNTS for c in places.ANCHOR_FEATURES}


def _long(df: DataFrame, channel: str | None = None, prefix: str = "") -> DataFrame:
    """(agent_id, name, value) from rows keyed by cell, and channel where there is one."""
    keys = [*CELL, "event_type"] if channel == "event_type" else CELL
    measures = [c for c in df.columns if c not in keys]
    rest = F.col("event_type") if channel == "event_type" else F.lit(channel or "")
    parts = []
    for m in measures:
        metric, _, stat = m.partition("__")
        bits = [F.lit(metric), F.col("week"), F.col("day")]
        bits += [rest] if channel else []
        bits += [F.lit(stat)] if stat else []
        parts.append(F.struct(F.concat_ws("__", *bits).alias("name"), F.col(m).cast("double").alias("value")))
    return df.select("agent_id", F.explode(F.array(*parts)).alias("x")).select("agent_id", "x.*")


def indicator_rows(it: DataFrame, rech: DataFrame, located: DataFrame, homes: DataFrame) -> DataFrame:
    """(agent_id, name, value): the indicators of all cells in long form; cells without events have no rows."""
    counts = ind.counts(it).withColumnsRenamed({
        "number_of_interactions_in": "number_of_interaction_in", "number_of_interactions_out": "number_of_interaction_out", "percent_initiated": "percent_initiated_interactions",
    })
    frames = [
        *(_long(f, "event_type") for f in (counts, ind.contact_entropy(it), ind.interactions_per_contact(it), ind.contact_balance(it), ind.pareto_interactions(it), ind.interevent_time(it))),
        _long(ind.active_days(it), "callandtext"), _long(ind.call_duration(it), "call"), _long(ind.pareto_durations(it).drop("event_type"), "call"),
        _long(ind.text_response(it), "callandtext"), _long(ind.conversations(it), "callandtext"),
        *(_long(f) for f in (ind.antenna_entropy(located), ind.percent_at_home(located, homes), ind.radius_of_gyration(located), ind.frequent_antennas(located))),
        *(_long(f) for f in (ind.recharge_stats(rech), ind.pareto_recharges(rech))),
    ]
    return reduce(DataFrame.unionByName, frames).where("value is not null")


def whole_rows(it: DataFrame, rech: DataFrame, anchor_rows: DataFrame) -> DataFrame:
    """(agent_id, name, value): the indicators that have no cell."""
    def melt(df: DataFrame) -> DataFrame:
        parts = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns if c != "agent_id"]
        return df.select("agent_id", F.explode(F.array(*parts)).alias("x")).select("agent_id", "x.*")

    records = ind.records(it, rech).withColumnRenamed("number_of_records", "reporting__number_of_records")
    return reduce(DataFrame.unionByName, [melt(f) for f in (records, ind.churn(it), ind.average_balance(rech), anchor_rows)])


def feature_table(population: DataFrame, rows: DataFrame, names: dict[str, bool] | None = None) -> DataFrame:
    """phone_number and a column for each name; whoever has no row for a name has 0, so silent subscribers are kept.

    The rows are pivoted with the names given, in one shuffle by subscriber; a name that is not among them is left out.
    """
    names = names or columns()
    wide = rows.where(F.col("name").isin(list(names))) if len(names) < 100 else rows
    wide = wide.groupBy("agent_id").pivot("name", list(names)).agg(F.first("value"))
    out = population.select("agent_id", "phone_number").join(wide, "agent_id", "left").fillna(0)
    return out.select("phone_number", *(F.col(c).cast("long" if count else "double").alias(c) for c, count in names.items()))


def agent_features(rows: DataFrame, population: DataFrame, agent_id: int, names: dict[str, bool] | None = None) -> DataFrame:
    """The row of one subscriber; the filter goes below the aggregates that are keyed by subscriber."""
    return feature_table(population.where(F.col("agent_id") == agent_id), rows.where(F.col("agent_id") == agent_id), names)
