"""Communication and spending indicators, long form: one row per agent, channel and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import seconds
from ..functions.stats import cells, entropy, pareto, summary

CELL = ["agent_id", "week", "day"]
KEY = [*CELL, "event_type"]


def interactions(comm: DataFrame) -> DataFrame:
    """Each event twice, as its caller and its callee see it, from one scan."""
    view = lambda a, b, d: F.struct(F.col(a).alias("agent_id"), F.col(b).alias("contact_id"), F.lit(d).alias("direction"))
    both = F.explode(F.array(view("caller_id", "callee_id", "out"), view("callee_id", "caller_id", "in")))
    return comm.select("event_id", "timestamp", "event_type", "duration_sec", both.alias("v")).select("v.*", "event_id", "timestamp", "event_type", "duration_sec")


def counts(it: DataFrame) -> DataFrame:
    out = F.count_if(F.col("direction") == "out")
    night = (F.hour("timestamp") < 7) | (F.hour("timestamp") >= 19)
    return cells(it).groupBy(*KEY).agg(
        F.count("*").alias("number_of_interactions"), F.count_if(F.col("direction") == "in").alias("number_of_interactions_in"),
        out.alias("number_of_interactions_out"), F.count_distinct("contact_id").alias("number_of_contacts"),
        F.when(F.col("event_type") == "call", F.round(out / F.count("*"), 6)).alias("percent_initiated"), F.round(F.avg(night.cast("int")), 6).alias("percent_nocturnal"),
    )


def per_contact(it: DataFrame) -> DataFrame:
    sign = F.when(F.col("direction") == "out", 1).otherwise(-1)
    return cells(it).groupBy(*KEY, "contact_id").agg(
        F.count("*").alias("n"), (F.sum(sign) / F.count("*")).alias("balance"), F.sum("duration_sec").alias("duration")
    )


def contact_entropy(it: DataFrame) -> DataFrame:
    return entropy(per_contact(it), KEY, "n", "entropy_of_contacts")


def interactions_per_contact(it: DataFrame) -> DataFrame:
    return per_contact(it).groupBy(*KEY).agg(*summary("n", "interactions_per_contact"))


def contact_balance(it: DataFrame) -> DataFrame:
    return per_contact(it).groupBy(*KEY).agg(*summary("balance", "balance_of_contacts"))


def _six(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def pareto_interactions(it: DataFrame) -> DataFrame:
    return _six(pareto(per_contact(it), KEY, "n", "percent_pareto_interactions"), "percent_pareto_interactions")


def pareto_durations(it: DataFrame) -> DataFrame:
    return _six(pareto(per_contact(it.where("event_type = 'call'")), KEY, "duration", "percent_pareto_durations"), "percent_pareto_durations")


def interevent_time(it: DataFrame) -> DataFrame:
    """Gaps are taken within the cell, so they jump over its excluded hours."""
    w = Window.partitionBy(*KEY).orderBy("timestamp", "event_id", "direction")
    gaps = cells(it).withColumn("gap", seconds("timestamp") - F.lag(seconds("timestamp")).over(w))
    return gaps.groupBy(*KEY).agg(*summary("gap", "interevent_time"))


def call_duration(it: DataFrame) -> DataFrame:
    return cells(it.where("event_type = 'call'")).groupBy(*CELL).agg(*summary("duration_sec", "call_duration"))


def text_response(it: DataFrame, within: float = 3600) -> DataFrame:
    """Delay from an incoming text to the next outgoing one to that contact, if it is in time; of one event's two views the outgoing is first."""
    # backwards, so that the frame only grows
    w = Window.partitionBy(*CELL, "contact_id").orderBy(F.desc("timestamp"), F.desc("event_id"), "direction").rowsBetween(Window.unboundedPreceding, -1)
    reply = F.last(F.when(F.col("direction") == "out", seconds("timestamp")), ignorenulls=True).over(w)
    delay = reply - seconds("timestamp")
    rows = cells(it.where("event_type = 'text'")).withColumn("delay", delay).where("direction = 'in'")
    rows = rows.withColumn("delay", F.when(F.col("delay") <= within, F.col("delay")))
    return rows.groupBy(*CELL).agg(*summary("delay", "response_delay_text"), F.round(F.count("delay") / F.count("*"), 6).alias("response_rate_text"))


def conversations(it: DataFrame, gap: float = 3600) -> DataFrame:
    """Share of sessions, split where a contact is silent for over `gap` seconds, that the agent begins."""
    w = Window.partitionBy(*CELL, "contact_id").orderBy("timestamp", "event_id", F.desc("direction"))
    rows = cells(it).withColumn("before", F.lag(seconds("timestamp")).over(w))
    first = rows.where(F.col("before").isNull() | (seconds("timestamp") - F.col("before") > gap))
    return first.groupBy(*CELL).agg(F.round(F.avg((F.col("direction") == "out").cast("int")), 6).alias("percent_initiated_conversations"))


def active_days(it: DataFrame) -> DataFrame:
    return cells(it).groupBy(*CELL).agg(F.count_distinct(F.to_date("timestamp")).alias("active_days"))


def recharge_stats(rech: DataFrame) -> DataFrame:
    w = Window.partitionBy(*CELL).orderBy("timestamp", "event_id")
    rows = cells(rech).withColumn("gap", (seconds("timestamp") - F.lag(seconds("timestamp")).over(w)) / 86400)
    return rows.groupBy(*CELL).agg(F.count("*").alias("number_of_recharges"), *summary("amount", "amount_recharges"), *summary("gap", "interevent_time_recharges"))


def pareto_recharges(rech: DataFrame) -> DataFrame:
    return _six(pareto(cells(rech), CELL, "amount", "percent_pareto_recharges"), "percent_pareto_recharges")


def churn(it: DataFrame) -> DataFrame:
    """Mean and std of the relative change of weekly counts, over weeks in which anything happened."""
    start = F.min("timestamp").over(Window.partitionBy("agent_id"))
    days = F.floor((seconds("timestamp") - seconds(start)) / 86400)
    weekly = it.withColumn("wk", F.floor(days / 7)).groupBy("agent_id", "wk").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("agent_id").orderBy("wk"))
    change = weekly.withColumn("change", (F.col("n") - before) / before)
    return change.groupBy("agent_id").agg(
        F.round(F.coalesce(F.avg("change"), F.lit(0.0)), 6).alias("churn_rate__mean"),
        F.round(F.coalesce(F.stddev_samp("change"), F.lit(0.0)), 6).alias("churn_rate__std"),
    )


def average_balance(rech: DataFrame) -> DataFrame:
    return rech.groupBy("agent_id").agg(F.round(F.avg("balance_after"), 6).alias("average_balance_recharges"))


def records(it: DataFrame, rech: DataFrame) -> DataFrame:
    return it.select("agent_id").unionAll(rech.select("agent_id")).groupBy("agent_id").agg(F.count("*").alias("number_of_records"))


def antenna_use(located: DataFrame) -> DataFrame:
    return cells(located).groupBy(*CELL, "antenna_id").agg(F.count("*").alias("n"))


def antenna_entropy(located: DataFrame) -> DataFrame:
    use = antenna_use(located)
    n = use.groupBy(*CELL).agg(F.count("*").alias("number_of_antennas"))
    return entropy(use, CELL, "n", "entropy_of_antennas").join(n, CELL)


def frequent_antennas(located: DataFrame) -> DataFrame:
    use = antenna_use(located)
    share = pareto(use, CELL, "n", "share").join(use.groupBy(*CELL).agg(F.count("*").alias("n")), CELL)
    return share.select(*CELL, F.greatest((F.col("share") * F.col("n")).cast("long"), F.lit(1)).cast("long").alias("frequent_antennas"))


def radius_of_gyration(located: DataFrame) -> DataFrame:
    return cells(located).groupBy(*CELL).agg(F.round(111000 * F.sqrt(F.var_pop("lat") + F.var_pop("lon")), 3).alias("radius_of_gyration"))


def percent_at_home(located: DataFrame, homes: DataFrame) -> DataFrame:
    rows = cells(located.join(homes, "agent_id"))
    return rows.groupBy(*CELL).agg(F.round(F.avg((F.col("antenna_id") == F.col("home_antenna_id")).cast("int")), 6).alias("percent_at_home"))
