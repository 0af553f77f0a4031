"""Call-detail views of the supplied tables; sources and sinks for the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "antennas": "antenna_id long, lat double, lon double",
    "mobility_traces": "agent_id long, timestamp timestamp_ntz, lat double, lon double, antenna_id long",
    "communication_events": "caller_id long, callee_id long, timestamp timestamp_ntz, event_type string, duration_sec long",
    "recharge_events": "agent_id long, timestamp timestamp_ntz, amount double, balance_after double",
}


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header and the declared schema of `name`; malformed CSV rows raise."""
    if path.endswith(".csv"):
        return spark.read.schema(SCHEMAS[name]).csv(path, header=True, mode="FAILFAST")
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").options(header=True).format(kind).save(path)


def first_given(*sources: DataFrame | None) -> DataFrame:
    """The first source that is there, as denoised traces before raw ones."""
    return next(s for s in sources if s is not None)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", "cast(get_json_object(props, '$.k') as bigint) k", "weekday(ts) + 1 dow", "hour(ts) h"
    )


def communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    n = ev.agg((F.max("user_id") + 1).alias("nu"))  # one row
    return ev.where("event_type <> 'purchase'").crossJoin(F.broadcast(n)).selectExpr(
        "event_id", "user_id caller_id",
        "case when event_id % 5 = 0 then (user_id + 3) % nu else (user_id - user_id % 3) + (user_id % 3 + 1 + event_id % 2) % 3 end callee_id",
        "ts as timestamp", "case when event_type in ('click', 'view') then 'call' else 'text' end event_type",
        "case when event_type in ('click', 'view') then cast(floor(value) as bigint) else 0L end duration_sec",
    )


def recharges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").selectExpr(
        "event_id", "user_id agent_id", "ts as timestamp", "value amount", "value * 0.5D balance_after"
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = "case when h < 7 or h >= 20 then 0 when dow <= 5 then 1 + (case when k < 15 then 1 else 0 end) else k % 3 end"
    return (
        events(spark, sf_dir).withColumn("z", F.expr(zone)).withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
        .where("j = 0 or k < 20").selectExpr(
            "event_id * 3 + j ping_id", "user_id agent_id", "timestampadd(SECOND, j * 60, ts) timestamp",
            "12.90D + ((user_id * 17 + z * 29) % 40) * 0.005D + (k - 50) * 0.000002D + (case when j = 1 then 0.004D else 0.0D end) lat",
            "77.50D + ((user_id * 23 + z * 31) % 40) * 0.006D + ((event_id % 100) - 50) * 0.000002D lon",
        )
    )


def antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "cast(s_suppkey as bigint) antenna_id", "12.90D + ((s_suppkey * 37) % 100) * 0.002D lat", "77.50D + ((s_suppkey * 61) % 100) * 0.0024D lon"
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().selectExpr(
        "user_id agent_id", "concat('SUB', lpad(cast(user_id as string), 6, '0')) phone_number"
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers with the seven labels, read off the customer table."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey agent_id", "elt(cast(c_nationkey % 5 as int) + 1, '18-24', '25-34', '35-44', '45-59', '60+') age_group", "case when c_custkey % 2 = 0 then 'male' else 'female' end gender",
        "elt(cast(c_nationkey % 4 as int) + 1, 'primary', 'secondary', 'graduate', 'postgraduate') education_level",
        "elt(cast(c_custkey % 6 as int) + 1, 'informal_labor', 'retail_service', 'clerical', 'professional', 'unemployed', 'student') occupation_category",
        "elt(cast(c_custkey % 4 as int) + 1, 'employed', 'unemployed', 'student', 'retired') work_status",
        "case when c_acctbal < 2000 then 'low' when c_acctbal < 5000 then 'lower_mid' when c_acctbal < 8000 then 'upper_mid' else 'high' end income_bracket",
        "elt(cast(length(c_mktsegment) % 5 as int) + 1, 'E', 'D', 'C', 'B', 'A') socio_demographic_class",
    )
    return population(spark, sf_dir).join(c, "agent_id", "left")


def write_reports(spark: SparkSession, reports: dict[str, str], path: str) -> None:
    """The reports by target, in order, as one text file in the folder `path`."""
    text = "\n\n".join(f"=== Target: {target} ===\n{report}" for target, report in reports.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
