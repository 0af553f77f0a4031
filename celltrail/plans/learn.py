"""Queries over the learning operators, the simulators and the file sources with their SQL; stochastic ones are counted against what must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.durable import shared_folder
from ..operators import graph, learning, metrics, places, trajectory, wide
from ..sources import adapters as src
from ..sources import simulate as sim
from . import catalogue as c
from . import graphs, more, tables

SMALL = {"iterations": 2, "depth": 2, "rate": 0.3}
AGES = ["18-24", "25-34", "35-44", "45-59", "60+"]
TARGETS = list(learning.PARENTS)


def shares(s, d):
    """agent_id, p: the shares of an agent's events by event_id % 5, taken as probabilities."""
    one = lambda i: F.count_if(F.col("event_id") % 5 == i) / F.count("*")
    return src.events(s, d).groupBy(F.col("user_id").alias("agent_id")).agg(F.array(*(one(i) for i in range(5))).alias("p"))


def guesses(s, d):
    people = learning.encode_labels(src.demographics(s, d).where("age_group is not null"), "age_group")
    return shares(s, d).join(people.select("agent_id", "phone_number", "age_group", "y"), "agent_id").withColumn("guess", learning.argmax("p"))


def records(s, d):
    """Figures of made-up experiments, read off the events."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    ev = src.events(s, d).select(
        pick(learning.VARIANTS, F.col("event_id") % 5).alias("variant"), pick([42, 123, 999], F.col("user_id") % 3).alias("seed"), pick(TARGETS, F.col("k") % 7).alias("target"), "value", "k",
    )
    return ev.groupBy("variant", "seed", "target").agg(
        (F.avg("k") / 100).alias("uncal_macro_f1"), (F.avg("value") / 100).alias("cal_macro_f1"), (F.avg("value") / 200).alias("cal_weighted_f1"), (F.max("value") / 100).alias("uncal_brier"), (F.min("value") / 100).alias("cal_brier"),
    ).withColumn("is_known_artifact", F.col("target").isin(*learning.ARTIFACTS))


def base(s, d):
    motifs = places.motif_features(c._labelled(s, d), src.population(s, d))
    return learning.base_features(wide.feature_table(src.population(s, d), tables.wide_rows(s, d), tables.SLICE), motifs)


def variant_social(s, d):
    table = graph.social_features(c._edges(s, d), src.population(s, d), graphs.features(s, d), graphs.ROUNDS, None).join(src.population(s, d), "agent_id").drop("agent_id")
    return learning.variant_features(src.population(s, d).select("phone_number"), table, "baseline+social")[0]


def chained(s, d):
    p = guesses(s, d).select("phone_number", *(F.round(F.col("p")[i], 6).alias(f"prob_age_group__{a}") for i, a in enumerate(AGES)))
    return learning.chain_features(src.population(s, d).select("phone_number"), {"age_group": p}, "education_level")


def _inputs(s, d):
    return shares(s, d).select("agent_id", *(F.col("p")[i].alias(f"f{i}") for i in range(5))).join(src.population(s, d), "agent_id")


def smote_sizes(s, d):
    rows = _inputs(s, d).join(src.demographics(s, d).select("agent_id", "income_bracket"), "agent_id").where("income_bracket is not null")
    rows = graph.cut(learning.to_matrix(learning.encode_labels(rows, "income_bracket"), [f"f{i}" for i in range(5)], "y"))
    box = rows.select("y", F.posexplode("x").alias("i", "v")).groupBy("y", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    made = graph.cut(learning.smote(rows))
    out = made.where("agent_id is null").select("y", F.posexplode("x").alias("i", "v")).join(box, ["y", "i"]).where("v < lo - 1e-9 or v > hi + 1e-9").groupBy("y").agg(F.count("*").alias("outside"))
    return made.groupBy("y").agg(F.count("*").alias("n")).join(out, "y", "left").fillna(0)


def predictions(s, d):
    """One row a subscriber: whether each target's probabilities come to 1 and the label is the likeliest."""
    features = _inputs(s, d).drop("agent_id")
    got = learning.final_predictions(features, src.demographics(s, d), ["age_group", "education_level"], **SMALL)
    sums = [F.round(sum((F.col(f"`{x}`") for x in got.columns if x.startswith(f"prob_{t}__")), F.lit(0.0)), 6).alias(f"{t}_sum") for t in ("age_group", "education_level")]
    return got.select("phone_number", *sums, F.col("predicted_age_group").isNotNull().alias("named"))


def ablation_run(s, d):
    """A small run of the whole driver; what must hold of its records."""
    features = _inputs(s, d).drop("agent_id")
    rows, reports = learning.experiments(features, None, src.demographics(s, d), (42,), 2, ["baseline"], ["gender", "age_group"], **SMALL)
    unit = lambda x, hi=1.0: F.col(x).between(0.0, hi)
    return rows.select("variant", "target", (unit("uncal_macro_f1") & unit("cal_macro_f1") & unit("cal_weighted_f1")).alias("f1_fits"), (unit("uncal_brier", 2.0) & unit("cal_brier", 2.0)).alias("brier_fits"))


def _people(s):
    return sim.population(s, 400, 42)


def simulated_population(s, d):
    p = _people(s)
    return p.agg(
        F.count("*").alias("n"), F.count_distinct("phone_number").alias("phones"), F.count_if((F.col("work_status") != "employed") & (F.col("work_zone") != F.col("home_zone"))).alias("work_elsewhere"),
        F.count_if((F.col("work_status") == "student") & (F.col("occupation_category") != "student")).alias("odd_students"), F.count_if(F.col("home_lat").isNull() | F.col("age_group").isNull() | F.col("socio_demographic_class").isNull()).alias("nulls"),
    )


def simulated_events(s, d):
    e = sim.communication_events(_people(s), 14, 42)
    late = F.col("timestamp") >= F.expr("timestamp_ntz'2026-01-19 00:00:00'")
    return e.agg(
        F.count_if((F.col("event_type") == "text") & (F.col("duration_sec") != 0)).alias("long_texts"), F.count_if(F.col("caller_id") == F.col("callee_id")).alias("self_calls"), F.count_if(late).alias("late"),
        F.count_distinct("event_type").alias("kinds"), (F.count("*") > 400 * 4).alias("plenty"),
    )


def simulated_traces(s, d):
    t = sim.mobility_traces(_people(s), 14, 42)
    nightly = t.where(F.hour("timestamp").isin(0, 2, 4, 6)).groupBy("agent_id", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    return nightly.groupBy("n").agg(F.count("*").alias("agent_days"))


def simulated_recharges(s, d):
    r = sim.recharge_events(_people(s), 14, 42)
    return r.agg(F.count_if(F.col("amount") < 10).alias("small"), F.count_if(F.col("balance_after") < 0).alias("negative"), F.count_if(F.col("timestamp") >= F.expr("timestamp_ntz'2026-01-19 00:00:00'")).alias("late"), (F.count("*") > 400).alias("plenty"))


def simulated_antennas(s, d):
    a = sim.antennas(s, 250, 42)
    return a.agg(F.count("*").alias("n"), F.count_if(~F.col("lat").between(12.7, 13.3) | ~F.col("lon").between(77.3, 77.95)).alias("far"))


def particles(s, d):
    """Of the particle filter's traces: rows, first pings left as they were, empty positions."""
    p = src.pings(s, d)
    got = trajectory.particle_filter(p)
    first = p.groupBy("agent_id").agg(F.min_by(F.struct("ping_id", "lat", "lon"), F.struct("timestamp", "ping_id")).alias("f"))
    same = got.join(first, "agent_id").where("ping_id = f.ping_id and lat = f.lat and lon = f.lon").agg(F.count("*").alias("unchanged"))
    return got.agg(F.count("*").alias("n"), F.count_if(F.isnan("lat") | F.col("lat").isNull()).alias("empty")).crossJoin(same)


def csv_round_trip(s, d):
    path = f"{shared_folder(s)}/antennas-{uuid.uuid4().hex}.csv"
    src.write_table(src.antennas(s, d), path, "csv")
    return src.read_table(s, path, "antennas")


def chosen_source(s, d):
    """Denoised traces where there are any, else the raw ones."""
    return src.first_given(None, src.pings(s, d)).groupBy("agent_id").agg(F.count("*").alias("n"))


QUERIES = {
    "label_index": lambda s, d: learning.encode_labels(src.demographics(s, d), "age_group").select("agent_id", "age_group", "y"),
    "fold_sizes": lambda s, d: metrics.stratified_folds(src.demographics(s, d), "phone_number", "age_group").groupBy("age_group", "fold").agg(F.count("*").alias("n")),
    "min_class": lambda s, d: learning.min_class_count(src.demographics(s, d), "income_bracket"),
    "argmax_class": lambda s, d: guesses(s, d).select("agent_id", "guess"),
    "brier_score": lambda s, d: metrics.brier(guesses(s, d), "p", "y"),
    "f1_report": lambda s, d: metrics.f1_report(guesses(s, d), "y", "guess"),
    "f1_scores": lambda s, d: metrics.f1_scores(guesses(s, d), "y", "guess"),
    "training_base": base, "variant_social": variant_social, "chain_features": chained, "experiment_records": records,
    "ablation_summary": lambda s, d: learning.ablation_summary(records(s, d)), "results_summary": lambda s, d: learning.results_summary(records(s, d)),
    "smote_sizes": smote_sizes, "predictions": predictions, "ablation_run": ablation_run,
    "zones": lambda s, d: sim.zones(s), "simulated_population": simulated_population, "simulated_events": simulated_events, "simulated_traces": simulated_traces,
    "simulated_recharges": simulated_recharges, "simulated_antennas": simulated_antennas, "particle_filter": particles, "csv_round_trip": csv_round_trip, "chosen_source": chosen_source,
}

# ---- SQL --------------------------------------------------------------------------------------------------------

_list = lambda names: "[" + ", ".join(f"'{n}'" if isinstance(n, str) else str(n) for n in names) + "]"
_DEM = f"""dem as (select agent_id, phone_number, {_list(AGES)}[cast(c_nationkey % 5 as integer) + 1] age_group,
  {_list(['primary', 'secondary', 'graduate', 'postgraduate'])}[cast(c_nationkey % 4 as integer) + 1] education_level,
  case when c_acctbal < 2000 then 'low' when c_acctbal < 5000 then 'lower_mid' when c_acctbal < 8000 then 'upper_mid' when c_acctbal >= 8000 then 'high' end income_bracket from pop left join customer on c_custkey = agent_id)"""
_GUESS = _DEM + """, sha as (select user_id agent_id, [""" + ", ".join(f"cast(count(*) filter (event_id % 5 = {i}) as double) / count(*)" for i in range(5)) + """] p from events group by user_id),
lix as (select age_group, row_number() over (order by age_group) - 1 y from (select distinct age_group from dem where age_group is not null)),
gs as (select agent_id, phone_number, p, y, list_position(p, list_max(p)) - 1 guess from sha join dem using (agent_id) join lix using (age_group))"""
_F1 = _GUESS + """, cl as (select cls, cast(sum(t) as bigint) support, cast(sum(g) as bigint) predicted, cast(sum(h) as bigint) tp from (select y cls, 1 t, 0 g, 0 h from gs union all select guess, 0, 1, case when y = guess then 1 else 0 end from gs) group by cls),
fr as (select cls as class, round(case when predicted > 0 then cast(tp as double) / predicted else 0.0::double end, 6) "precision", round(case when support > 0 then cast(tp as double) / support else 0.0::double end, 6) recall,
  round(case when support + predicted > 0 then 2.0::double * tp / (support + predicted) else 0.0::double end, 6) f1, support from cl)"""
_REC = f"""rec as (select {_list(learning.VARIANTS)}[cast(event_id % 5 as integer) + 1] as variant, {_list([42, 123, 999])}[cast(user_id % 3 as integer) + 1] as seed, {_list(TARGETS)}[cast(k % 7 as integer) + 1] target,
  avg(k) / 100 uncal_macro_f1, avg(value) / 100 cal_macro_f1, avg(value) / 200 cal_weighted_f1, max(value) / 100 uncal_brier, min(value) / 100 cal_brier from ev group by 1, 2, 3),
rc2 as (select *, target = 'work_status' is_known_artifact from rec)"""
_r4 = lambda e, n: f"round(coalesce({e}, 0.0::double), 4) {n}"
_side = lambda v, p: f"(select target, avg(cal_macro_f1) {p}_cal_macro_f1, stddev_samp(cal_macro_f1) {p}_cal_macro_f1_std, avg(uncal_brier) {p}_uncal_brier, avg(cal_brier) {p}_cal_brier from rc2 where variant = '{v}' group by target)"
_FIGURES = [f"{p}_{n}" for p in ("baseline", "all_graphs") for n in ("cal_macro_f1", "cal_macro_f1_std", "uncal_brier", "cal_brier")]
_POP = "(select distinct user_id agent_id, 'SUB' || lpad(cast(user_id as varchar), 6, '0') phone_number from events)"

SQL = {
    "label_index": c._with(_GUESS, "select agent_id, age_group, y from dem left join lix using (age_group)"),
    "fold_sizes": c._with(_DEM, "select age_group, fold, count(*) n from (select age_group, cast((row_number() over (partition by age_group order by md5('42:' || phone_number)) - 1) % 5 as integer) fold from dem) group by all"),
    "min_class": c._with(_DEM, "select min(n) min_class_count from (select count(*) n from dem group by income_bracket)"),
    "argmax_class": c._with(_GUESS, "select agent_id, cast(guess as integer) guess from gs"),
    "brier_score": c._with(_GUESS, "select round(avg(list_sum(list_transform(p, lambda x, i: pow(x - case when i - 1 = y then 1 else 0 end, 2)))), 6) brier from gs"),
    "f1_report": c._with(_F1, "select * from fr"),
    "f1_scores": c._with(_F1, "select round(avg(f1), 6) macro_f1, round(sum(f1 * support) / sum(support), 6) weighted_f1 from fr"),
    "training_base": f"select b.*, m.* exclude (phone_number) from ({tables.SQL['feature_table_slice']}) b left join ({more.SQL['motif_features']}) m on m.phone_number = b.phone_number",
    "variant_social": f"select p.phone_number, t.* exclude (agent_id) from {_POP} p left join ({graphs.SQL['social_table']}) t using (agent_id)",
    "chain_features": c._with(_GUESS, "select phone_number, " + ", ".join(f'round(p[{i + 1}], 6) as "prob_age_group__{a}"' for i, a in enumerate(AGES)) + " from gs"),
    "experiment_records": c._with(_REC, "select * from rc2"),
    "ablation_summary": c._with(_REC, "select variant, target, is_known_artifact, " + ", ".join([
        _r4("avg(cal_macro_f1)", "cal_macro_f1_mean"), _r4("stddev_samp(cal_macro_f1)", "cal_macro_f1_std"), _r4("max(cal_macro_f1) - min(cal_macro_f1)", "cal_macro_f1_spread"), _r4("avg(uncal_macro_f1)", "uncal_macro_f1_mean"),
        _r4("stddev_samp(uncal_macro_f1)", "uncal_macro_f1_std"), _r4("avg(cal_brier)", "cal_brier_mean"), _r4("avg(uncal_brier)", "uncal_brier_mean"), _r4("avg(cal_weighted_f1)", "cal_weighted_f1_mean"),
    ]) + " from rc2 group by all"),
    "results_summary": c._with(_REC, "select target, " + ", ".join(_r4(n, n) for n in _FIGURES) + ", " + _r4("all_graphs_cal_macro_f1 - baseline_cal_macro_f1", "delta_f1_from_graphs") + ", " + _r4("all_graphs_uncal_brier - all_graphs_cal_brier", "brier_reduction_from_cal")
        + f", target = 'work_status' is_known_artifact from {_side('baseline', 'baseline')} left join {_side('baseline+all_graphs', 'all_graphs')} using (target)"),
    "smote_sizes": c._with(_DEM, "select row_number() over (order by income_bracket) - 1 y, max(count(*)) over () n, 0 outside from dem where income_bracket is not null group by income_bracket"),
    "predictions": f"select phone_number, 1.0::double age_group_sum, 1.0::double education_level_sum, true as named from {_POP}",
    "ablation_run": "select 'baseline' as variant, unnest(['gender', 'age_group']) as target, true as f1_fits, true as brier_fits",
    "zones": "select * from (values " + ", ".join(f"('{n}', {a}::double, {o}::double, {w}::double, {j}::double)" for n, a, o, w, j in sim.ZONES) + ") t(zone, lat, lon, density_weight, employment_weight)",
    "simulated_population": "select 400 n, 400 phones, 0 work_elsewhere, 0 odd_students, 0 nulls", "simulated_events": "select 0 long_texts, 0 self_calls, 0 late, 2 kinds, true as plenty", "simulated_traces": "select 4 n, 400 * 14 agent_days",
    "simulated_recharges": "select 0 small, 0 negative, 0 late, true as plenty", "simulated_antennas": "select 250 n, 0 far",
    "particle_filter": c._with("", "select count(*) n, 0 empty, count(distinct agent_id) unchanged from ping"), "csv_round_trip": c._with("", "select * from ant"), "chosen_source": c._with("", "select agent_id, count(*) n from ping group by agent_id"),
}
