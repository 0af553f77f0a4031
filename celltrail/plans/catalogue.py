"""Registered queries and, for the deterministic ones, SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_m, to_degrees, to_metres
from ..operators import graph, indicators, metrics, places, stays, trajectory
from ..sources import adapters as src

_it = lambda s, d: indicators.interactions(src.communications(s, d))
_stays = lambda s, d: stays.stay_points(src.pings(s, d))
_labelled = lambda s, d: places.label_places(places.places(_stays(s, d)))
_edges = lambda s, d: graph.social_edges(src.communications(s, d), src.population(s, d))


def _located(s, d):
    a = src.antennas(s, d)
    return trajectory.nearest_antenna(src.pings(s, d), a).select("agent_id", "timestamp", "antenna_id").join(a, "antenna_id")


def _rounded(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _haversine(s, d):
    p, a = src.pings(s, d), src.antennas(s, d)
    j = trajectory.nearest_antenna(p, a).join(a.select("antenna_id", F.col("lat").alias("alat"), F.col("lon").alias("alon")), "antenna_id")
    return j.select("ping_id", F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")), 3).alias("distance_m"))


def _planar(s, d):
    x, y = to_metres(F.col("lat"), F.col("lon"), F.lit(12.97))
    p = src.pings(s, d).select("ping_id", x.alias("x"), y.alias("y"))
    lat, lon = to_degrees(F.col("x"), F.col("y"), F.lit(12.97))
    return p.select("ping_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


def _variances(s, d):
    it = indicators.per_contact(_it(s, d)).where("week = 'allweek' and day = 'allday'")
    return metrics.variances(it, ["n", "balance", "duration"])


QUERIES = {
    "interaction_table": lambda s, d: _it(s, d),
    "interaction_counts": lambda s, d: indicators.counts(_it(s, d)),
    "contact_entropy": lambda s, d: indicators.contact_entropy(_it(s, d)),
    "interactions_per_contact": lambda s, d: indicators.interactions_per_contact(_it(s, d)),
    "contact_balance": lambda s, d: indicators.contact_balance(_it(s, d)),
    "pareto_interactions": lambda s, d: _rounded(indicators.pareto_interactions(_it(s, d)), 6, "percent_pareto_interactions"),
    "pareto_durations": lambda s, d: _rounded(indicators.pareto_durations(_it(s, d)), 6, "percent_pareto_durations"),
    "interevent_time": lambda s, d: indicators.interevent_time(_it(s, d)),
    "call_duration_stats": lambda s, d: indicators.call_duration(_it(s, d)),
    "text_response": lambda s, d: indicators.text_response(_it(s, d)),
    "conversations": lambda s, d: indicators.conversations(_it(s, d)),
    "active_days": lambda s, d: indicators.active_days(_it(s, d)),
    "recharge_stats": lambda s, d: indicators.recharge_stats(src.recharges(s, d)),
    "pareto_recharges": lambda s, d: _rounded(indicators.pareto_recharges(src.recharges(s, d)), 6, "percent_pareto_recharges"),
    "churn": lambda s, d: indicators.churn(_it(s, d)),
    "avg_balance": lambda s, d: indicators.average_balance(src.recharges(s, d)),
    "n_records": lambda s, d: indicators.records(_it(s, d), src.recharges(s, d)),
    "antenna_assign": lambda s, d: trajectory.nearest_antenna(src.pings(s, d), src.antennas(s, d)).select("ping_id", "antenna_id"),
    "antenna_entropy": lambda s, d: indicators.antenna_entropy(_located(s, d)),
    "frequent_antennas": lambda s, d: indicators.frequent_antennas(_located(s, d)),
    "radius_of_gyration": lambda s, d: indicators.radius_of_gyration(_located(s, d)),
    "haversine": _haversine,
    "planar_projection": _planar,
    "candidate_stays": lambda s, d: _rounded(stays.candidate_stays(src.pings(s, d)), 6, "lat", "lon"),
    "stay_clusters": lambda s, d: _rounded(stays.stay_clusters(stays.candidate_stays(src.pings(s, d))), 6, "lat", "lon"),
    "stay_points": lambda s, d: _rounded(_stays(s, d), 6, "lat", "lon"),
    "ping_pong": lambda s, d: _rounded(trajectory.ping_pong(src.pings(s, d)), 7, "lat", "lon"),
    "kalman": lambda s, d: _rounded(trajectory.kalman(src.pings(s, d)), 6, "lat", "lon"),
    "places": lambda s, d: places.places(_stays(s, d)).select("agent_id", "stay_index", "place_id"),
    "place_stats": lambda s, d: places.place_stats(places.places(_stays(s, d))),
    "place_labels": lambda s, d: _labelled(s, d).select("agent_id", "stay_index", "place_id", "place_label"),
    "anchors": lambda s, d: places.anchors(_labelled(s, d)),
    "anchor_features": lambda s, d: places.anchor_features(_labelled(s, d), src.population(s, d)),
    "daily_motifs": lambda s, d: places.daily_motifs(_labelled(s, d)),
    "motif_features": lambda s, d: places.motif_features(_labelled(s, d), src.population(s, d)),
    "social_edges": _edges,
    "degree_strength": lambda s, d: graph.degree_strength(_edges(s, d), src.population(s, d)),
    "reciprocity": lambda s, d: graph.reciprocity(_edges(s, d), src.population(s, d)),
    "clustering": lambda s, d: graph.clustering(_edges(s, d), src.population(s, d)),
    "neighbor_stats": lambda s, d: graph.neighbour_stats(_edges(s, d), src.population(s, d), indicators.records(_it(s, d), src.recharges(s, d)), "number_of_records"),
    "coloc_pairs": lambda s, d: graph.colocation_pairs(_stays(s, d)),
    "variance_filter": _variances,
}

# ---- SQL --------------------------------------------------------------------------------------------------------

_BASE = """ev as (select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) k, isodow(ts) dow, hour(ts) h from events),
n as (select max(user_id) + 1 nu from events),
comm as (select event_id, user_id caller_id, case when event_id % 5 = 0 then (user_id + 3) % nu else (user_id - user_id % 3) + (user_id % 3 + 1 + event_id % 2) % 3 end callee_id,
  ts as timestamp, case when event_type in ('click', 'view') then 'call' else 'text' end event_type,
  case when event_type in ('click', 'view') then cast(floor(value) as bigint) else 0 end duration_sec from ev, n where event_type <> 'purchase'),
rech as (select event_id, user_id agent_id, ts as timestamp, value amount, value * 0.5 balance_after from ev where event_type = 'purchase'),
ping as (select event_id * 3 + j ping_id, user_id agent_id, ts + j * interval 60 second as timestamp,
  cast(12.90 as double) + ((user_id * 17 + z * 29) % 40) * cast(0.005 as double) + (k - 50) * cast(0.000002 as double) + (case when j = 1 then cast(0.004 as double) else cast(0 as double) end) lat,
  cast(77.50 as double) + ((user_id * 23 + z * 31) % 40) * cast(0.006 as double) + ((event_id % 100) - 50) * cast(0.000002 as double) lon
  from (select *, case when h < 7 or h >= 20 then 0 when dow <= 5 then 1 + (case when k < 15 then 1 else 0 end) else k % 3 end z from ev), (values (0), (1), (2)) t(j) where j = 0 or k < 20),
ant as (select cast(s_suppkey as bigint) antenna_id, cast(12.90 as double) + ((s_suppkey * 37) % 100) * cast(0.002 as double) lat, cast(77.50 as double) + ((s_suppkey * 61) % 100) * cast(0.0024 as double) lon from supplier),
pop as (select distinct user_id agent_id, 'SUB' || lpad(cast(user_id as varchar), 6, '0') phone_number from events),
it as (select caller_id agent_id, callee_id contact_id, 'out' direction, event_id, timestamp, event_type, duration_sec from comm
  union all select callee_id, caller_id, 'in', event_id, timestamp, event_type, duration_sec from comm),
wk as (select unnest(['allweek', 'weekday', 'weekend']) as week), dy as (select unnest(['allday', 'day', 'night']) as day)"""
_FIT = "(week = 'allweek' or week = case when isodow(timestamp) <= 5 then 'weekday' else 'weekend' end) and (day = 'allday' or day = case when hour(timestamp) >= 7 and hour(timestamp) < 19 then 'day' else 'night' end)"
_IC = f"ic as (select it.*, week, day from it, wk, dy where {_FIT})"
_RC = f"rc as (select rech.*, week, day from rech, wk, dy where {_FIT})"
_PC = _IC + ", pc as (select agent_id, week, day, event_type, contact_id, count(*) n, sum(case when direction = 'out' then 1 else -1 end) / count(*) balance, sum(duration_sec) duration from ic group by all)"
_C, _K = "agent_id, week, day", "agent_id, week, day, event_type"


def _with(ctes, body):
    return f"with {_BASE}, {ctes} {body}" if ctes else f"with {_BASE} {body}"


def _summary(source, keys, v, p, more=""):
    m = f"select *, {v} as v, avg({v}) over (partition by {keys}) as m from {source}"
    r = lambda e, name: f"round(coalesce({e}, 0.0), 6) as {p}__{name}"
    flat = "case when min(v) = max(v) or count(v) = 0 then 0.0 else {} end"
    return f"select {keys}, {more} " + ", ".join([
        r("avg(v)", "mean"), r("stddev_samp(v)", "std"), r("median(cast(v as double))", "median"),
        r(flat.format("avg(pow(v - m, 3)) / nullif(pow(avg(pow(v - m, 2)), 1.5), 0)"), "skewness"),
        r(flat.format("avg(pow(v - m, 4)) / nullif(pow(avg(pow(v - m, 2)), 2), 0) - 3"), "kurtosis"), r("cast(min(v) as double)", "min"), r("cast(max(v) as double)", "max"),
    ]) + f" from ({m}) group by {keys}"


def _pareto(source, keys, v, name):
    return (
        f"select {keys}, round(case when max(tot) > 0 then cast(1 + count(*) filter (run < 0.8::double * tot) as double) / count(*) else 0.0 end, 6) as {name} from (select *, "
        f"sum({v}) over (partition by {keys}) tot, sum({v}) over (partition by {keys} order by {v} desc rows unbounded preceding) run from {source}) group by {keys}"
    )


def _entropy(source, keys, v, name):
    return f"select {keys}, round(abs(-sum(p * ln(p))), 6) as {name} from (select *, cast({v} as double) / sum({v}) over (partition by {keys}) p from {source} where {v} > 0) group by {keys}"


_HAV = "2 * 6371000.0::double * atan2(sqrt({a}), sqrt(1 - {a}))"


def _hav(lat1, lon1, lat2, lon2):
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


_SEC = "(epoch_us({}) / 1000000.0::double)"
_RUNS = f"""st as (select *, lag(lat) over w plat, lag(lon) over w plon from ping window w as (partition by agent_id order by timestamp, ping_id)),
runs as (select *, sum(case when {_hav('plat', 'plon', 'lat', 'lon')} >= 200 then 1 else 0 end) over (partition by agent_id order by timestamp, ping_id rows unbounded preceding) run_id from st),
cand as (select agent_id, cast(run_id as bigint) run_id, min(timestamp) arrival_time, max(timestamp) departure_time, avg(lat) lat, avg(lon) lon, count(*) n_points
  from runs group by agent_id, run_id having {_SEC.format('max(timestamp)')} - {_SEC.format('min(timestamp)')} > 1200)"""
_CLUS = _RUNS + """, cell as (select *, floor(lat * 111320 / 200) r, floor(lon * 111320 * cos(radians(first(lat) over (partition by agent_id order by run_id))) / 200) c from cand),
merged as (select agent_id, r, c, min(run_id) fr, min(arrival_time) arrival_time, max(departure_time) departure_time, avg(lat) lat, avg(lon) lon, cast(sum(n_points) as bigint) n_points from cell group by agent_id, r, c),
clus as (select agent_id, arrival_time, departure_time, lat, lon, n_points, cast(row_number() over (partition by agent_id order by fr) as bigint) stay_index from merged)"""
_SP = _CLUS + f""", lft as (select * from runs where not exists (select 1 from cand where cand.agent_id = runs.agent_id and cand.run_id = runs.run_id)),
snap as (select agent_id, ping_id, timestamp, stay_index from (select l.agent_id, l.ping_id, l.timestamp, s.stay_index, {_hav('l.lat', 'l.lon', 's.lat', 's.lon')} dd from lft l join clus s on l.agent_id = s.agent_id)
  where dd < 200 qualify row_number() over (partition by ping_id order by dd, stay_index) = 1),
more as (select agent_id, stay_index, count(*) m, min(timestamp) lo, max(timestamp) hi from snap group by all),
sp as (select c.agent_id, c.stay_index, least(arrival_time, coalesce(lo, arrival_time)) arrival_time, greatest(departure_time, coalesce(hi, departure_time)) departure_time, lat, lon, n_points + coalesce(m, 0) n_points
  from clus c left join more using (agent_id, stay_index))"""
_LOC = """pa as (select p.ping_id, p.agent_id, p.timestamp, p.lat plat, p.lon plon, a.* from ping p, ant a qualify row_number() over (partition by p.ping_id order by pow(a.lat - p.lat, 2) + pow(a.lon - p.lon, 2), a.antenna_id) = 1)"""
_LC = _LOC + f", lc as (select agent_id, timestamp, antenna_id, lat, lon, week, day from pa, wk, dy where {_FIT}), au as (select {_C}, antenna_id, count(*) n from lc group by all)"
_ED = "ed as (select caller_id src, callee_id dst, count(*) weight from comm where caller_id in (select agent_id from pop) and callee_id in (select agent_id from pop) group by all)"
_NB = _ED + ", nb as (select src a, dst b from ed where src <> dst union select dst, src from ed where src <> dst)"

SQL = {
    "interaction_table": _with("", "select * from it"),
    "interaction_counts": _with(_IC, f"""select {_K}, count(*) number_of_interactions, count(*) filter (direction = 'in') number_of_interactions_in, count(*) filter (direction = 'out') number_of_interactions_out,
      count(distinct contact_id) number_of_contacts, case when event_type = 'call' then round(cast(count(*) filter (direction = 'out') as double) / count(*), 6) end percent_initiated,
      round(avg(case when hour(timestamp) < 7 or hour(timestamp) >= 19 then 1 else 0 end), 6) percent_nocturnal from ic group by {_K}"""),
    "contact_entropy": _with(_PC, _entropy("pc", _K, "n", "entropy_of_contacts")),
    "interactions_per_contact": _with(_PC, _summary("pc", _K, "n", "interactions_per_contact")),
    "contact_balance": _with(_PC, _summary("pc", _K, "balance", "balance_of_contacts")),
    "pareto_interactions": _with(_PC, _pareto("pc", _K, "n", "percent_pareto_interactions")),
    "pareto_durations": _with(_PC, _pareto("(select * from pc where event_type = 'call')", _K, "duration", "percent_pareto_durations")),
    "interevent_time": _with(_IC + f", g as (select *, {_SEC.format('timestamp')} - lag({_SEC.format('timestamp')}) over (partition by {_K} order by timestamp, event_id, direction) gap from ic)", _summary("g", _K, "gap", "interevent_time")),
    "call_duration_stats": _with(_IC, _summary("(select * from ic where event_type = 'call')", _C, "duration_sec", "call_duration")),
    "text_response": _with(_IC + f""", t as (select *, min(case when direction = 'out' then {_SEC.format('timestamp')} end) over (partition by {_C}, contact_id order by timestamp, event_id rows between 1 following and unbounded following) - {_SEC.format('timestamp')} dl from ic where event_type = 'text'),
      u as (select *, case when dl <= 3600 then dl end delay from t where direction = 'in')""", _summary("u", _C, "delay", "response_delay_text", "round(cast(count(v) as double) / count(*), 6) as response_rate_text,")),
    "conversations": _with(_IC + f", s as (select *, lag({_SEC.format('timestamp')}) over (partition by {_C}, contact_id order by timestamp, event_id, direction) b from ic)", f"select {_C}, round(avg(case when direction = 'out' then 1 else 0 end), 6) percent_initiated_conversations from s where b is null or {_SEC.format('timestamp')} - b > 3600 group by all"),
    "active_days": _with(_IC, f"select {_C}, count(distinct cast(timestamp as date)) active_days from ic group by all"),
    "recharge_stats": _with(_RC + f", g as (select *, ({_SEC.format('timestamp')} - lag({_SEC.format('timestamp')}) over (partition by {_C} order by timestamp, event_id)) / 86400 gap from rc)",
      f"select * from ({_summary('g', _C, 'amount', 'amount_recharges', 'count(*) as number_of_recharges,')}) join ({_summary('g', _C, 'gap', 'interevent_time_recharges')}) using ({_C})"),
    "pareto_recharges": _with(_RC, _pareto("rc", _C, "amount", "percent_pareto_recharges")),
    "churn": _with(f"""w as (select agent_id, floor(floor(({_SEC.format('timestamp')} - min({_SEC.format('timestamp')}) over (partition by agent_id)) / 86400) / 7) wk from it), c as (select agent_id, wk, count(*) n from w group by all),
      r as (select agent_id, cast(n - lag(n) over (partition by agent_id order by wk) as double) / lag(n) over (partition by agent_id order by wk) ch from c)""",
      "select agent_id, round(coalesce(avg(ch), 0.0), 6) churn_rate__mean, round(coalesce(stddev_samp(ch), 0.0), 6) churn_rate__std from r group by agent_id"),
    "avg_balance": _with("", "select agent_id, round(avg(balance_after), 6) average_balance_recharges from rech group by all"),
    "n_records": _with("", "select agent_id, count(*) number_of_records from (select agent_id from it union all select agent_id from rech) group by all"),
    "antenna_assign": _with(_LOC, "select ping_id, antenna_id from pa"),
    "antenna_entropy": _with(_LC, f"select * from ({_entropy('au', _C, 'n', 'entropy_of_antennas')}) join (select {_C}, count(*) number_of_antennas from au group by all) using ({_C})"),
    "frequent_antennas": _with(_LC, f"select {_C}, greatest(cast(trunc((cast(k as double) / c) * c) as bigint), 1) frequent_antennas from (select {_C}, 1 + count(*) filter (run < 0.8::double * tot) k, count(*) c from (select *, sum(n) over (partition by {_C}) tot, sum(n) over (partition by {_C} order by n desc rows unbounded preceding) run from au) group by all)"),
    "radius_of_gyration": _with(_LC, f"select {_C}, round(111000 * sqrt(var_pop(lat) + var_pop(lon)), 3) radius_of_gyration from lc group by all"),
    "haversine": _with(_LOC, f"select ping_id, round({_hav('plat', 'plon', 'lat', 'lon')}, 3) distance_m from pa"),
    "planar_projection": _with("p as (select ping_id, radians(lon) * 6371000.0::double * cos(radians(12.97::double)) x, radians(lat) * 6371000.0::double y from ping)", "select ping_id, round(x, 3) x, round(y, 3) y, round(degrees(y / 6371000.0::double), 8) lat, round(degrees(x / (6371000.0::double * cos(radians(12.97::double)))), 8) lon from p"),
    "candidate_stays": _with(_RUNS, "select * replace (round(lat, 6) as lat, round(lon, 6) as lon) from cand"),
    "stay_clusters": _with(_CLUS, "select * replace (round(lat, 6) as lat, round(lon, 6) as lon) from clus"),
    "stay_points": _with(_SP, "select * replace (round(lat, 6) as lat, round(lon, 6) as lon) from sp"),
    "social_edges": _with(_ED, "select * from ed"),
    "degree_strength": _with(_ED + ", e as (select src agent_id, 1 o, weight w from ed union all select dst, 0, weight from ed), g as (select agent_id, sum(1 - o) a, sum(o) b, count(*) c, sum((1 - o) * w) d, sum(o * w) e, sum(w) f from e group by all)",
      "select agent_id, cast(coalesce(a, 0) as bigint) in_degree, cast(coalesce(b, 0) as bigint) out_degree, cast(coalesce(c, 0) as bigint) total_degree, cast(coalesce(d, 0) as bigint) in_strength, cast(coalesce(e, 0) as bigint) out_strength, cast(coalesce(f, 0) as bigint) total_strength from pop left join g using (agent_id)"),
    "reciprocity": _with(_ED + ", m as (select a.src agent_id, count(*) m from ed a join ed b on a.src = b.dst and a.dst = b.src group by all), t as (select agent_id, count(*) t from (select src agent_id from ed union all select dst from ed) group by all)",
      "select agent_id, round(case when t > 0 then 2.0::double * coalesce(m, 0) / t else 0.0 end, 6) reciprocity from pop left join m using (agent_id) left join t using (agent_id)"),
    "clustering": _with(_NB + ", d as (select a agent_id, count(*) d from nb group by all), t as (select x.a agent_id, count(*) t from nb x join nb y on x.a = y.a and x.b < y.b join nb z on z.a = x.b and z.b = y.b group by all)",
      "select agent_id, round(case when d > 1 then 2.0::double * coalesce(t, 0) / (d * (d - 1)) else 0.0 end, 6) clustering from pop left join d using (agent_id) left join t using (agent_id)"),
    "neighbor_stats": _with(_NB + ", f as (select agent_id b, count(*) v from (select agent_id from it union all select agent_id from rech) group by all), s as (select a agent_id, avg(v) m, stddev_pop(v) sd from nb join f using (b) group by all)",
      "select agent_id, round(coalesce(m, 0.0), 6) neighbor_mean_number_of_records, round(coalesce(sd, 0.0), 6) neighbor_std_number_of_records from pop left join s using (agent_id)"),
    "coloc_pairs": _with(_SP + ", b as (select distinct agent_id, floor(lon * 111320 / 300) gx, floor(lat * 111320 / 300) gy, date_trunc('hour', arrival_time) hr from sp)", "select x.agent_id a, y.agent_id b, count(*) weight from b x join b y on x.gx = y.gx and x.gy = y.gy and x.hr = y.hr and x.agent_id < y.agent_id group by all"),
    "variance_filter": _with(_PC + ", q as (select * from pc where week = 'allweek' and day = 'allday'), v as (select unnest(['n', 'balance', 'duration']) feature, unnest([var_pop(n), var_pop(balance), var_pop(duration)]) variance from q)", "select feature, round(variance, 4) variance, variance > 1e-5 kept from v"),
}
