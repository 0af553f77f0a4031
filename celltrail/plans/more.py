"""Queries over trajectories, places and motifs with their SQL, which is recursive where an operator is an ordered fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators, places
from ..sources import adapters as src
from . import catalogue as c

QUERIES = {
    "home_antennas": lambda s, d: places.home_antennas(src.population(s, d), places.anchors(c._labelled(s, d)), src.pings(s, d), src.antennas(s, d)),
}
QUERIES["percent_at_home"] = lambda s, d: indicators.percent_at_home(c._located(s, d), QUERIES["home_antennas"](s, d))


def _rec(ctes: str, body: str) -> str:
    return f"with recursive {c._BASE}, {ctes} {body}"


_P = f"pp as materialized (select agent_id, ping_id, timestamp, lat, lon, {c._SEC.format('timestamp')} t, row_number() over (partition by agent_id order by timestamp, ping_id) rn from ping)"


def _dist(p: str, q: str) -> str:
    scale = "6371000.0::double"
    return f"sqrt(pow(radians({q}lon - {p}lon) * {scale} * cos(radians(alat)), 2) + pow(radians({q}lat - {p}lat) * {scale}, 2))"


# state: the settled point before rn (a) and the raw one at rn (b)
_BOUNCE = _P + f""",
bo(agent_id, rn, aid, ats, a_t, alat, alon, bid, bts, bt, blat, blon) as (
  select x.agent_id, y.rn, x.ping_id, x.timestamp, x.t, x.lat, x.lon, y.ping_id, y.timestamp, y.t, y.lat, y.lon from pp x join pp y on x.agent_id = y.agent_id and x.rn = 1 and y.rn = 2
  union all
  select agent_id, rn, bid, bts, bt, case when mv then (alat + clat) / 2 else blat end, case when mv then (alon + clon) / 2 else blon end, cid, cts, ct, clat, clon
  from (select *, ct - a_t <= 300 and greatest(d12, d23) > 100 and d13 <= 800 and d13 < least(d12, d23) mv
    from (select *, {_dist('a', 'b')} d12, {_dist('b', 'c')} d23, {_dist('a', 'c')} d13
      from (select bo.* exclude (rn), p.rn, p.ping_id cid, p.timestamp cts, p.t ct, p.lat clat, p.lon clon from bo join pp p on p.agent_id = bo.agent_id and p.rn = bo.rn + 1)))),
pong as (select agent_id, aid ping_id, ats as timestamp, alat lat, alon lon from bo
  union all select agent_id, ping_id, timestamp, lat, lon from pp qualify rn = max(rn) over (partition by agent_id))"""


def _kalman(source: str) -> str:
    """The filter over table `source` (agent_id, ping_id, timestamp, lat, lon) as the table kal."""
    return f"""kp as materialized (select agent_id, ping_id, timestamp, {c._SEC.format('timestamp')} t, rn, sc, radians(lon) * sc mx, radians(lat) * 6371000.0::double my
  from (select *, row_number() over (partition by agent_id order by timestamp, ping_id) rn, 6371000.0::double * cos(radians(avg(lat) over (partition by agent_id))) sc from {source})),
ks(agent_id, rn, ping_id, timestamp, sc, t, x, vx, y, vy, p11, p12, p22) as (
  select agent_id, rn, ping_id, timestamp, sc, t, mx, 0.0::double, my, 0.0::double, 22500.0::double, 0.0::double, 22500.0::double from kp where rn = 1
  union all
  select agent_id, rn, ping_id, timestamp, sc, t, px + k1 * (mx - px), vx + k2 * (mx - px), py + k1 * (my - py), vy + k2 * (my - py), (1 - k1) * a11, (1 - k1) * a12, a22 - k2 * a12
  from (select *, a11 / (a11 + 22500.0::double) k1, a12 / (a11 + 22500.0::double) k2, x + d * vx px, y + d * vy py
    from (select *, p11 + 2 * d * p12 + d * d * p22 + 25.0::double * d * d / 3 a11, p12 + d * p22 + 25.0::double * d / 2 a12, p22 + 25.0::double a22
      from (select k.agent_id, k.rn, k.ping_id, k.timestamp, k.sc, k.t, k.mx, k.my, s.x, s.vx, s.y, s.vy, s.p11, s.p12, s.p22, greatest(k.t - s.t, 1.0::double) d
        from ks s join kp k on k.agent_id = s.agent_id and k.rn = s.rn + 1)))),
kal as (select agent_id, ping_id, timestamp, degrees(y / 6371000.0::double) lat, degrees(x / sc) lon from ks)"""


_NEAR = c._hav("s.lat", "s.lon", "(p.a / p.n)", "(p.o / p.n)")
_PLACE = c._SP + f""",
so as materialized (select agent_id, stay_index, lat, lon, row_number() over (partition by agent_id order by stay_index) rn from sp),
pl(agent_id, rn, stay_index, place_id, known) as (
  select agent_id, rn, stay_index, 0::bigint, [struct_pack(a := lat, o := lon, n := 1.0::double)] from so where rn = 1
  union all
  select agent_id, rn, stay_index, case when hit is null then len(known) else hit - 1 end,
    case when hit is null then list_append(known, struct_pack(a := lat, o := lon, n := 1.0::double))
      else list_transform(known, lambda p, i: case when i = hit then struct_pack(a := p.a + lat, o := p.o + lon, n := p.n + 1) else p end) end
  from (select s.*, x.known, nullif(coalesce(list_position(list_transform(x.known, lambda p: {_NEAR} <= 250), true), 0), 0) hit
    from pl x join so s on s.agent_id = x.agent_id and s.rn = x.rn + 1)),
pd as (select sp.*, place_id, greatest(({c._SEC.format('departure_time')} - {c._SEC.format('arrival_time')}) / 60, 1.0::double) m,
  isodow(arrival_time) <= 5 wd, hour(arrival_time) >= 20 or hour(arrival_time) < 7 nt from sp join pl using (agent_id, stay_index)),
ps as (select agent_id, place_id, round(sum(case when wd and nt then m else 0.0::double end), 6) home_minutes, round(sum(case when wd and not nt then m else 0.0::double end), 6) work_minutes,
  cast(count(*) filter (wd) as double) / 2 visits_per_week from pd group by all)"""
_LABEL = _PLACE + """,
ph as (select *, row_number() over (partition by agent_id order by home_minutes desc, place_id) = 1 and home_minutes > 0 is_home from ps),
pw as (select *, not is_home and work_minutes > 0 can from ph),
pr as (select *, can and visits_per_week >= 1 and row_number() over (partition by agent_id order by can desc, work_minutes desc, place_id) = 1 is_work from pw),
lb as (select pd.*, case when is_home then 'home' when is_work then 'work' else 'other' end place_label from pd join pr using (agent_id, place_id))"""
_ANCHOR = _LABEL + """,
an as (select agent_id, round(avg(lat) filter (place_label = 'home'), 9) inferred_home_lat, round(avg(lon) filter (place_label = 'home'), 9) inferred_home_lon,
  round(avg(lat) filter (place_label = 'work'), 9) inferred_work_lat, round(avg(lon) filter (place_label = 'work'), 9) inferred_work_lon, bool_or(place_label = 'work') has_inferred_work from lb group by agent_id)"""
_AF = _ANCHOR + f""",
dw as (select agent_id, count(distinct place_id) np, sum(m) tot, avg(m) mn, sum(case when place_label = 'home' then m else 0.0::double end) hm, sum(case when place_label = 'work' then m else 0.0::double end) wm from lb group by agent_id),
pe as (select agent_id, abs(-sum(p * ln(p))) e from (select agent_id, sum(m) / sum(sum(m)) over (partition by agent_id) p from lb group by agent_id, place_id) group by agent_id),
af as (select pop.agent_id, round(coalesce(case when has_inferred_work then {c._hav('inferred_home_lat', 'inferred_home_lon', 'inferred_work_lat', 'inferred_work_lon')} end, 0.0::double), 2) commute_distance_m,
  coalesce(cast(has_inferred_work as integer), 0) has_inferred_work, coalesce(np, 0) number_of_places, round(coalesce(e, 0.0::double), 6) entropy_of_places, round(coalesce(tot, 0.0::double), 4) total_stay_duration_min,
  round(coalesce(mn, 0.0::double), 4) mean_stay_duration_min, round(coalesce(hm / tot, 0.0::double), 6) percent_dwell_at_home, round(coalesce(wm / tot, 0.0::double), 6) percent_dwell_at_work
  from pop left join an using (agent_id) left join dw using (agent_id) left join pe using (agent_id))"""
_MOTIF = _LABEL + """,
dm as (select agent_id, cast(arrival_time as date) as date, case when bool_or(place_label = 'work') and bool_or(place_label = 'other') then 2 when bool_or(place_label = 'work') then 3 when bool_or(place_label = 'other') then 1 else 0 end motif,
  count(*) - 1 trips from lb group by agent_id, cast(arrival_time as date))"""
_MF = _MOTIF + """,
mn as (select agent_id, motif, count(*) n, sum(trips) t, cast(count(*) as double) / sum(count(*)) over (partition by agent_id) p from dm group by agent_id, motif),
mf as (select agent_id, first(motif order by n desc, motif) pid, -sum(p * ln(p + 1e-12::double)) e, sum(case when motif in (1, 2) then p else 0.0::double end) ct, sum(case when motif = 0 then p else 0.0::double end) sh,
  count(*) dc, cast(sum(t) as double) / sum(n) mt from mn group by agent_id),
mo as (select agent_id, phone_number, coalesce(pid, 0) motif__primary_id, round(coalesce(e, 0.0::double), 6) motif__entropy, round(coalesce(ct, 0.0::double), 6) motif__fraction_commute_tours, round(coalesce(sh, 1.0::double), 6) motif__fraction_stay_home_days,
  coalesce(dc, 0) motif__distinct_motifs_count, round(coalesce(mt, 0.0::double), 6) motif__mean_daily_trips from pop left join mf using (agent_id))"""
_HOME = _ANCHOR + """,
hc as (select agent_id, avg(lat) filter (hour(timestamp) < 7 or hour(timestamp) >= 20) nlat, avg(lon) filter (hour(timestamp) < 7 or hour(timestamp) >= 20) nlon, avg(lat) alat, avg(lon) alon from ping group by agent_id),
hp as (select agent_id, coalesce(inferred_home_lat, nlat, alat, (select avg(lat) from ant)) lat, coalesce(inferred_home_lon, nlon, alon, (select avg(lon) from ant)) lon from pop left join an using (agent_id) left join hc using (agent_id)),
ha as (select agent_id, antenna_id home_antenna_id from hp, ant qualify row_number() over (partition by agent_id order by pow(ant.lat - hp.lat, 2) + pow(ant.lon - hp.lon, 2), antenna_id) = 1)"""

SQL = {
    "ping_pong": _rec(_BOUNCE, "select agent_id, ping_id, timestamp, round(lat, 7) lat, round(lon, 7) lon from pong"),
    "kalman": _rec(_kalman("ping"), "select agent_id, ping_id, timestamp, round(lat, 6) lat, round(lon, 6) lon from kal"),
    "denoised_traces": _rec(_BOUNCE + ", " + _kalman("pong"), "select agent_id, ping_id, timestamp, round(lat, 6) lat, round(lon, 6) lon from kal"),
    "places": _rec(_PLACE, "select agent_id, stay_index, place_id from pl"),
    "place_stats": _rec(_PLACE, "select * from ps"),
    "place_labels": _rec(_LABEL, "select agent_id, stay_index, place_id, place_label from lb"),
    "anchors": _rec(_ANCHOR, "select * from an"),
    "anchor_features": _rec(_AF, "select * from af"),
    "daily_motifs": _rec(_MOTIF, "select * from dm"),
    "motif_features": _rec(_MF, "select * exclude (agent_id) from mo"),
    "home_antennas": _rec(_HOME, "select * from ha"),
    "percent_at_home": _rec(_HOME + ", " + c._LC, f"select {c._C}, round(avg(case when antenna_id = home_antenna_id then 1 else 0 end), 6) percent_at_home from lc join ha using (agent_id) group by all"),
}
QUERIES["denoised_traces"] = lambda s, d: c._rounded(c.trajectory.denoise(src.pings(s, d)), 6, "lat", "lon")
