"""Queries over the three subscriber graphs with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, indicators, places
from ..sources import adapters as src
from . import catalogue as c
from . import more, tables

ROUNDS = 10  # of PageRank, here and in the SQL


def features(s, d):
    """agent_id and the six indicators that the graphs use, without the rest of the wide table."""
    pop, whole = src.population(s, d), "week = 'allweek' and day = 'allday'"
    rows = places.anchor_features(c._labelled(s, d), pop).select("agent_id", "commute_distance_m", "entropy_of_places", "number_of_places")
    located, comm = c._located(s, d), c._it(s, d)
    parts = [
        (indicators.radius_of_gyration(located).where(whole), "radius_of_gyration", "radius_of_gyration__allweek__allday"),
        (indicators.counts(comm).where(whole).where("event_type = 'call'"), "number_of_interactions", "number_of_interactions__allweek__allday__call"),
        (indicators.recharge_stats(src.recharges(s, d)).where(whole), "amount_recharges__mean", "amount_recharges__allweek__allday__mean"),
    ]
    for frame, name, out in parts:
        rows = rows.join(frame.select("agent_id", F.col(name).cast("double").alias(out)), "agent_id", "left")
    return graph.cut(rows.fillna(0))


def _knn_split(s, d):
    f = features(s, d)
    return graph.MobilityKnn().fit(f.where("agent_id % 5 <> 0")).transform(f.where("agent_id % 5 = 0"))


QUERIES = {
    "pagerank": lambda s, d: graph.pagerank(c._edges(s, d), src.population(s, d), iterations=ROUNDS, tolerance=None),
    "graph_inputs": features,
    "social_table": lambda s, d: graph.social_features(c._edges(s, d), src.population(s, d), features(s, d), ROUNDS, None),
    "colocation_table": lambda s, d: graph.colocation_features(graph.colocation_pairs(c._stays(s, d)), src.population(s, d), features(s, d)),
    "mobility_table": lambda s, d: (lambda f: graph.MobilityKnn().fit(f).transform(f, is_train=True))(features(s, d)),
    "mobility_table_held_out": _knn_split,
    "graph_table": lambda s, d: graph.graph_table(c._edges(s, d), graph.colocation_pairs(c._stays(s, d)), src.population(s, d), features(s, d), ROUNDS, None),
}

# ---- SQL --------------------------------------------------------------------------------------------------------

_PR = c._ED + """, nn as (select count(*) n from pop), tw as (select src, sum(weight) total from ed group by src),
sh as materialized (select ed.src, dst, cast(weight as double) / total share from ed join tw using (src)),
r0 as (select agent_id, cast(1.0 as double) / n r from pop, nn)""" + "".join(f""",
r{i} as materialized (select agent_id, 0.85::double * (coalesce(s, 0.0::double) + (select coalesce(sum(r), 0.0::double) from r{i - 1} where agent_id not in (select src from sh)) / n) + (1 - 0.85::double) / n r
  from r{i - 1} left join (select dst agent_id, sum(r * share) s from sh join r{i - 1} on agent_id = src group by dst) using (agent_id), nn)""" for i in range(1, ROUNDS + 1)) + f""",
pr_ as (select agent_id, round(r, 9) pagerank from r{ROUNDS})"""


def _whole(name: str) -> str:
    return f"(select * from ({(c.SQL | more.SQL | tables.SQL)[name]}))"


_SHORT = [n.split("__")[0] for n in graph.NEIGHBOUR_FEATURES]
_INPUTS = f"""fi as materialized (select agent_id, commute_distance_m, entropy_of_places, coalesce(radius_of_gyration, 0.0::double) radius_of_gyration, coalesce(number_of_interactions, 0) * 1.0::double number_of_interactions,
  coalesce(amount_recharges__mean, 0.0::double) amount_recharges, number_of_places
  from {_whole('anchor_features')} left join (select agent_id, radius_of_gyration from {_whole('radius_of_gyration')} where week = 'allweek' and day = 'allday') using (agent_id)
  left join (select agent_id, number_of_interactions from {_whole('interaction_counts')} where week = 'allweek' and day = 'allday' and event_type = 'call') using (agent_id)
  left join (select agent_id, amount_recharges__mean from {_whole('recharge_stats')} where week = 'allweek' and day = 'allday') using (agent_id))"""


def _around(prefix: str, links: str) -> str:
    """Means and stds of the five features over the table `links` (v, w)."""
    parts = ", ".join(f"round(avg({n}) + 1e-9, 6) {prefix}__neighbor_{n}_mean, round(stddev_pop({n}) + 1e-9, 6) {prefix}__neighbor_{n}_std" for n in _SHORT)
    return f"(select v agent_id, {parts} from {links} join fi on fi.agent_id = w group by v)"


def _zeros(prefix: str) -> str:
    return ", ".join(f"coalesce({prefix}__neighbor_{n}_{k}, 0.0::double) {prefix}__neighbor_{n}_{k}" for n in _SHORT for k in ("mean", "std"))


_SOCIAL = _INPUTS + f""", sdeg as {_whole('degree_strength')}, sclu as {_whole('clustering')}, srec as {_whole('reciprocity')}, spr as (with {c._BASE}, {_PR} select * from pr_),
sedge as {_whole('social_edges')}, slink as (select src v, dst w from sedge where src <> dst union select dst, src from sedge where src <> dst),
social as (select agent_id, total_degree graph_social__degree, in_degree graph_social__in_degree, out_degree graph_social__out_degree, cast(total_strength as double) graph_social__strength, cast(in_strength as double) graph_social__in_strength,
  cast(out_strength as double) graph_social__out_strength, clustering graph_social__clustering, pagerank graph_social__pagerank, reciprocity graph_social__reciprocity, {_zeros('graph_social')}
  from sdeg join sclu using (agent_id) join srec using (agent_id) join spr using (agent_id) left join {_around('graph_social', 'slink')} using (agent_id))"""


def _coefficients(name: str, links: str, of: str) -> str:
    """Clustering of the undirected graph `links` (v, w, both ways) as the table `name` over the vertices of `of`."""
    return f"""{name}_d as (select v agent_id, count(*) d from {links} group by v), {name}_t as (select x.v agent_id, count(*) t from {links} x join {links} y on x.v = y.v and x.w < y.w join {links} z on z.v = x.w and z.w = y.w group by x.v),
{name} as (select agent_id, round(case when d > 1 then 2.0::double * coalesce(t, 0) / (d * (d - 1)) else 0.0::double end, 6) clustering from {of} left join {name}_d using (agent_id) left join {name}_t using (agent_id))"""


_COLOC = _INPUTS + f""", cpair as {_whole('coloc_pairs')}, clink as (select a v, b w, weight from cpair union all select b, a, weight from cpair), {_coefficients('cclu', 'clink', 'fi')},
coloc as (select agent_id, coalesce(d, 0) graph_colocation__degree, coalesce(s, 0.0::double) graph_colocation__strength, clustering graph_colocation__clustering, {_zeros('graph_colocation')}
  from fi join cclu using (agent_id) left join (select v agent_id, count(*) d, cast(sum(weight) as double) s from clink group by v) using (agent_id) left join {_around('graph_colocation', 'clink')} using (agent_id))"""


def _knn(train: str, test: str, prefix: str, base: str) -> str:
    cols = ["commute_distance_m", "cast(number_of_places as double)", "entropy_of_places", "radius_of_gyration"]
    stats = ", ".join(f"avg({x}) m{i}, stddev_pop({x}) s{i}" for i, x in enumerate(cols))
    scaled = ", ".join(f"({x} - m{i}) / case when s{i} > 0 then s{i} else 1 end x{i}" for i, x in enumerate(cols))
    dist = "sqrt(" + " + ".join(f"pow(q.x{i} - t.x{i}, 2)" for i in range(4)) + ")"
    near = lambda q: f"select v, w, dist from (select q.agent_id v, t.agent_id w, {dist} dist from kx q, kx t where {q} and t.agent_id in (select agent_id from fi where {train}) and q.agent_id <> t.agent_id) qualify row_number() over (partition by v order by dist, w) <= 5"
    return base + f""", kst as (select {stats} from fi where {train}), kx as materialized (select agent_id, {scaled} from fi, kst),
knn as materialized ({near(f'q.agent_id in (select agent_id from fi where {train})')}), kq as materialized ({near(f'q.agent_id in (select agent_id from fi where {test})') if test != train else 'select * from knn'}),
klink as (select v, w from knn union select w, v from knn), kfit as (select agent_id from fi where {train}), {_coefficients('kclu', 'klink', 'kfit')},
mob as (select agent_id, coalesce(d, 0) graph_mobility__degree, coalesce(s, 0.0::double) graph_mobility__strength, coalesce(cl, 0.0::double) graph_mobility__clustering, {_zeros('graph_mobility')}
  from (select agent_id from fi where {test}) left join (select v agent_id, count(*) d, round(sum(1 / (1 + dist)), 6) s, round(avg(clustering), 6) cl from kq join kclu on kclu.agent_id = w group by v) using (agent_id)
  left join {_around('graph_mobility', 'kq')} using (agent_id))"""


_MOB = _knn("true", "true", "graph_mobility", _INPUTS)
SQL = {
    "pagerank": c._with(_PR, "select * from pr_"),
    "graph_inputs": f"""with {_INPUTS} select agent_id, commute_distance_m, entropy_of_places, radius_of_gyration radius_of_gyration__allweek__allday, number_of_interactions number_of_interactions__allweek__allday__call,
      amount_recharges amount_recharges__allweek__allday__mean, number_of_places from fi""",
    "social_table": f"with {_SOCIAL} select * from social",
    "colocation_table": f"with {_COLOC} select * from coloc",
    "mobility_table": f"with {_MOB} select * from mob",
    "mobility_table_held_out": f"with {_knn('agent_id % 5 <> 0', 'agent_id % 5 = 0', 'graph_mobility', _INPUTS)} select * from mob",
    "graph_table": f"with {_SOCIAL}, {_COLOC[len(_INPUTS) + 2:]}, {_MOB[len(_INPUTS) + 2:]}, pop9 as (select distinct user_id agent_id, 'SUB' || lpad(cast(user_id as varchar), 6, '0') phone_number from events) select * exclude (agent_id) from pop9 join social using (agent_id) join coloc using (agent_id) join mob using (agent_id)",
}
