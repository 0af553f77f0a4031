"""Queries that assemble the wide tables, with SQL for slices of them."""

from __future__ import annotations

from ..functions.durable import cut
from ..operators import places, wide
from ..sources import adapters as src
from . import catalogue as c
from . import more


def wide_rows(s, d):
    """All indicators in long form; what several of them read is written once."""
    it, rech, pop = c._it(s, d), src.recharges(s, d), src.population(s, d)
    located, labelled = cut(c._located(s, d)), cut(c._labelled(s, d))
    homes = cut(places.home_antennas(pop, places.anchors(labelled), src.pings(s, d), src.antennas(s, d)))
    return wide.indicator_rows(it, rech, located, homes).unionByName(wide.whole_rows(it, rech, places.anchor_features(labelled, pop)))


def feature_table(s, d):
    return wide.feature_table(src.population(s, d), wide_rows(s, d))


#: The columns that the graph features and the tests use.
SLICE = {
    "reporting__number_of_records": True, "active_days__weekday__night__callandtext": True, "number_of_interactions__allweek__allday__call": True, "number_of_interactions__weekend__night__text": True,
    "number_of_contacts__weekday__day__text": True, "percent_initiated_interactions__allweek__night__call": False, "entropy_of_contacts__allweek__allday__call": False,
    "interactions_per_contact__weekend__allday__text__mean": False, "interactions_per_contact__weekend__allday__text__std": False, "amount_recharges__allweek__allday__mean": False, "number_of_antennas__weekend__day": True,
    "radius_of_gyration__allweek__allday": False, "percent_at_home__weekday__night": False, "churn_rate__mean": False, "average_balance_recharges": False, "commute_distance_m": False, "number_of_places": True,
    "entropy_of_places": False, "has_inferred_work": True,
}

QUERIES = {
    "feature_table": lambda s, d: feature_table(s, d),
    "feature_names": lambda s, d: s.createDataFrame([(n, "BIGINT" if k else "DOUBLE") for n, k in wide.columns().items()], "name string, type string"),
    "agent_row": lambda s, d: wide.agent_features(wide_rows(s, d), src.population(s, d), 7, SLICE),
    "feature_table_slice": lambda s, d: wide.feature_table(src.population(s, d), wide_rows(s, d), SLICE),
}
SQL: dict[str, str] = {}

_Z = "coalesce({}, {}) as {}"


def _slice_sql() -> str:
    """Each column as a query of its own, joined to the population."""
    k = c.SQL
    cell = lambda w, y, ch="": f"week = '{w}' and day = '{y}'" + (f" and event_type = '{ch}'" if ch else "")
    whole = {"radius_of_gyration", "antenna_entropy", "active_days", "interaction_counts", "contact_entropy", "interactions_per_contact", "recharge_stats", "n_records", "churn", "avg_balance"}
    tables = {n: f"{n}_t as materialized ({k[n]})" for n in sorted(whole)}
    tables["percent_at_home"] = f"percent_at_home_t as materialized ({more.SQL['percent_at_home']})"
    tables["anchor_features"] = f"anchor_features_t as materialized ({more.SQL['anchor_features']})"
    pick = {
        "reporting__number_of_records": ("n_records", "number_of_records", "true"), "active_days__weekday__night__callandtext": ("active_days", "active_days", cell("weekday", "night")),
        "number_of_interactions__allweek__allday__call": ("interaction_counts", "number_of_interactions", cell("allweek", "allday", "call")),
        "number_of_interactions__weekend__night__text": ("interaction_counts", "number_of_interactions", cell("weekend", "night", "text")),
        "number_of_contacts__weekday__day__text": ("interaction_counts", "number_of_contacts", cell("weekday", "day", "text")),
        "percent_initiated_interactions__allweek__night__call": ("interaction_counts", "percent_initiated", cell("allweek", "night", "call")),
        "entropy_of_contacts__allweek__allday__call": ("contact_entropy", "entropy_of_contacts", cell("allweek", "allday", "call")),
        "interactions_per_contact__weekend__allday__text__mean": ("interactions_per_contact", "interactions_per_contact__mean", cell("weekend", "allday", "text")),
        "interactions_per_contact__weekend__allday__text__std": ("interactions_per_contact", "interactions_per_contact__std", cell("weekend", "allday", "text")),
        "amount_recharges__allweek__allday__mean": ("recharge_stats", "amount_recharges__mean", cell("allweek", "allday")), "number_of_antennas__weekend__day": ("antenna_entropy", "number_of_antennas", cell("weekend", "day")),
        "radius_of_gyration__allweek__allday": ("radius_of_gyration", "radius_of_gyration", cell("allweek", "allday")), "percent_at_home__weekday__night": ("percent_at_home", "percent_at_home", cell("weekday", "night")),
        "churn_rate__mean": ("churn", "churn_rate__mean", "true"), "average_balance_recharges": ("avg_balance", "average_balance_recharges", "true"), "commute_distance_m": ("anchor_features", "commute_distance_m", "true"),
        "number_of_places": ("anchor_features", "number_of_places", "true"), "entropy_of_places": ("anchor_features", "entropy_of_places", "true"), "has_inferred_work": ("anchor_features", "has_inferred_work", "true"),
    }
    joins = " ".join(f"left join (select agent_id, {col} as v{i} from {t}_t where {w}) j{i} using (agent_id)" for i, (t, col, w) in enumerate(pick[n] for n in SLICE))
    cols = ", ".join(_Z.format(f"cast(v{i} as {'bigint' if SLICE[n] else 'double'})", "0", n) for i, n in enumerate(SLICE))
    return f"with {', '.join(tables.values())}, pop0 as (select distinct user_id agent_id, 'SUB' || lpad(cast(user_id as varchar), 6, '0') phone_number from events) select phone_number, {cols} from pop0 {joins}"


SQL["feature_table_slice"] = _slice_sql()


def _names_sql() -> str:
    """The names by their rule: metrics x cells."""
    stats = "unnest(['mean', 'std', 'median', 'skewness', 'kurtosis', 'min', 'max']) st"
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    plain = [m for m, _ in wide.PER_CHANNEL]
    counts = [m for m, k in wide.PER_CHANNEL if k] + [m for m, _, k in wide.PER_CELL if k]
    rest = [f"('{m}', '{r}')" for m, r, _ in wide.PER_CELL]
    more_stats = [f"('{m}', '{r}')" for m, r in wide.PER_CELL_STATS]
    whole = [n for n, _ in wide.WHOLE] + places.ANCHOR_FEATURES
    return f"""with w as (select unnest(['allweek', 'weekday', 'weekend']) w), y as (select unnest(['allday', 'day', 'night']) y), ch as (select unnest(['call', 'text']) ch),
      a as (select m, w, y, ch r from (select unnest({lists(plain)}) m), w, y, ch where ch = 'call' or m <> 'percent_initiated_interactions'),
      b as (select m, w, y, ch || '__' || st r from (select unnest({lists(wide.PER_CHANNEL_STATS)}) m), w, y, ch, (select {stats})),
      e as (select m, w, y, r from (values {', '.join(rest)}) t(m, r), w, y), f as (select m, w, y, case when r = '' then st else r || '__' || st end r from (values {', '.join(more_stats)}) t(m, r), w, y, (select {stats})),
      u as (select * from a union all select * from b union all select * from e union all select * from f)
      select m || '__' || w || '__' || y || case when r = '' then '' else '__' || r end as name, case when m in ({', '.join(f"'{x}'" for x in counts)}) then 'BIGINT' else 'DOUBLE' end as type from u
      union all select n, case when n in ('reporting__number_of_records', 'has_inferred_work', 'number_of_places') then 'BIGINT' else 'DOUBLE' end from (select unnest({lists(whole)}) n)"""


SQL["feature_names"] = _names_sql()
SQL["agent_row"] = f"select * from ({SQL['feature_table_slice']}) where phone_number = 'SUB000007'"


def _table_sql() -> str:
    """All columns: the indicators' own SQL in long form, then one conditional maximum a name."""
    stats = lambda m: {f"{m}__{s}": (m, s) for s in wide.STATS}
    renamed = {"number_of_interactions_in": "number_of_interaction_in", "number_of_interactions_out": "number_of_interaction_out", "percent_initiated": "percent_initiated_interactions"}
    counted = ["number_of_interactions", "number_of_interactions_in", "number_of_interactions_out", "number_of_contacts", "percent_initiated", "percent_nocturnal"]
    one = lambda *names: {n: (n, "") for n in names}
    families = [
        ("interaction_counts", "event_type", {n: (renamed.get(n, n), "") for n in counted}), ("contact_entropy", "event_type", one("entropy_of_contacts")),
        ("pareto_interactions", "event_type", one("percent_pareto_interactions")), ("active_days", "'callandtext'", one("active_days")), ("call_duration_stats", "'call'", stats("call_duration")),
        ("pareto_durations", "'call'", one("percent_pareto_durations")), ("text_response", "'callandtext'", stats("response_delay_text") | one("response_rate_text")),
        ("conversations", "'callandtext'", one("percent_initiated_conversations")), ("antenna_entropy", "''", one("number_of_antennas", "entropy_of_antennas")), ("percent_at_home", "''", one("percent_at_home")),
        ("radius_of_gyration", "''", one("radius_of_gyration")), ("frequent_antennas", "''", one("frequent_antennas")),
        ("recharge_stats", "''", one("number_of_recharges") | stats("amount_recharges") | stats("interevent_time_recharges")), ("pareto_recharges", "''", one("percent_pareto_recharges")),
        *((n, "event_type", stats(m)) for n, m in (("interactions_per_contact", "interactions_per_contact"), ("contact_balance", "balance_of_contacts"), ("interevent_time", "interevent_time"))),
    ]
    known, tables, parts = c.SQL | more.SQL, [], []
    for name, channel, measures in families:
        tables.append(f"{name}_t as materialized ({known[name]})")
        for column, (metric, stat) in measures.items():
            parts.append(f"select agent_id, concat_ws('__', '{metric}', week, day, nullif({channel}, ''), nullif('{stat}', '')) as name, cast({column} as double) as value from {name}_t")
    for name, columns in (("n_records", {"number_of_records": "reporting__number_of_records"}), ("churn", one("churn_rate__mean", "churn_rate__std")), ("avg_balance", one("average_balance_recharges")), ("anchor_features", one(*places.ANCHOR_FEATURES))):
        tables.append(f"{name}_t as materialized ({known[name]})")
        parts += [f"select agent_id, '{out if isinstance(out, str) else column}', cast({column} as double) from {name}_t" for column, out in columns.items()]
    picked = ", ".join(f"cast(coalesce(m['{n}'], 0) as {'bigint' if k else 'double'}) as \"{n}\"" for n, k in wide.columns().items())
    return f"""with {', '.join(tables)}, longs as materialized ({' union all '.join(parts)}), maps as materialized (select agent_id, map_from_entries(list(struct_pack(k := name, v := value))) as m from longs group by agent_id),
      pop0 as (select distinct user_id agent_id, 'SUB' || lpad(cast(user_id as varchar), 6, '0') phone_number from events) select phone_number, {picked} from pop0 left join maps using (agent_id)"""


SQL["feature_table"] = _table_sql()
