"""Edge cases of the call-detail operators against plain versions and worked examples."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from celltrail.functions import geo, stats
from celltrail.operators import graph, indicators, learning, metrics, places, stays, trajectory, wide
from celltrail.plans import registry
from celltrail.sources import adapters

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 1, 1)
PING = "agent_id long, ping_id long, timestamp timestamp_ntz, lat double, lon double"
EVENT = "event_id long, caller_id long, callee_id long, timestamp timestamp_ntz, event_type string, duration_sec long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def pings(spark, rows):
    return spark.createDataFrame([(a, i, at(t), la, lo) for i, (a, t, la, lo) in enumerate(rows)], PING)


def test_bounces_feed_back_and_null_positions_pass_through(spark):
    step = 0.003  # about 330 m
    rows = [(1, 60 * i, 12.9, 77.5 + step * (i % 2)) for i in range(5)] + [(2, 0, 12.0, 77.0), (2, 60, None, 77.0), (2, 120, 12.0, 77.0), (3, 0, 1.0, 2.0)]
    got = {r.ping_id: (r.lat, r.lon) for r in trajectory.ping_pong(pings(spark, rows)).collect()}
    assert [round(got[i][1], 6) for i in range(5)] == [77.5, 77.5, 77.5, 77.5, 77.5]
    assert got[6] == (None, 77.0) and got[5] == (12.0, 77.0) and got[8] == (1.0, 2.0)
    assert trajectory.ping_pong(pings(spark, rows[:0])).collect() == []


def kalman_by_matrices(t, lat, lon):
    ref, q, r = np.mean(lat), 25.0, 22500.0
    scale = geo.RADIUS_M * math.cos(math.radians(ref))
    z = np.stack([np.radians(lon) * scale, np.radians(lat) * geo.RADIUS_M])
    s, p, out = np.array([z[0, 0], 0, z[1, 0], 0]), np.eye(4) * r, [z[:, 0]]
    h = np.array([[1, 0, 0, 0], [0, 0, 1, 0]])
    for i in range(1, len(t)):
        d = max(t[i] - t[i - 1], 1)
        f = np.kron(np.eye(2), [[1, d], [0, 1]])
        p = f @ p @ f.T + np.kron(np.eye(2), q * np.array([[d**2 / 3, d / 2], [d / 2, 1]]))
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(2))
        s = f @ s
        s, p = s + gain @ (z[:, i] - h @ s), p - gain @ h @ p
        out.append(h @ s)
    out = np.array(out)
    return np.degrees(out[:, 1] / geo.RADIUS_M), np.degrees(out[:, 0] / scale)


def test_kalman_equals_the_matrix_form(spark):
    rng = random.Random(3)
    rows = [(7, 300 * i, 12.9 + rng.gauss(0, 0.01), 77.5 + rng.gauss(0, 0.01)) for i in range(40)]
    got = sorted(trajectory.kalman(pings(spark, rows)).collect(), key=lambda r: r.ping_id)
    lat, lon = kalman_by_matrices([r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    assert np.allclose([r.lat for r in got], lat, atol=1e-8) and np.allclose([r.lon for r in got], lon, atol=1e-8)
    assert trajectory.denoise(pings(spark, rows), "particle").count() == 40


def test_nearest_antenna_is_exact_also_far_away_and_in_ties(spark):
    rng = random.Random(5)
    towers = [(i, round(rng.uniform(0, 1), 2), round(rng.gauss(0, 0.1), 2)) for i in range(120)] + [(900, 40.0, 40.0)]
    points = [(i, rng.uniform(-1, 2), rng.uniform(-1, 1)) for i in range(300)] + [(500, 39.0, 41.0), (501, 20.0, 20.0), (502, None, 1.0), (503, 500.0, -500.0)]
    got = trajectory.nearest_antenna(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(towers, "antenna_id long, lat double, lon double"))
    got = {r.id: r.antenna_id for r in got.collect()}
    want = {i: None if a is None else min(towers, key=lambda t: ((t[1] - a) ** 2 + (t[2] - o) ** 2, t[0]))[0] for i, a, o in points}
    assert got == want
    none = trajectory.nearest_antenna(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame([], "antenna_id long, lat double, lon double"))
    assert {r.antenna_id for r in none.collect()} == {None}


def test_stays_need_more_than_the_span_and_runs_break_at_the_distance(spark):
    near = 199.9 / 111_194.9
    rows = [(1, 0, 0.0, 0.0), (1, 1200, 0.0, 0.0), (2, 0, 0.0, 0.0), (2, 1200.000001, near, 0.0), (3, 0, 0.0, 0.0), (3, 2000, 200.1 / 111_194.9, 0.0), (4, 5, 1.0, 1.0)]
    assert [r.agent_id for r in stays.candidate_stays(pings(spark, rows)).collect()] == [2]
    assert stays.stay_points(pings(spark, rows[:0])).collect() == []


def stay(i, lat, lon, start, hours, agent=1):
    return agent, i, at(start), at(start + 3600 * hours), lat, lon, 1


STAY = "agent_id long, stay_index long, arrival_time timestamp_ntz, departure_time timestamp_ntz, lat double, lon double, n_points long"


def test_places_take_the_first_match_not_the_nearest(spark):
    m = 1 / 111_194.9
    rows = [stay(1, 0.0, 0.0, 0, 1), stay(2, 400 * m, 0.0, 1, 1), stay(3, 230 * m, 0.0, 2, 1)]
    got = {r.stay_index: r.place_id for r in places.places(spark.createDataFrame(rows, STAY)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_labels_have_no_runner_up_and_no_home_at_weekends(spark):
    day = 86400
    # agent 1: home at night; the busiest work candidate is visited once in two weeks, another one twice
    rows = [stay(1, 0.0, 0.0, 21 * 3600, 8), stay(2, 1.0, 0.0, 9 * 3600, 9), stay(3, 2.0, 0.0, day + 9 * 3600, 1), stay(4, 2.0, 0.0, 2 * day + 9 * 3600, 1)]
    rows += [stay(1, 5.0, 0.0, 5 * day + 9 * 3600, 5, 2)]  # a Saturday
    placed = places.places(spark.createDataFrame(rows, STAY))
    got = {(r.agent_id, r.stay_index): r.place_label for r in places.label_places(placed).collect()}
    assert got == {(1, 1): "home", (1, 2): "other", (1, 3): "other", (1, 4): "other", (2, 1): "other"}
    assert {r.place_label for r in places.label_places(placed, sim_days=7).where("agent_id = 1 and stay_index = 2").collect()} == {"work"}
    assert places.weeks_of(3) == 1 and places.weeks_of(14) == 2
    who = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "agent_id long, phone_number string")
    silent = places.anchor_features(places.label_places(placed), who).where("agent_id = 9").first()
    assert sum(v for k, v in silent.asDict().items() if k != "agent_id") == 0
    motifs = places.motif_features(places.label_places(placed), who).where("phone_number = 'z'").first()
    assert motifs.motif__fraction_stay_home_days == 1.0 and motifs.motif__primary_id == 0


def events(spark, rows):
    return spark.createDataFrame([(i, a, b, at(t), k, d) for i, (a, b, t, k, d) in enumerate(rows)], EVENT)


def test_replies_count_up_to_the_hour_and_one_reply_may_answer_many(spark):
    rows = [(2, 1, 0, "text", 0), (2, 1, 10, "text", 0), (1, 2, 3600, "text", 0), (3, 1, 0, "text", 0), (1, 3, 3601, "text", 0), (1, 1, 50, "text", 0)]
    it = indicators.interactions(events(spark, rows))
    r = indicators.text_response(it).where("agent_id = 1 and week = 'allweek' and day = 'allday'").first()
    assert r.response_rate_text == 0.5 and (r.response_delay_text__min, r.response_delay_text__max) == (3590.0, 3600.0)
    sessions = indicators.conversations(it).where("agent_id = 1 and week = 'allweek' and day = 'allday'").first()
    assert sessions.percent_initiated_conversations == 0.5  # with 2: one, begun by 2; with 3: two; with itself: one
    counts = indicators.counts(it).where("event_type = 'text'").first()
    assert counts.percent_initiated is None


def test_summaries_of_few_values(spark):
    df = spark.createDataFrame([("none", None), ("one", 4.0), ("flat", 2.0), ("flat", 2.0)], "k string, v double").groupBy("k").agg(*stats.summary("v", "s"))
    got = {r.k: r for r in df.collect()}
    assert set(got["none"][1:]) == {0.0}
    assert got["one"].s__mean == got["one"].s__min == 4.0 and got["one"].s__std == got["one"].s__kurtosis == 0.0
    assert got["flat"].s__skewness == got["flat"].s__kurtosis == 0.0
    zeros = stats.pareto(spark.createDataFrame([("a", 0), ("a", 0)], "k string, v long"), ["k"], "v", "share").first()
    assert zeros.share == 0.0


def test_pareto_of_an_exact_tie_does_not_depend_on_the_order_of_the_rows(spark, tmp_path):
    # the largest hold exactly 80 %; summed upwards, the total of each is another double
    tied = [[58.16, 22.7, 22.66, 12.94, 12.94], [58.31, 48.65, 44.2, 18.9, 18.89], [67.1, 56.59, 20.71, 18.05, 18.05], [68.76, 45.68, 9.55, 9.53, 9.53],
            [76.12, 65.96, 60.65, 59.25, 55.78, 26.48, 26.48, 26.48], [85.94, 62.96, 53.32, 49.46, 44.24, 14.82, 14.79, 14.79, 14.79, 14.79]]
    orders = [lambda v: v, lambda v: v[::-1], lambda v: random.Random(4).sample(v, len(v))]
    bought = [(10 * i + j, x) for i, v in enumerate(tied) for j, order in enumerate(orders) for x in order(v)]
    events = [(n, at(36000 + n), who, "purchase", x, '{"k": 1}') for n, (who, x) in enumerate(bought)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry.QUERIES["pareto_recharges"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    con.execute(f"create view supplier as select * from '{SF}/supplier.parquet'")
    assert got == sorted(con.execute(registry.SQL["pareto_recharges"]).fetchall())
    by_amounts = {}
    for agent, _, _, share in got:
        by_amounts.setdefault(agent // 10, set()).add(share)
    assert [len(s) for s in by_amounts.values()] == [1] * len(tied)


def test_pagerank_sums_to_one_with_a_dangling_vertex(spark):
    who = spark.createDataFrame([(i, str(i)) for i in range(5)], "agent_id long, phone_number string")
    edges = spark.createDataFrame([(0, 1, 3), (1, 2, 1), (2, 0, 1), (0, 3, 1)], "src long, dst long, weight long")
    got = {r.agent_id: r.pagerank for r in graph.pagerank(edges, who, iterations=12, tolerance=None).collect()}
    rank = np.full(5, 0.2)
    m = np.zeros((5, 5))
    m[1, 0], m[3, 0], m[2, 1], m[0, 2], m[:, 3], m[:, 4] = 0.75, 0.25, 1, 1, 0.2, 0.2
    for _ in range(12):
        rank = 0.85 * m @ rank + 0.03
    assert abs(sum(got.values()) - 1) < 1e-6 and all(abs(got[i] - rank[i]) < 1e-8 for i in range(5))
    assert graph.pagerank(edges.limit(0), who.limit(0)).collect() == []
    tied = graph.degree_strength(edges, who).where("agent_id = 4").first()
    assert tied.total_degree == 0


def test_clustering_ignores_self_loops_and_directions(spark):
    who = spark.createDataFrame([(i,) for i in range(5)], "agent_id long")
    edges = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (4, 4, 1)], "src long, dst long, weight long")
    assert {r.agent_id: r.clustering for r in graph.clustering(edges, who).collect()} == {0: 1.0, 1: 1.0, 2: 0.333333, 3: 0.0, 4: 0.0}


def test_nearest_rows_of_duplicates_never_name_the_row_itself(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "agent_id long, x array<double>")
    got = {}
    for r in graph.nearest_rows(df, df, 4, per_block=17).collect():
        got.setdefault(r.v, []).append((r.distance, r.w))
    for i in range(60):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(60) if j != i)[:4]
        assert sorted(got[i]) == want


def test_colocation_counts_agents_once_in_a_cell_and_hour(spark):
    rows = [stay(1, 0.0, 0.0, 0, 1, 1), stay(2, 0.0, 0.0, 60, 1, 1), stay(1, 0.0, 0.0, 3599, 1, 2), stay(1, 0.0, 0.0, 3600, 1, 3)]
    assert [tuple(r) for r in graph.colocation_pairs(spark.createDataFrame(rows, STAY)).collect()] == [(1, 2, 1)]
    who = spark.createDataFrame([(i, *[0.0] * 5) for i in range(3)], ["agent_id", *graph.NEIGHBOUR_FEATURES])
    none = graph.colocation_features(graph.colocation_pairs(spark.createDataFrame([], STAY)), who, who)
    assert len(none.columns) == 14 and none.count() == 3


def test_wide_names_and_silent_subscribers(spark):
    names = wide.columns()
    assert len(names) == 876 and len(wide.cell_columns("weekday", "night")) == 96
    who = spark.createDataFrame([(1, "a"), (2, "b")], "agent_id long, phone_number string")
    rows = spark.createDataFrame([(1, "churn_rate__mean", 0.5)], "agent_id long, name string, value double")
    got = {r.phone_number: r for r in wide.feature_table(who, rows, {"churn_rate__mean": False, "number_of_places": True}).collect()}
    assert got["a"].churn_rate__mean == 0.5 and got["b"].churn_rate__mean == 0.0 and got["b"].number_of_places == 0


def test_folds_are_balanced_and_smote_evens_classes(spark):
    rows = spark.createDataFrame([(i, f"p{i}", "a" if i % 4 else "b") for i in range(50)], "agent_id long, phone_number string, label string")
    n = {}
    for r in metrics.stratified_folds(rows, "phone_number", "label").collect():
        n.setdefault(r.label, {}).setdefault(r.fold, []).append(r.agent_id)
    assert all(max(map(len, f.values())) - min(map(len, f.values())) <= 1 and len(f) == 5 for f in n.values())
    coded = learning.encode_labels(rows, "label").withColumn("x", F.array(F.col("agent_id").cast("double"), F.lit(1.0)))
    made = learning.smote(coded)
    assert {r.y: r["count"] for r in made.groupBy("y").count().collect()} == {0: 37, 1: 37}
    assert made.where("agent_id is null").select(F.min(F.col("x")[0]), F.max(F.col("x")[0])).first()[:] >= (0.0,)
    lone = coded.where("label = 'a' or agent_id = 0")
    assert learning.smote(lone).count() == lone.count()


def test_variants_chain_and_reports(spark, tmp_path):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "phone_number string, f double")
    graphs = spark.createDataFrame([("a", 1.0, 2.0)], "phone_number string, graph_social__x double, graph_colocation__y double")
    got = {v: learning.variant_features(base, graphs, v) for v in learning.VARIANTS}
    assert [got[v][1] for v in learning.VARIANTS] == [False, True, False, False, True]
    assert [len(got[v][0].columns) for v in learning.VARIANTS] == [2, 2, 3, 3, 4]
    assert learning.variant_features(base, None, "baseline+all_graphs")[1] is False
    prior = spark.createDataFrame([("a", 0.3, 0.7)], "phone_number string, prob_age_group__x double, prob_age_group__y double")
    assert learning.chain_features(base, {"age_group": prior}, "education_level").columns[-1] == "prob_age_group__y"
    assert learning.chain_features(base, {"age_group": prior}, "gender").count() == 2
    report = learning.report_text(metrics.f1_report(spark.createDataFrame([("u", "u"), ("u", "v")], "t string, g string"), "t", "g"))
    adapters.write_reports(spark, {"gender": report}, str(tmp_path / "r"))
    assert "=== Target: gender ===" in {r.value for r in spark.read.text(str(tmp_path / "r")).collect()}
    scores = metrics.f1_scores(spark.createDataFrame([("u", "u"), ("u", "v")], "t string, g string"), "t", "g").first()
    assert scores.macro_f1 == pytest.approx(1 / 3, abs=1e-6) and scores.weighted_f1 == pytest.approx(2 / 3, abs=1e-6)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 3.5)], adapters.SCHEMAS["antennas"])
    for kind in ("csv", "parquet"):
        adapters.write_table(df, f"{tmp_path}/t.{kind}", kind)
        adapters.write_table(df, f"{tmp_path}/t.{kind}", kind)
        assert adapters.read_table(spark, f"{tmp_path}/t.{kind}", "antennas").collect() == df.collect()
    (tmp_path / "bad.csv").write_text("antenna_id,lat,lon\nx,1,2\n")
    with pytest.raises(Exception):  # noqa: B017  a malformed row
        adapters.read_table(spark, f"{tmp_path}/bad.csv", "antennas").collect()
    assert adapters.first_given(None, df) is df
