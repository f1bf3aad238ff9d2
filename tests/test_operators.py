"""Closed-form cases and NumPy twins of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import arrays, geo, geometry, scalar
from tramline.operators import asof, series, spans, tracks

K = ["k"]


def frame(spark, t, v, k="a"):
    return spark.createDataFrame([(k, float(a), None if b is None else float(b)) for a, b in zip(t, v)], "k string, t double, v double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_constant_speed_integrates(spark):
    t = np.linspace(0, 10, 101)
    m = series.integrate(frame(spark, t, [4] * 101), K, "t", "v")
    d = column(m, "d")
    assert math.isclose(d[-1], 40) and math.isclose(d[25], 10)
    probes = spark.createDataFrame([("a", -3.0), ("a", 2.5), ("a", 99.0)], "k string, t double")
    assert np.allclose(column(asof.interp_join(probes, m, K, "t", ["d"]), "d"), [0, 10, 40])


def test_time_and_distance_round_trip(spark):
    t = np.linspace(0, 40, 401)
    m = series.integrate(frame(spark, t, 5 + 4 * np.sin(t / 3)), K, "t", "v")
    probes = spark.createDataFrame([("a", float(x), i) for i, x in enumerate(np.linspace(1, 39, 97))], "k string, t double, i int")
    there = asof.interp_join(probes, m, K, "t", ["d"]).withColumnRenamed("t", "asked")
    back = asof.interp_join(there, m.select("k", "t", "d"), K, "d", ["t"])
    assert max(abs(r.asked - r.t) for r in back.collect()) < 0.003


def test_a_stop_stays_invertible(spark):
    t = np.linspace(0, 10, 1001)
    v = np.where((t >= 3) & (t <= 7), 0, 6)
    m = series.integrate(frame(spark, t, v), K, "t", "v")
    assert (np.diff(column(m, "d")) > 0).all() and series.map_violations(m, K, "t", "d").count() == 0
    s = spans.spans_below(frame(spark, t, v), K, "t", "v", 0.36).collect()
    assert len(s) == 1 and abs(s[0].start - 3) < 0.02 and abs(s[0].end - 7) < 0.02


def test_one_low_sample_is_no_stop(spark):
    t = np.linspace(0, 10, 201)
    v = np.full(201, 5.0)
    v[100] = 0
    assert spans.spans_below(frame(spark, t, v), K, "t", "v", 0.3).count() == 0


def test_median_filter_repeats_the_ends(spark):
    r = random.Random(1)
    for n, window in ((1, 9), (4, 9), (50, 9), (33, 4)):
        v = [r.random() for _ in range(n)]
        h = (window | 1) // 2
        pad = np.pad(v, h, mode="edge")
        want = [np.median(pad[i : i + 2 * h + 1]) for i in range(n)]
        assert np.allclose(column(series.median_filter(frame(spark, range(n), v), K, "t", "v", window), "v"), want)


def test_rise_limiter_equals_its_loop(spark):
    r = random.Random(2)
    t = np.cumsum([r.uniform(0.05, 0.3) for _ in range(120)])
    v = [r.choice([10, 100, 500]) * r.random() for _ in t]
    a, b = list(v), list(v)
    for i in range(1, len(v)):
        a[i] = min(a[i], a[i - 1] + 50 * (t[i] - t[i - 1]))
    for i in range(len(v) - 2, -1, -1):
        b[i] = min(b[i], b[i + 1] + 50 * (t[i + 1] - t[i]))
    got = column(series.limit_rise(frame(spark, t, v), K, "t", "v", 50.0), "v")
    assert np.allclose(got, np.minimum(a, b))
    assert np.allclose(column(series.limit_rise(frame(spark, t, v), K, "t", "v", 0.0), "v"), v)


def test_fill_holds_the_ends(spark):
    assert np.allclose(column(series.fill_linear(frame(spark, range(5), [0.2, None, None, None, 1]), K, "t", "v"), "v"), [0.2, 0.4, 0.6, 0.8, 1])
    assert column(series.fill_linear(frame(spark, range(4), [None, 3, None, None]), K, "t", "v"), "v") == [3, 3, 3, 3]
    assert column(series.fill_linear(frame(spark, range(2), [None, None]), K, "t", "v"), "v") == [None, None]


def test_gaussian_equals_numpy(spark):
    r = random.Random(3)
    t = np.cumsum([r.uniform(0.05, 0.3) for _ in range(60)])
    v = np.array([r.random() for _ in t])
    w = np.exp(-0.5 * ((t[:, None] - t) / 0.4) ** 2) * (np.abs(t[:, None] - t) <= 0.8)
    assert np.allclose(column(series.gaussian_smooth(frame(spark, t, v), K, "t", "v", 0.8), "v"), (w * v).sum(1) / w.sum(1))
    assert column(series.gaussian_smooth(frame(spark, [0, 1], [5, 7]), K, "t", "v", 3.0), "v") == [5, 7]


def jumps(t, at, height=0.2, half=0.5):
    y = np.full(len(t), 0.8)
    for c, h in zip(at, height if isinstance(height, list) else [height] * len(at)):
        y -= np.maximum(0, h * (1 - ((t - c) / half) ** 2)) * (np.abs(t - c) < half)
    return y


def test_arcs_over_a_baseline(spark):
    t = np.arange(0, 40, 1 / 30)
    d = series.ground_baseline(frame(spark, t, jumps(t, [5, 15, 30], [0.1, 0.2, 0.3])), K, "t", "v", 3.0)
    assert max(abs(b - 0.8) for b in column(d, "baseline")) < 0.02
    arcs = series.find_arcs(d, K, "t", "v", "baseline").orderBy("start").collect()
    assert len(arcs) == 3 and arcs[0].height < arcs[1].height < arcs[2].height
    assert all(abs(a.peak - c) < 0.05 for a, c in zip(arcs, (5, 15, 30)))


def test_parked(spark):
    t = np.arange(0, 30, 0.1)
    x = np.minimum(t, 20)
    d = spark.createDataFrame([("a", float(a), float(b), 0.5) for a, b in zip(t, x)], "k string, t double, x double, y double")
    assert abs(series.parked_after(d, K, "t", "x", "y").first().parked - 20) < 0.5


def test_thinning_is_linspace(spark):
    for n, k in ((10, 20), (100, 16), (57, 7), (2, 2), (1, 5)):
        got = column(series.thin(frame(spark, range(n), range(n)), K, "t", k), "v")
        want = range(n) if n <= k else sorted({int(i) for i in np.linspace(0, n - 1, k)})
        assert got == [float(i) for i in want]


def test_window_speed(spark):
    fixes = spark.createDataFrame([("a", float(i), 37.0 + i * 15 * geo.deg_per_metre(), -122.0) for i in range(7)], "k string, t double, lat double, lon double")
    rows = series.gps_window_speed(fixes, K, "t", "lat", "lon").orderBy("t").collect()
    assert rows[2].window_speed is None and abs(rows[6].window_speed - 15) < 0.15 and abs(rows[6].window_course) < 1


def test_delay(spark):
    s = frame(spark, [1, 2, 3], [0, 10, 20])
    p = spark.createDataFrame([("a", 2.5), ("a", 3.0), ("a", 20.0), ("b", 1.0)], "k string, t double")
    got = {(r.k, r.t): r.v for r in asof.delayed(p, s, K, "t", "v", 1.0, 4.0).collect()}
    assert got == {("a", 2.5): 5, ("a", 3.0): 10, ("a", 20.0): 20, ("b", 1.0): 4}


def test_nearest_prefers_the_earlier(spark):
    f = spark.createDataFrame([("a", 0.0, 1), ("a", 0.0, 2), ("a", 2.0, 3)], "k string, t double, n int")
    p = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("a", -0.4), ("a", 9.0)], "k string, t double")
    got = {r.t: r.n for r in asof.asof_nearest(p, f, K, "t", 1.0, tie=["n"]).collect()}
    assert got == {1.0: 1, 1.5: 3, -0.4: 1, 9.0: None}
    assert asof.asof_nearest(p, f, K, "t", 1.0, strict=True, tie=["n"]).filter("t = 1 and n is null").count() == 1


def test_runs(spark):
    r = random.Random(5)
    for _ in range(5):
        flags = [r.random() < 0.5 for _ in range(40)]
        d = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "k string, t int, f boolean")
        want = []
        for i, f in enumerate(flags):
            if f:
                if want and i - want[-1][1] - 1 <= 1:
                    want[-1][1] = i
                else:
                    want.append([i, i])
        want = [tuple(w) for w in want if w[1] - w[0] + 1 >= 3]
        assert sorted((x.start, x.end) for x in spans.merge_runs(d, K, "t", "f", 1, 3).collect()) == want
        bridged = list(flags)
        i = 0
        while i < 40:
            j = i
            while j < 40 and flags[j] == flags[i]:
                j += 1
            if not flags[i] and j - i < 3:
                bridged[i:j] = [True] * (j - i)
            i = j
        assert column(spans.bridge_short(d, K, ["t"], "f", 3), "f") == bridged


def test_violations_stay_open_over_no_evidence(spark):
    rows = [("a", 0.0, False, True, 0.0), ("a", 0.1, True, False, 0.1), ("a", 0.2, False, False, 0.0), ("a", 0.3, True, False, 0.3), ("a", 0.5, False, True, 0.0), ("a", 0.6, True, False, 0.2), ("a", 0.7, False, True, 0.0)]
    d = spark.createDataFrame(rows, "k string, t double, bad boolean, closes boolean, gap double").withColumn("detail", F.col("t").cast("string"))
    got = spans.held_violations(d, K, "t", "bad", "closes", "gap", "detail").collect()
    assert [(r.start, r.end, r.worst, r.detail) for r in got] == [(0.1, 0.5, 0.3, "0.3")]


def test_hysteresis_rejects_equal_limits(spark):
    with pytest.raises(ValueError):
        series.hysteresis(frame(spark, [0], [0]), K, "t", "v", 1.0, 1.0)


def test_tracks_split_at_a_jump(spark):
    rows = [("a", i / 10, "car", x, x + 0.1, 0.2, 0.4) for i, x in enumerate([0.3] * 5 + [0.5] * 5)]
    d = spark.createDataFrame(rows, "k string, t double, label string, x1 double, x2 double, y1 double, y2 double")
    assert tracks.chain_tracks(d, K).select("track_id").distinct().count() == 2


def test_suppression_is_greedy(spark):
    rows = [("a", 0.0, 0.0, 1.0, 1.0, 0.9), ("a", 0.0, 0.0, 1.0, 1.0, 0.8), ("a", 0.5, 0.0, 1.5, 1.0, 0.7), ("a", 3.0, 3.0, 4.0, 4.0, 0.1), ("b", 0.0, 0.0, 1.0, 1.0, 0.2)]
    got = tracks.nms(spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, score double"), K, 0.5).collect()
    assert sorted(r.score for r in got) == [0.1, 0.2, 0.7, 0.9]


def test_geo(spark):
    one = spark.range(1)
    la = geo.haversine_m(F.lit(37.7749), F.lit(-122.4194), F.lit(34.0522), F.lit(-118.2437))
    r = one.select(la.alias("m"), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), geo.angle_difference(F.lit(350.0), F.lit(10.0)).alias("d")).first()
    assert 550_000 < r.m < 570_000 and math.isclose(r.b, 90) and math.isclose(r.d, 20)


def test_scalars(spark):
    half = math.sqrt(0.5)
    turned = scalar.rotate([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(half), F.lit(half)])
    flat = scalar.rotate([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.lit(0.0)] * 4)
    g, v = geometry.arc_params(F.lit(0.6), F.lit(0.6), F.lit(0.2), F.lit(1.0))
    r = spark.range(1).select(*[c.alias(f"r{i}") for i, c in enumerate(turned)], flat[1].alias("f"), g.alias("g"), v.alias("v"), scalar.speed_curve(F.lit(30.0)).alias("top"), scalar.speed_curve(F.lit(-1.0)).alias("low"), geometry.circle_box_gap(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(-1.0), F.lit(3.0), F.lit(1.0)).alias("gap")).first()
    assert np.allclose([r.r0, r.r1, r.r2], [0, 1, 0]) and r.f == 2 and math.isclose(r.g, 1.6) and math.isclose(r.v, 0.8) and math.isclose(r.top, 10) and r.low == 0 and math.isclose(r.gap, 1)


def test_clean_line(spark):
    line = [60] * 60
    line[20] = 5
    line[30:33] = [-1] * 3
    line[:4] = [-1] * 4
    out = spark.createDataFrame([(line, 10.0)], "l array<int>, s double").select(arrays.clean_line("l", "s").alias("o")).first().o
    assert out[:4] == [-1] * 4 and set(out[4:]) == {60}


def test_shuffled_rows_change_nothing(spark):
    t = list(range(50))
    v = [random.Random(9).random() for _ in t]
    rows = list(zip(t, v))
    random.Random(4).shuffle(rows)
    a = series.median_filter(series.integrate(frame(spark, t, v), K, "t", "v"), K, "t", "d", 7)
    b = series.median_filter(series.integrate(frame(spark, *zip(*rows)).repartition(7), K, "t", "v"), K, "t", "d", 7)
    assert column(a, "d") == column(b, "d")


def test_facts_without_a_place(spark):
    """They are nobody's neighbour, and probes without a place have none."""
    facts = spark.createDataFrame([(1, None, 9.0), (1, 5.0, 3.0)], "k int, t double, v double")
    probes = spark.createDataFrame([(1, 1.0), (1, 6.0), (1, None)], "k int, t double")
    got = lambda df: {x.t: x.v for x in df.collect()}
    assert got(asof.asof_backward(probes, facts, ["k"], "t")) == {1.0: None, 6.0: 3.0, None: None}
    assert got(asof.interp_join(probes, facts, ["k"], "t", ["v"])) == {1.0: 3.0, 6.0: 3.0, None: None}
    assert got(asof.asof_nearest(probes, facts, ["k"], "t")) == {1.0: 3.0, 6.0: 3.0, None: None}


def test_match_boxes_one_to_one(spark):
    rows = [(7, 0, 0, 0.05), (7, 0, 1, 0.01), (7, 1, 0, 0.02), (7, 1, 1, 0.03), (7, 2, 2, 0.14), (8, 0, 0, 0.1)]
    pairs = spark.createDataFrame(rows, "pair_id long, left long, right long, distance double").repartition(5)
    assert {tuple(x) for x in tracks.match_boxes(pairs, ["pair_id"]).collect()} == {rows[1], rows[2], rows[5]}


def test_clean_line_by_its_median(spark):
    """One median of the whole line, as a loop says it."""
    line = list(range(100))
    out = spark.createDataFrame([(line, 20.0)], "l array<int>, s double").select(arrays.clean_line("l", "s").alias("o")).first().o
    assert [i for i, v in enumerate(out) if v != -1] == [i for i in range(100) if abs(i - 49.5) <= 20]


def test_spans_that_overlap_touch_or_have_nulls_equal_loops(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, *range(12)])) for i in range(150)]
    held = [(r.choice(["a", "b", "c", None]), a, None if r.random() < 0.1 else a + r.randint(-1, 5), float(n)) for n, a in enumerate(r.randint(0, 11) for _ in range(14))]
    df = spark.createDataFrame([(k, i, None if t is None else float(t)) for k, i, t in rows], "k string, i int, t double")
    given = spark.createDataFrame([(k, float(a), None if b is None else float(b), n) for k, a, b, n in held], "k string, start double, end double, dy double")

    def holds(k, t):
        return [n for q, a, b, n in held if k is not None and q == k and t is not None and b is not None and a <= t <= b]

    assert sorted(x.i for x in spans.in_spans(df, given, ["k"], "t").collect()) == [i for k, i, t in rows if holds(k, t)]
    assert sorted(x.i for x in spans.not_in_spans(df, given, ["k"], "t").collect()) == [i for k, i, t in rows if not holds(k, t)]
    assert sorted((x.i, x.dy) for x in spans.spans_at(df, given, ["k"], "t").collect()) == sorted((i, n) for k, i, t in rows for n in holds(k, t))
    assert spans.in_spans(df, given.limit(0), ["k"], "t").count() == 0 and spans.not_in_spans(df, given.limit(0), ["k"], "t").count() == len(rows)
    assert set(spans.spans_at(df, given, ["k"], "t").columns) == {"k", "i", "t", "start", "end", "dy"}
