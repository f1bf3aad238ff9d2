"""Paths and cues of a small timeline."""

import math
import random
import pytest
from pyspark.sql import functions as F
import numpy as np

from tramline.operators import series
from tramline.plans import authoring


def timeline(spark, binding=True):
    return {
        "surfaces": spark.createDataFrame([("c", 0.0, "sidewalk"), ("c", 5.0, "rail")], "clip_id string, t double, surface string"),
        "settings": spark.createDataFrame([("c", binding, 0.3, {"rail": -0.1}, {"dodge": 0.8})], "clip_id string, authoritative_events boolean, post_marker_column double, surfaceOffsets map<string,double>, eventWindows map<string,double>"),
        "events": spark.createDataFrame([("c", 2.0, "jump", "a", 0.2, 1.0, None, None), ("c", 2.5, "hop", "h", None, None, None, None), ("c", 3.0, "dodge", "b", None, None, 0.4, None)], "clip_id string, t double, type string, label string, height double, airTime double, duration double, window double"),
        "hidden": spark.createDataFrame([("c", 7.0, 8.0)], "clip_id string, start double, end double"),
        "pathAdjust": spark.createDataFrame([("c", 1.0, 3.0, 0.05)], "clip_id string, start double, end double, dy double"),
        "sizeDepth": spark.createDataFrame([("c", 6.0, 9.0, 0.9)], "clip_id string, start double, end double, y double"),
    }


def test_path_and_events(spark):
    m = spark.createDataFrame([("c", 0.0, 0.0), ("c", 10.0, 100.0)], "clip_id string, t double, d double")
    g = spark.createDataFrame([("c", 0.0, 0.6), ("c", 100.0, 0.6)], "clip_id string, d double, y double")
    t = timeline(spark)
    p = authoring.authored_path(m, g, t).orderBy("i").toPandas()
    at = lambda x: p.iloc[(p["t"] - x).abs().argmin()]
    assert len(p) == 1400 and abs(at(0.5).y - 0.6) < 1e-6 and abs(at(2).y - 0.65) < 1e-6 and abs(at(9.5).y - 0.5) < 1e-6
    assert abs(at(7.5).z - 0.9) < 1e-6 and abs(at(0.5).z - 0.6) < 1e-6 and at(9).s == "rail" and np.abs(np.diff(p["y"])).max() < 0.01
    e = authoring.level_events(authoring.cues(t), m, t["settings"]).orderBy("id").collect()
    assert [(x.id, x.label, x.window, x.lead, x.distance) for x in e] == [(0, "a", 0.7, 0.9, 20.0), (1, "h", 0.0, 0.0, 25.0), (2, "b", 0.7, 0.7, 30.0)]
    assert e[0].windowDistance == 3.5 and e[2].duration == 0.4
    h = authoring.hidden_spans(t, m).first()
    assert (h.startDistance, h.endDistance) == (70.0, 80.0)


def test_marker_leads_where_it_was_animated(spark):
    t = timeline(spark, binding=False)
    marker = {"arcs": spark.createDataFrame([("c", 0.5, 0.9, 1.2, 0.2)], "clip_id string, start double, peak double, end double, height double"), "clips": spark.createDataFrame([("c", 2.2)], "clip_id string, animated_until double"), "samples": spark.createDataFrame([("c", i / 15, 0.2, 0.8) for i in range(40)], "clip_id string, t double, x double, y double")}
    c = {(x.time, x.source) for x in authoring.cues(t, marker).collect()}
    assert c == {(0.5, "marker"), (2.5, "timeline"), (3.0, "timeline")}
    m = spark.createDataFrame([("c", 0.0, 0.0), ("c", 10.0, 100.0)], "clip_id string, t double, d double")
    g = spark.createDataFrame([("c", 0.0, 0.6), ("c", 100.0, 0.6)], "clip_id string, d double, y double")
    p = authoring.authored_path(m, g, t | {"pathAdjust": t["pathAdjust"].limit(0)}, marker, authoring.PathConfig(samples=200)).orderBy("i").toPandas()
    assert abs(p["y"].iloc[0] - 0.8) < 0.01 and abs(p["x"].iloc[60] - 0.3) < 0.02 and abs(p["y"].iloc[-1] - 0.5) < 1e-6


def test_step_easing_equals_its_loop(spark):
    r = np.random.default_rng(3)
    for _ in range(4):
        t = np.cumsum(r.uniform(0.05, 0.6, 60))
        v = np.repeat(r.integers(0, 3, 12), 5).astype(float)
        want = v.copy()
        for i in np.flatnonzero(np.diff(v) != 0):
            inside = (t >= t[i]) & (t <= t[i] + 0.45)
            if inside.sum() >= 2:
                a = np.clip((t[inside] - t[i]) / 0.45, 0, 1)
                want[inside] = v[i] + (v[i + 1] - v[i]) * a * a * (3 - 2 * a)
                want[t > t[i] + 0.45] = v[i + 1]
        d = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, v)], "k string, t double, v double")
        assert np.allclose([x.v for x in series.smooth_step(d, ["k"], "t", "v", 0.45).orderBy("t").collect()], want)


def _line_near(line, x, width, columns):
    px = min(max(int(x * width), 0), width - 1)
    seen = [v for v in line[max(0, px - columns) : px + columns + 1] if v != -1]
    return float(np.median(seen)) if seen else None


def test_snap_and_clamp_equal_loops(spark):
    r = random.Random(14)
    names = ["floor"] * 40 + ["rail"] * 50 + ["hedge"] * 30 + ["rail"] * 5 + ["sidewalk"] * 75
    p = [("c", i, i * 0.1, 0.6 + 0.05 * math.sin(i / 9), 0.3 + 0.001 * i, names[i]) for i in range(200)] + [("d", i, i * 0.1, 0.5, 0.4, "floor") for i in range(5)]
    width, height = 120, 80
    line = lambda mid: [r.choice([-1, mid, mid + 1, mid - 1]) for _ in range(width)]
    ledges = [("c", round(k * 0.35, 3), s, line(r.choice([40, 45, 5])), width, height) for k in range(40) for s in ("rail", "hedge") if r.random() < 0.7]
    surfaces = [("c", round(k * 0.12, 3), line(r.choice([55, 56, 56, 30 if k % 17 == 0 else 57])), r.choice([0.3, 0.3, 0.0]), width, height) for k in range(170)]
    until = 13.0
    schema = "clip_id string, i int, t double, y double, x double, s string"
    df = spark.createDataFrame(p, schema)
    got = authoring.snap_to_ledges(df, spark.createDataFrame(ledges, "clip_id string, t double, surface string, line array<int>, width int, height int"), spark.createDataFrame([("c", until)], "clip_id string, animated_until double")).orderBy("clip_id", "i").collect()
    own = [x for x in p if x[0] == "c"]
    times, known = sorted({x[1] for x in ledges}), {}
    for _, i, t, y, x, s in own:
        near = min(times, key=lambda k: (abs(k - t), k))
        row = next((e for e in ledges if e[1] == near and e[2] == s), None)
        if t > until or abs(near - t) > 0.5 or row is None or (v := _line_near(row[3], x, width, 20)) is None:
            continue
        local = float(np.median([q[3] for q in own if t - 0.5 <= q[2] < t + 0.5]))
        if abs(v / height - local) < 0.35:
            known[i] = v / height
    want, i = [x[3] for x in own], 0
    while i < len(own):
        end = next((j for j in range(i, len(own)) if names[j] != names[i]), len(own))
        at = [j for j in range(i, end) if j in known]
        if len(at) >= 2:
            want[i:end] = np.interp(range(i, end), at, [known[j] for j in at])
        i = end
    assert [x.y for x in got if x.clip_id == "c"] == pytest.approx(want) and len(known) > 20 and [x.y for x in got if x.clip_id == "d"] == [0.5] * 5
    surf = spark.createDataFrame(surfaces, "clip_id string, t double, run_line array<int>, coverage double, width int, height int")
    edges = {x.i: x.edge for x in authoring.ground_edges(df.filter("clip_id = 'c'"), surf).collect()}
    from tramline.functions.arrays import plausible_ground
    sure = {x.c for x in spark.createDataFrame([(c,) for c in (0.3, 0.0)], "c double").filter(plausible_ground(F.col("c"))).collect()}
    for _, i, t, y, x, s in own:
        seen = [v / height for e in surfaces if abs(e[1] - t) <= 0.25 and e[3] in sure and (v := _line_near(e[2], x, width, 25)) is not None] if s in authoring.GROUND else []
        ok = len(seen) >= 2 and max(seen) - min(seen) <= 0.15 and np.median(seen) <= 0.88
        assert (i in edges) == ok and (not ok or edges[i] == pytest.approx(float(np.median(seen))))
    low = authoring.clamp_to_ground(df, surf).filter("clip_id = 'c'").orderBy("i").collect()
    assert len(low) == 200 and all(x.y >= edges[x.i] - 0.05 for x in low if x.i in edges) and sum(x.i in edges for x in low) > 30
