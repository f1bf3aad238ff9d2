"""Whole documents: what is written, the readers give back."""

import json

from pyspark.sql import functions as F

from tramline.functions import scalar
from tramline.plans import clips as clip_plans
from tramline.plans import writing
from tramline.sources import documents

CLIPS = "clip_id string, file string, fps double, width int, height int, duration double"


def _tables(spark):
    t = {"clips": spark.createDataFrame([("a b+c:1%", "a.mov", 29.97, 960, 540, 12.34567), ("z", "z.mov", 30.0, 960, 540, 3.0)], CLIPS)}
    name = "a b+c:1%"
    t["map"] = spark.createDataFrame([(name, k / 3, k * 1.23456) for k in range(5)] + [("z", 0.0, 0.0), ("z", 1.0, 2.0)], "clip_id string, t double, d double").repartition(3)
    t["stops"] = spark.createDataFrame([(name, 2.0004, 3.0), (name, 0.5, 1.0)], "clip_id string, start double, end double")
    return t


def test_speed_documents(spark):
    t = _tables(spark)
    samples = t["map"].select("clip_id", "t", F.col("d").alias("speed"))
    info = spark.createDataFrame([("a b+c:1%", 0.7, 5)], "clip_id string, mean_confidence double, samples int")
    out = {x.clip_id: json.loads(x.value) for x in writing.speed_documents(t["clips"], t["map"], t["stops"], samples, info).collect()}
    a = out["a b+c:1%"]
    assert a["source"] == {"file": "a.mov", "fps": 29.97, "width": 960, "height": 540, "duration": 12.34567}
    assert a["timeToDistance"] == [[round(k / 3, 5), round(k * 1.23456, 5)] for k in range(5)] and a["speedCurve"][1] == [0.33333, 1.235]
    assert a["stoppedSpans"] == [{"start": 0.5, "end": 1.0}, {"start": 2.0, "end": 3.0}] and a["analysis"] == {"mean_confidence": 0.7, "samples": 5}
    assert out["z"]["stoppedSpans"] == [] and len(out["z"]["timeToDistance"]) == 2


def test_surface_levels(spark):
    t, n = _tables(spark), "a b+c:1%"
    segments = spark.createDataFrame([(n, 1, 3.0, 4.0), (n, 0, 0.0, 2.0)], "clip_id string, segment int, start double, end double")
    gaps = spark.createDataFrame([(n, 2.0, 3.0)], "clip_id string, start double, end double")
    path = spark.createDataFrame([(n, 0, 2.0, 0.61), (n, 0, 0.0, 0.123456), (n, 1, 3.0, 0.5)], "clip_id string, segment int, d double, y double")
    obstacles = spark.createDataFrame([(n, 0, 1.5, 1.0, 2.0, "car", 0.91239, 0.5, 0.25)], "clip_id string, id int, distance double, start_distance double, end_distance double, label string, confidence double, blockage double, height double")
    out = {x.clip_id: json.loads(x.value) for x in writing.surface_levels(t["clips"], t["map"], segments, gaps, path, obstacles, t["stops"]).collect()}
    a = out[n]
    assert a["version"] == 1 and a["totalDistance"] == 4.9382 and a["analysis"] == {}
    assert [(s["startDistance"], s["path"]) for s in a["surfaceSegments"]] == [(0.0, [[0.0, 0.12346], [2.0, 0.61]]), (3.0, [[3.0, 0.5]])]
    assert a["obstacles"] == [{"id": 0, "class": "car", "distance": 1.5, "startDistance": 1.0, "endDistance": 2.0, "blockage": 0.5, "height": 0.25, "confidence": 0.912}]
    assert a["surfaceGaps"] == [{"startDistance": 2.0, "endDistance": 3.0}] and out["z"]["surfaceSegments"] == [] == out["z"]["obstacles"]


def test_authored_levels_and_markers_round_trip(spark, tmp_path):
    t, n = _tables(spark), "a b+c:1%"
    made = t["clips"].withColumns({"playback_file": F.when(F.col("clip_id") == "z", "small.mp4"), "direction": F.lit(-1), "marker_diameter": F.lit(0.2), "mask_file": F.lit(None).cast("string")})
    path = spark.createDataFrame([(c, float(d), 0.6, 0.4, 0.7, "rail") for c in (n, "z") for d in (9, 0, 4)], "clip_id string, d double, y double, x double, z double, s string")
    events = spark.createDataFrame([(n, 1, "hop", 2.0), (n, 0, "jump", 1.0)], "clip_id string, id int, type string, time double")
    hidden = spark.createDataFrame([(n, 1.0, 2.0, 3.0, 4.0)], "clip_id string, startDistance double, endDistance double, startTime double, endTime double")
    strips = spark.createDataFrame([(n, 2.0, 0, 0.1, 0.2, 0.3, 0.4)], "clip_id string, d double, id int, x1 double, y1 double, x2 double, y2 double")
    docs = writing.authored_levels(made, t["map"], path, path.select("clip_id", "d", F.lit(0.5).alias("v")), events, hidden, strips, ["car", "pole"])
    documents.write_documents(docs, str(tmp_path / "levels"))
    level = documents.read_level(spark, str(tmp_path / "levels"))
    clips = {x.clip_id: x for x in level["clips"].collect()}
    assert set(clips) == {n, "z"} and (clips[n].playback, clips["z"].playback, clips[n].direction, clips[n].marker_diameter) == ("a.mov", "small.mp4", -1, 0.2)
    assert [x.d for x in level["path"].filter("clip_id = 'z'").collect()] == [0.0, 4.0, 9.0] and level["rejected"].count() == 0
    assert {(x.id, x.type) for x in level["events"].collect()} == {(0, "jump"), (1, "hop")} and level["foreground"].first().x2 == 0.3 and level["hidden"].first().endTime == 4.0 and level["speed"].count() == 6
    raw = json.loads(docs.filter("clip_id = 'z'").first().value)
    assert raw["occluderLabels"] == ["car", "pole"] and raw["events"] == [] and raw["foregroundMaskFile"] == ""

    marker = {
        "samples": spark.createDataFrame([(n, 0.2, 0.5, 0.61), (n, 0.1, 0.4, 0.6)], "clip_id string, t double, x double, y double"),
        "arcs": spark.createDataFrame([(n, 1.0, 1.5, 2.0, 0.3)], "clip_id string, start double, peak double, end double, height double"),
        "clips": spark.createDataFrame([(n, 9.5, 0.05), ("z", 0.0, 0.04)], "clip_id string, animated_until double, median_radius double"),
    }
    documents.write_documents(writing.marker_documents(t["clips"], marker), str(tmp_path / "marker"))
    back = documents.read_marker(spark, str(tmp_path / "marker"))
    assert [(x.clip_id, x.t, x.x, x.y) for x in back["samples"].collect()] == [(n, 0.1, 0.4, 0.6), (n, 0.2, 0.5, 0.61)]
    assert [tuple(x)[:5] for x in back["arcs"].select("clip_id", "start", "peak", "end", "height").collect()] == [(n, 1.0, 1.5, 2.0, 0.3)] and {(x.clip_id, x.animated_until, x.median_radius) for x in back["clips"].collect()} == {(n, 9.5, 0.05), ("z", 0.0, 0.04)}


def test_coverage_and_confidence(spark):
    pixels = spark.createDataFrame([("c", 0, "floor", x, y) for x in range(4) for y in range(2)] * 2 + [("c", 0, "rail", 0, 0)], "clip_id string, frame int, surface string, col int, row int")
    frames = spark.createDataFrame([("c", 0, 8, 4), ("c", 1, 8, 4)], "clip_id string, frame int, width int, height int")
    assert {(x.surface, x.coverage) for x in clip_plans.surface_coverage(pixels, frames).collect()} == {("floor", 0.25), ("rail", 1 / 32)}
    d = spark.createDataFrame([(0.0, 0.0), (1.5, 75.0), (1.5, 900.0), (15.75, 0.0), (30.0, 10.0), (400.0, 0.0)], "age double, acc double")
    got = [round(x.c, 6) for x in d.select(scalar.gps_confidence(F.col("age"), F.col("acc")).alias("c")).collect()]
    assert got == [1.0, 0.2, 0.2, 0.55, 0.3, 0.05]
