"""Jobs over small synthetic sessions and clips; streams give what batches give."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from tramline.plans import clips, roadside, speed
from tramline.sources import documents, rle, sessions
from tramline.streaming import admission, fusion, reports, smooth


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_sessions_are_ingested(spark, tmp_path):
    good, bad = tmp_path / "one", tmp_path / "two"
    step = 180 / (math.pi * 6_371_000)
    lines = [json.dumps({"type": "begin", "t": 0})] + [json.dumps({"type": "gps", "seq": i, "t": 100.0 + i + (5 if i > 4 else 0), "lat": 37 + i * 10 * step, "lon": -122.0, "speed": 10.0 if i else -1, "course": -1, "hacc": 5.0}) for i in range(8)]
    lines += [json.dumps({"type": "motion", "seq": i, "t": 100 + i / 100, "uax": 1.0, "uay": 0, "uaz": 0, "qw": 1, "qx": 0, "qy": 0, "qz": 0}) for i in range(101)] + ["", '{"type": "gps", "t": 1']
    write(good / "sensors.jsonl", "\n".join(lines))
    write(good / "session.json", json.dumps({"clock": {"videoStartHostTime": 101.0, "stopHostTime": 120.0}, "units": {"a": "g"}}))
    write(good / "video.mov", "x")
    write(bad / "sensors.jsonl", json.dumps({"type": "gps", "t": 1.0}))
    write(bad / "session.json", json.dumps({"clock": {"videoStartHostTime": 0}}))
    out = sessions.ingest_sessions(spark, str(tmp_path))
    missing = {r.session_id: r.missing for r in out["missing"].collect()}
    assert missing == {"one": [], "two": ["video.mov"]}
    assert {r.session_id: r.reason for r in out["meta"].collect()} == {"one": None, "two": "no start clock"}
    s = {r.session_id: r for r in out["summary"].collect()}["one"]
    assert s.duration == 19 and s.fixes == 8 and s.usable == 7 and abs(s.metres - 70) < 0.1 and abs(s.motion_hz - 100) < 1e-6 and s.gaps == 1 and abs(s.mean_kmh - 36) < 1e-9
    assert out["bad_lines"].count() == 1
    assert abs(out["motion"].first().ax - 9.80665) < 1e-9 and out["gps"].filter("speed is null").count() == 2
    row = sessions.speed_lines(out["speed"]).orderBy("t_video_s").first()
    assert (row.t_video_s, row.speed_mps, row.hacc_m) == ("0.000", "10.000", "5.0")
    track = json.loads(out["tracks"].first().value)
    assert len(track["geometry"]["coordinates"]) == 7 and track["geometry"]["coordinates"][0][0] == -122.0


def test_traces(spark):
    text = ["# comment", "", "g,1.0,5.0,3.0,90", "g,x,5.0,3.0,90", "m,1.0,0,0", "g,1.0,2"]
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate(text)], "session_id string, line_no int, value string")
    got = sessions.parse_trace(d, ["session_id"])
    assert got.count() == 1 and got.first().course == 90
    more = spark.createDataFrame([("s", 0, "g,5,1,2,-1"), ("s", 1, "m,5.5,1,2,3,0,0,0,1")], "session_id string, line_no int, value string")
    samples = sessions.parse_trace(more, ["session_id"])
    again = sessions.parse_trace(sessions.trace_lines(samples), ["session_id"]).orderBy("t").collect()
    assert [r.t for r in again] == [0.0, 0.5] and again[0].course is None and again[1].az == 3.0
    assert [r.t for r in sessions.replay(samples, 2).orderBy("t").collect()] == [5.0, 5.5, 5.5, 6.0]


def test_run_lengths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("4 2 0 3 1 5")
    (tmp_path / "b.txt").write_text("4 2 0 3")
    runs = rle.read_class_maps(spark, str(tmp_path))
    assert {r.image_id.split("/")[-1]: r.complete for r in runs.collect()} == {"a.txt": True, "b.txt": False}
    whole = runs.filter("complete")
    assert [r.class_id for r in rle.decode(whole.withColumn("k", F.lit(1)), ["k"], "class_id").orderBy("pos").collect()] == [0] * 3 + [1] * 5
    assert rle.class_map_text(whole).first().text == "4 2 0 3 1 5"


def test_detections_round_trip(spark, tmp_path):
    doc = {"width": 960, "height": 540, "frames": [{"index": 0, "time": 0.0, "detections": []}, {"index": 5, "time": 0.16667, "detections": [{"label": "car", "score": 0.9, "box": [1.0, 2.0, 30.5, 40.25]}]}]}
    (tmp_path / "clip.json").write_text(json.dumps(doc))
    frames, found = documents.read_detections(spark, str(tmp_path))
    assert frames.count() == 2 and found.first().x2 == 30.5 and found.first().clip_id == "clip"
    assert json.loads(documents.detection_documents(frames, found).first().value) == doc


def test_levels(spark, tmp_path):
    doc = {"version": 3, "source": {"file": "a.mov"}, "screenSpeed": [{"d": 1, "v": 0.5}], "path": [{"d": 0, "y": 0.6, "x": 0, "z": 0, "s": ""}, {"d": 9, "y": 0.7, "x": 0.4, "z": 0.8, "s": "rail"}], "timeToDistance": [{"t": 0, "d": 0}, {"t": 1, "d": 9}], "events": [{"id": 1, "type": "fly", "time": 0.5}]}
    (tmp_path / "good.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text(json.dumps({"version": 1, "path": [{"d": 0}]}))
    t = documents.read_level(spark, str(tmp_path))
    p = t["path"].orderBy("d").collect()
    assert (p[0].z, p[0].x, p[0].s, p[1].z) == (0.6, 0.35, "floor", 0.8) and t["events"].first().type == "jump" and t["rejected"].first().clip_id == "bad"
    c = t["clips"].first()
    assert (c.playback, c.direction, t["speed"].first().v) == ("a.mov", -1, 0.5)
    text = documents.level_documents(t["clips"].select("clip_id", "direction"), {"path": (t["path"], "d"), "timeToDistance": (t["map"], "t")}, 3).first().value
    assert [x["d"] for x in json.loads(text)["path"]] == [0.0, 9.0]


def test_caches(spark, tmp_path):
    np.savez(tmp_path / "c.npz", indices=np.arange(3), times=np.arange(3) / 15, run_lines=np.full((3, 8), 4, np.int16), coverage=np.full(3, 0.3), size=np.array([8, 10]))
    s = documents.read_surface_cache(spark, str(tmp_path / "c.npz"))
    assert s.count() == 3 and s.first().run_line == [4] * 8 and s.first().height == 10
    np.savez(tmp_path / "l.npz", times=np.arange(2) / 15, size=np.array([8, 10]), line_rail=np.full((2, 8), -1, np.int16))
    assert [r.surface for r in documents.read_ledge_cache(spark, str(tmp_path / "l.npz")).collect()] == ["rail", "rail"]
    values = np.zeros((2, 85), "<f4")
    body = b"".join(np.int32(i).tobytes() + values[i].tobytes() for i in range(2))
    (tmp_path / "r.bin").write_bytes(np.array([2, 85], "<i4").tobytes() + body)
    assert documents.read_raw_rows(spark, str(tmp_path / "r.bin")).count() == 2


def surfaces(spark, notch=range(0), frames=90):
    rows = []
    for f in range(frames):
        line = [60] * 200
        if f in notch:
            line[60:81] = [75] * 21
        rows.append(("c", f, f / 15, line, 0.3, 200, 100))
    return spark.createDataFrame(rows, "clip_id string, frame int, t double, run_line array<int>, coverage double, width int, height int")


def test_obstacles(spark):
    s = surfaces(spark, range(40, 46))
    m = spark.createDataFrame([("c", 0.0, 0.0), ("c", 10.0, 100.0)], "clip_id string, t double, d double")
    d = spark.createDataFrame([("c", 42, 42 / 15, 0, "car", 0.8, 60.0, 10.0, 90.0, 50.0, 200, 100), ("c", 42, 42 / 15, 1, "tree", 0.9, 60.0, 10.0, 90.0, 50.0, 200, 100)], "clip_id string, frame int, t double, pos int, label string, score double, x1 double, y1 double, x2 double, y2 double, width int, height int")
    e = clips.obstacle_events(s, m, d).collect()
    assert len(e) == 1 and e[0].label == "car" and abs(e[0].start_distance - 400 / 15) < 1e-6 and e[0].blockage == 1.0 and abs(e[0].height - 0.2) < 1e-9
    assert clips.obstacle_events(surfaces(spark), m, d).count() == 0
    runs, holes, path = clips.surface_segments(s, m)
    assert runs.count() == 2 and holes.count() == 1
    q = clips.level_quality(runs, holes, path, clips.obstacle_events(s, m, d)).first()
    assert 0.8 < q.runnable < 1 and q.gaps == 1 and q.obstacles == 1
    short = clips.column_profile(surfaces(spark, frames=4)).collect()
    assert all(abs(r.baseline - 0.6) < 1e-9 and r.free_ground for r in short)


def test_occluders(spark):
    box = [("c", i, i / 10, 0, "pole", 0.9, 0.36 * 960, 0.1 * 540, 0.40 * 960, 0.7 * 540, 960, 540) for i in range(5)] + [("c", 7, 0.7, 0, "pole", 0.9, 0.36 * 960, 0.0, 0.4 * 960, 0.5 * 540, 960, 540)]
    d = spark.createDataFrame(box, "clip_id string, frame int, t double, pos int, label string, score double, x1 double, y1 double, x2 double, y2 double, width int, height int")
    line = spark.createDataFrame([("c", 0.0, 0.6, 0.4), ("c", 9.0, 0.6, 0.4)], "clip_id string, t double, y double, x double")
    none = spark.createDataFrame([], "clip_id string, start double, end double")
    got = clips.occluder_tracks(d, line, none, none)
    assert got.count() == 5 and got.select("track_id").distinct().count() == 1
    hidden = spark.createDataFrame([("c", 0.0, 9.0)], "clip_id string, start double, end double")
    assert clips.occluder_tracks(d, line, hidden, none).count() == 0
    forced = clips.occluder_tracks(d, line, none, hidden)
    assert forced.count() == 6


def test_marker(spark):
    t = np.arange(0, 20, 1 / 15)
    rows = []
    for i, a in enumerate(t):
        y = 0.8 - max(0, 0.2 * (1 - ((a - 6) / 0.5) ** 2)) * (abs(a - 6) < 0.5)
        rows.append(("c", i, float(a), 0, 0.3 + min(float(a), 12.0) / 100, float(y), 2000.0, 160.0, 960, 540))
        rows.append(("c", i, float(a), 1, 0.95, 0.1, 2000.0, 900.0, 960, 540))
    d = spark.createDataFrame(rows, "clip_id string, frame int, t double, pos int, cx double, cy double, area double, perimeter double, frame_w int, frame_h int")
    out = clips.marker_track(d)
    c = out["clips"].first()
    assert c.arcs == 1 and abs(c.sample_share - 1) < 1e-9 and 10 < c.animated_until < 13


def test_ambient(spark):
    s = spark.createDataFrame([("c", i / 10) for i in range(20)], "clip_id string, t double")
    p = spark.createDataFrame([("c", i, i / 10, *([0.4] * 3 if i < 12 else [0.1] * 3)) for i in range(16)], "clip_id string, frame int, t double, r double, g double, b double")
    out = clips.ambient_light(s, p, 2, 30.0).orderBy("t").collect()
    assert len(out) == 20 and abs(out[0].r - 1) < 1e-9 and out[-1].r == 0.35
    assert {x.r for x in clips.ambient_light(s, p.limit(0), 2, 30.0).collect()} == {1.0}


def test_speed_of_a_clip(spark):
    rows = []
    for f in range(1, 60):
        for k in range(20):
            rows.append(("c", f, f / 30, (f - 1) / 30, k, -6.0 if k < 18 else 4.0, 1, 3.0, None if 20 <= f < 25 else True))
    d = spark.createDataFrame(rows, "clip_id string, frame int, t double, prev_t double, feature int, dx double, status int, error double, masked boolean")
    samples, diag = speed.speed_curve(d)
    s = samples.orderBy("t").collect()
    assert len(s) == 59 and all(abs(x.speed - 180) < 1e-6 for x in s) and s[22].raw is None
    g = diag.first()
    assert g.direction == 1 and abs(g.unmeasurable - 5 / 59) < 1e-9 and g.error is None and abs(g.mean_confidence - 0.9 * 54 / 59) < 0.1
    doc = speed.distance_document(samples)
    assert doc["violations"].count() == 0 and doc["even"].count() == 400 and doc["stops"].count() == 0


def test_lane_surfaces(spark):
    runs = []
    for y in range(60):
        runs += [("i", 90, 60, 3 * y + 1, 1, 30), ("i", 90, 60, 3 * y + 2, 0, 30), ("i", 90, 60, 3 * y + 3, 8, 30)]
    out = roadside.lane_surfaces(spark.createDataFrame(runs, "image_id string, width int, height int, run int, class_id int, length int"))
    lanes = {r.lane: (r.surface, r.fraction) for r in out["lanes"].collect()}
    assert lanes == {0: ("sidewalk", 1.0), 1: ("road", 1.0), 2: ("none", 0.0)}
    i = out["images"].first()
    assert i.dominant == "sidewalk" and i.vegetation_left == 0 and i.vegetation_right == 1


def test_raw_rows_become_lane_events(spark):
    values = [0.0] * 85
    values[:5] = [0.5, 0.5, math.log(12), math.log(9), 0.9]
    values[5 + 2] = 1.0
    raw = spark.createDataFrame([("i", 52 * 40 + 10, values), ("i", 52 * 40 + 11, values)], "image_id string, row_idx int, values array<float>")
    boxes = roadside.decode_rows(raw)
    assert boxes.count() == 1 and boxes.first().class_id == 2
    images = spark.createDataFrame([("i", 416, 416)], "image_id string, src_w int, src_h int")
    e = roadside.lane_events(roadside.to_source(boxes, images)).first()
    assert e.kind == "vehicle" and e.lane == 0 and abs((e.x1 + e.x2) / 2 - 84) < 0.01


def ride(spark, gps_every=1.0, hz=50, course=90.0):
    """Ten seconds standing, ten of 1.2 m/s2, twenty of cruise, a brake of -1.5, then standing."""
    v, truth, motion, fixes = 0.0, [], [], []
    for i in range(int(60 * hz)):
        t = i / hz
        a = 1.2 if 10 <= t < 20 else -1.5 if 40 <= t < 48 else 0.0
        v = max(0.0, v + a / hz)
        truth.append(("s", t, v))
        motion.append(("s", t, a if v > 0 or a > 0 else 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
        if gps_every and i % int(hz * gps_every) == 0:
            fixes.append(("s", t, v, 8.0, course))
    g = spark.createDataFrame(fixes or [], "session_id string, t double, speed double, accuracy double, course double")
    m = spark.createDataFrame(motion, "session_id string, t double, ax double, ay double, az double, qx double, qy double, qz double, qw double")
    return g, m, spark.createDataFrame(truth, "session_id string, t double, speed double")


def test_fusion_follows_a_ride(spark):
    g, m, truth = ride(spark)
    est = fusion.estimate_rides(g, m)
    s = speed.evaluate_rides(est, truth).first()
    assert s.mae < 1.0 and s.p95 < 2.5 and s.false_stops == 0 and s.stop_latency < 1.25
    assert {r.event for r in fusion.stop_events(est).collect()} >= {"sudden_stop"}
    blind = fusion.estimate_rides(g.limit(0), m)
    assert {r.health for r in blind.select("health").distinct().collect()} == {"missing"} and blind.filter("t between 30 and 39 and not stationary").count() > 0


def test_hard_stop_without_gps(spark):
    c = fusion.FusionSettings()
    s = fusion.new_state()
    for i in range(3):
        fusion.on_gps(s, i * 1.0, 10.0, 5.0, 90.0, c)
    s["axis"] = [1.0, 0.0, 0.0]
    t, seen, stopped = 2.0, False, None
    for i in range(250):
        t += 0.02
        fusion.on_motion(s, t, [-4.5 if i < 100 else 0.0, 0, 0], [0, 0, 0, 1], c)
        e = fusion.on_tick(s, t, c)
        seen |= e["hard_braking"]
        if stopped is None and e["stationary"]:
            stopped = t
    assert seen and stopped is not None and stopped < 2.0 + 2.0 + 0.8


def test_streams_equal_batches(spark, tmp_path):
    g, m, _ = ride(spark, hz=10)
    rows = fusion.samples(g, m).withColumn("event_ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    rows.repartition(1).sortWithinPartitions("t", "kind").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = fusion.estimate_rides_stream(stream).writeStream.format("memory").queryName("rides").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.t, r.speed, r.stationary) for r in fusion.estimate_rides(g, m).collect()}
    got = {(r.t, r.speed, r.stationary) for r in spark.table("rides").collect()}
    assert batch <= got and len(got - batch) <= 1


EVENTS = "session_id string, t double, seq long, lane int, kind string, score double, speed double, surfaces array<string>"


def test_admission(spark, tmp_path):
    road = ["road"] * 3
    same = spark.createDataFrame([("s", i * 0.2, i, 1, "person", 0.9, 10.0, road) for i in range(5)], EVENTS)
    assert admission.admit_alerts(same).count() == 1
    many = [("s", i * 0.1, i, i % 3, "person", 0.9, 10.0, road) for i in range(300)]
    d = spark.createDataFrame(many, EVENTS)
    out = sorted((r.t, r.lane, r.arrival) for r in admission.admit_alerts(d).collect())
    assert out
    for t, _, arrival in out:
        assert {lane for _, lane, a in out if abs(a - arrival) < 0.9} != {0, 1, 2}
        assert sum(1 for s, _, _ in out if t - 1 <= s <= t) <= 2
    assert admission.admit_alerts(spark.createDataFrame([("s", 0.0, 0, 0, "vehicle", 0.9, 10.0, ["sidewalk", "road", "road"]), ("s", 1.0, 1, 1, "person", 0.9, 1.0, road), ("s", 2.0, 2, 1, "person", 0.9, 10.0, None)], EVENTS)).count() == 0
    d.repartition(1).sortWithinPartitions("t").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = admission.admit_alerts_stream(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.t, r.lane, r.arrival) for r in spark.table("alerts").collect()) == out


def test_alerts_take_the_last_report(spark):
    e = spark.createDataFrame([("s", 5.0, 0, 1, "person", 0.9)], "session_id string, t double, seq long, lane int, kind string, score double")
    reports_ = spark.createDataFrame([("s", 0.0, ["none"] * 3), ("s", 4.0, ["road"] * 3), ("s", 6.0, ["none"] * 3)], "session_id string, t double, surfaces array<string>")
    v = spark.createDataFrame([("s", 1.0, 9.0)], "session_id string, t double, speed double")
    assert roadside.alerts(e, reports_, v).count() == 1


def test_smoothing(spark):
    d = spark.createDataFrame([("a", i * 0.1, 10.0 if i < 30 else 0.0, i != 40, i == 45) for i in range(60)], "k string, t double, v double, ok boolean, stop boolean")
    v = [r.smooth for r in smooth.asymmetric_ema(d, ["k"], "t", "v", valid="ok", reset="stop").orderBy("t").collect()]
    assert v[0] == 10 and v[39] > 0 and v[40] == 0 and v[45] == 0
    r = [x.rate for x in smooth.condition_rate(d, ["k"], "t", "v").orderBy("t").collect()]
    assert max(r) <= 1.6 and r[-1] == 0


def test_reports(spark):
    d = spark.createDataFrame([("a", i * 20 if i > 3 else i, float(i)) for i in range(6)], "k string, s long, speed double").withColumn("event_ts", F.timestamp_seconds(F.col("s")))
    assert reports.session_report(d, ["k"], watermark=None).count() == 3
    assert reports.window_report(d, ["k"], size="10 seconds", watermark=None).count() == 3
