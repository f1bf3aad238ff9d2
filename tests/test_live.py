"""Streams equal their batch forms, over several batches and over a restart from the checkpoint."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import asof
from tramline.plans import roadside
from tramline.sources import sessions
from tramline.streaming import live


def run(df, tmp_path, name, times=1):
    """Run a stream until its input is used up, `times` times from one checkpoint; all rows it wrote."""
    for _ in range(times):
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def in_parts(rows, spark, path, schema, cuts):
    """Rows as files in order of time, which the stream takes one at a time."""
    rows = sorted(rows, key=lambda x: x[1])
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sensor_log_stream_equals_batch_and_restarts(spark, tmp_path):
    r = random.Random(1)
    text = lambda n: "\n".join(json.dumps({"type": "gps", "seq": i, "t": i + r.random(), "lat": 37.0, "lon": -122.0, "speed": 3.0, "hacc": 5.0}) for i in range(n))
    (tmp_path / "in" / "s1").mkdir(parents=True), (tmp_path / "in" / "s2").mkdir()
    (tmp_path / "in" / "s1" / "sensors.0.jsonl").write_text(text(20))
    (tmp_path / "in" / "s2" / "sensors.0.jsonl").write_text(text(5) + '\n{"type": "gps", "seq": 5, "t": 5.')
    stream = live.sensor_log_stream(spark, f"{tmp_path}/in", 1)
    assert run(stream, tmp_path, "out").count() == 26
    (tmp_path / "in" / "s1" / "sensors.1.jsonl").write_text(text(7) + "\n\n")
    out = run(stream, tmp_path, "out", 2)
    batch = sessions.read_sensor_log(spark, f"{tmp_path}/in/*")
    columns = ["session_id", "type", "seq", "t", "_bad"]
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    assert out.filter("_bad").count() == 1 and sessions.gps(out).count() == 32


def test_replay_offers_samples_by_their_time(spark, tmp_path):
    rows = [("a", 100 + 0.4 * i, float(i)) for i in range(12)] + [("b", 7.0, 1.0), ("b", 9.5, 2.0)]
    samples = spark.createDataFrame(rows, "session_id string, t double, v double")
    stream = live.replay_stream(samples, step=1.0, loops=2, ticks_per_batch=4)
    got = []
    for k in range(1, 5):  # each start is a restart, and brings the next four ticks
        out = run(stream, tmp_path, "replay")
        got.append(out.count())
        assert out.agg(F.max("tick")).first()[0] < 4 * k
    whole = sessions.replay(samples, 2)
    assert got == sorted(got) and got[0] < got[-1] == whole.count()
    assert sorted(map(tuple, out.select("session_id", "t", "v").collect())) == sorted(map(tuple, whole.select("session_id", "t", "v").collect()))


FIX = "session_id string, t double, lat double, lon double, accuracy double"


def fixes():
    r = random.Random(8)
    rows = []
    for s in ("a", "b", "c"):
        lat = 37.0
        for i in range(90):
            lat += r.random() * 1e-4
            jump = 0.05 if s == "b" and i in (30, 60) else 0.0  # a reflected signal: far too fast
            rows.append((s, i * 0.5 + (3.0 if i > 50 else 0.0), lat + jump, -122.0 + i * 1e-5, 5.0 if i % 13 else 200.0))
    return [*rows, ("a", 10.0, 37.0, -122.0, 5.0), ("d", 1.0, 95.0, 0.0, 5.0), ("d", 2.0, 5.0, 0.0, 5.0)]


def loop_speeds(rows):
    from math import asin, cos, radians, sin, sqrt
    from statistics import median

    out, window, begun = [], [], False
    for _, t, lat, lon, acc in sorted(rows, key=lambda x: x[1]):
        if not (-90 <= lat <= 90) or acc > 75 or window and t <= window[-1][0]:
            continue
        window.append((t, lat, lon))
        while len(window) > 1 and (len(window) > 32 or t - window[0][0] > 6):
            window.pop(0)
        if not begun:
            begun = True
            out.append((t, 0.0))
            continue
        speeds = [2 * 6371000 * asin(sqrt(sin(radians(lat - b) / 2) ** 2 + cos(radians(b)) * cos(radians(lat)) * sin(radians(lon - c) / 2) ** 2)) / (t - a) for a, b, c in window[:-1] if t - a >= 2.5]
        if speeds and median(speeds) > 70:
            window = window[-1:]
        elif speeds:
            out.append((t, median(speeds)))
    return out


def test_gps_speeds(spark, tmp_path):
    rows = fixes()
    batch = live.gps_speeds(spark.createDataFrame(rows, FIX)).collect()
    for s in "abcd":
        want = loop_speeds([x for x in rows if x[0] == s])
        got = sorted((x.t, x.speed) for x in batch if x.session_id == s)
        assert [t for t, _ in got] == [t for t, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-6)
    assert any(x.session_id == "b" for x in batch) and [x.speed for x in batch if x.session_id == "d"] == [0.0]
    ordered = [x for x in rows if x[:2] != ("a", 10.0)]  # in the stream a late fix is dropped only once newer ones were seen
    stream = live.gps_speeds_stream(in_parts(ordered, spark, f"{tmp_path}/fixes", FIX, [40, 41, 200]))
    out = run(stream, tmp_path, "speeds", 2).collect()
    want = live.gps_speeds(spark.createDataFrame(ordered, FIX)).collect()
    key = lambda x: (x.session_id, x.t, round(x.speed, 9), x.course and round(x.course, 6), x.accuracy)
    assert sorted(map(key, out), key=repr) == sorted(map(key, want), key=repr)


def test_delayed_playback(spark, tmp_path):
    r = random.Random(4)
    schema = "session_id string, t double, speed double"
    samples = [(s, i * 0.3 + r.random() * 0.1, r.random() * 9) for s in "ab" for i in range(80)]
    asks = [(s, i * 0.21, None) for s in "abc" for i in range(110)]
    stream = live.delayed_stream(in_parts(samples + asks, spark, f"{tmp_path}/rows", schema, [90, 91, 300]), 1.5)
    out = {(x.session_id, x.t): x.speed for x in run(stream, tmp_path, "played", 2).collect()}
    batch = asof.delayed(spark.createDataFrame(asks, schema).drop("speed"), spark.createDataFrame(samples, schema), ["session_id"], "t", "speed", 1.5)
    want = {(x.session_id, x.t): x.speed for x in batch.collect()}
    first = {s: min(t for k, t, _ in samples if k == s) for s in "ab"}
    assert len(out) == len(want) == len(asks)
    for (s, t), v in want.items():
        assert out[s, t] == pytest.approx(v if t >= first.get(s, 1e9) else 0.0)  # batch knows the first sample before it came


def test_alerts_stream_equals_batch(spark, tmp_path):
    r = random.Random(12)
    events = [(s, i * 0.37, i, r.randrange(3), r.choice(["vehicle", "person", "bench", "sign"]), 0.3 + r.random() * 0.7) for s in "ab" for i in range(120)]
    reports = [(s, i * 2.0 + 0.01, [r.choice(["road", "sidewalk", "none", None]) for _ in range(3)]) for s in "ab" for i in range(22)]
    speed = [(s, i * 0.9, r.random() * 12) for s in "ab" for i in range(50)]
    e = spark.createDataFrame(events, "session_id string, t double, seq long, lane int, kind string, score double")
    p = spark.createDataFrame(reports, "session_id string, t double, surfaces array<string>")
    v = spark.createDataFrame(speed, "session_id string, t double, speed double")
    rows = [tuple(x) for x in live.feed(e, p, v).collect()]
    times = sorted(x[1] for x in rows)
    cuts = [next(i for i, t in enumerate(times) if t > at) for at in (5.0, 20.0, 33.3)]
    out = run(live.alerts_stream(in_parts(rows, spark, f"{tmp_path}/feed", live.FEED, cuts)), tmp_path, "alerts", 2)
    want = roadside.alerts(e, p, v)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3
