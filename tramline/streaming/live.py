"""Live rides: sensor logs and replays as streams, and per-ride state for the GPS window, delayed playback and alerts.

State is typed and bounded: 32 fixes, the speeds of the last seconds, one gate. A batch's rows are taken in order of their own
time; what is not newer than a ride's last row is dropped. Each function has the batch form that it equals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tramline import schemas
from tramline.sources.sessions import _session, replay
from tramline.streaming.admission import _NAMES as ALERT_NAMES
from tramline.streaming.admission import OUTPUT as ALERTS
from tramline.streaming.admission import AdmissionSettings, _step, new_state

EARTH_M = 6_371_000.0


# ---------------------------------------------------------------- sources


def sensor_log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the sensor logs that arrive below path, as `read_sensor_log` gives them. A log arrives as whole pieces in its session's
    folder; a piece whose last line was cut (a phone that died) gives that line as `_bad` with its text in _corrupt_record.

    The checkpoint holds which pieces were read, so a restart neither loses nor repeats any."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.load(path).withColumn("session_id", _session()).filter(F.trim("value") != "")
    row = F.from_json("value", schemas.SENSOR_LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select("session_id", row.alias("r")).select("session_id", "r.*").withColumn("_bad", F.col("_corrupt_record").isNotNull())


def replay_stream(samples: DataFrame, step: float = 1.0, loops: int = 1, ticks_per_batch: int = 1) -> DataFrame:
    """Recorded samples (session_id, t, ...) as a stream that offers each by its own time: tick k brings the samples of
    [k, k + 1) steps after their session began; `tick` is added. After its last loop a session is silent.

    The clock is Spark's rate source, whose offsets a checkpoint keeps: a restart goes on at the next tick. Each batch joins the
    recorded samples on the tick; a large recording is best written partitioned by it, for then a batch reads its own ticks only."""
    rounds = replay(samples, loops)
    first = samples.groupBy("session_id").agg(F.min("t").alias("_first"))
    ticked = rounds.join(first, "session_id").withColumn("tick", F.floor((F.col("t") - F.col("_first")) / step).cast("long")).drop("_first")
    clock = samples.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", ticks_per_batch).option("startTimestamp", 0).load()
    return clock.select(F.col("value").alias("tick")).join(ticked, "tick")


# ---------------------------------------------------------------- GPS speed over a window of fixes

SPEEDS = "session_id string, t double, speed double, course double, accuracy double"
WINDOW, LEAST, MOST, FASTEST = 32, 2.5, 6.0, 70.0


def _way(a: np.ndarray, lat: float, lon: float) -> np.ndarray:
    """Metres from each of the fixes (t, lat, lon) to a place."""
    la, lo = np.radians(a[:, 1]), np.radians(a[:, 2])
    y, x = math.radians(lat), math.radians(lon)
    h = np.sin((y - la) / 2) ** 2 + np.cos(la) * math.cos(y) * np.sin((x - lo) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def _course(fix: np.ndarray, lat: float, lon: float) -> float:
    la, y, dl = math.radians(fix[1]), math.radians(lat), math.radians(lon - fix[2])
    return math.degrees(math.atan2(math.sin(dl) * math.cos(y), math.cos(la) * math.sin(y) - math.sin(la) * math.cos(y) * math.cos(dl))) % 360


def window_speeds(fixes: np.ndarray, rows: np.ndarray, fastest: float = FASTEST) -> tuple[np.ndarray, list[tuple]]:
    """(fixes to keep, [(t, speed, course, accuracy)]) after rows (t, lat, lon, accuracy) in order of time.

    The first fix of a ride has speed 0. Later ones have the median of way over time from the fixes of the last MOST seconds
    (WINDOW at most, this one included) that are at least LEAST old, and the course from the oldest of them; with none there is no row. A speed
    above `fastest` gives no row, and the window starts anew from its fix."""
    out = []
    for t, lat, lon, accuracy in rows:
        if not len(fixes):
            fixes = np.array([[t, lat, lon]])
            out.append((t, 0.0, None, accuracy))
            continue
        if t <= fixes[-1, 0]:
            continue
        fixes = np.vstack([fixes, (t, lat, lon)])[-WINDOW:]
        fixes = fixes[t - fixes[:, 0] <= MOST]
        old = fixes[:-1][t - fixes[:-1, 0] >= LEAST]
        if not len(old):
            continue
        speed = float(np.median(_way(old, lat, lon) / (t - old[:, 0])))
        if speed > fastest:
            fixes = fixes[-1:]
            continue
        out.append((t, speed, _course(old[0], lat, lon), accuracy))
    return fixes, out


def _usable(pdf: pd.DataFrame, most_accuracy: float) -> np.ndarray:
    pdf = pdf.sort_values("t", kind="stable")
    good = pdf["lat"].between(-90, 90) & pdf["lon"].between(-180, 180) & pdf["accuracy"].between(0, most_accuracy) & pdf["t"].notna()
    return pdf.loc[good, ["t", "lat", "lon", "accuracy"]].to_numpy(float)


def _speed_rows(session: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["t", "speed", "course", "accuracy"]).astype("float64")
    return out.assign(session_id=session)[["session_id", "t", "speed", "course", "accuracy"]]


def gps_speeds(fixes: DataFrame, fastest: float = FASTEST, most_accuracy: float = 75.0) -> DataFrame:
    """Speeds of fixes (session_id, t, lat, lon, accuracy) of whole rides; fixes that are no place or too coarse are left out."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _speed_rows(key[0], window_speeds(np.zeros((0, 3)), _usable(pdf, most_accuracy), fastest)[1])

    return fixes.select("session_id", "t", "lat", "lon", "accuracy").groupBy("session_id").applyInPandas(run, SPEEDS)


_FIX = StructType([StructField(c, DoubleType()) for c in ("t", "lat", "lon")])


class _GpsWindow(StatefulProcessor):
    def __init__(self, fastest: float, most_accuracy: float):
        self.fastest, self.most_accuracy = fastest, most_accuracy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fixes = handle.getListState("fixes", _FIX)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = np.array([tuple(f) for f in self.fixes.get()], float).reshape(-1, 3)
        kept, out = window_speeds(kept, _usable(pd.concat(list(rows)), self.most_accuracy), self.fastest)
        if len(kept):
            self.fixes.put([tuple(map(float, f)) for f in kept])
        yield _speed_rows(key[0], out)

    def close(self) -> None:
        pass


def gps_speeds_stream(stream: DataFrame, fastest: float = FASTEST, most_accuracy: float = 75.0) -> DataFrame:
    """The same over a stream; the state of a ride is its last WINDOW fixes. Needs the RocksDB state store."""
    d = stream.select("session_id", "t", "lat", "lon", "accuracy")
    return d.groupBy("session_id").transformWithStateInPandas(_GpsWindow(fastest, most_accuracy), SPEEDS, "Append", "None")


# ---------------------------------------------------------------- delayed playback

PLAYED = "session_id string, t double, speed double"


def played(history: np.ndarray, pdf: pd.DataFrame, delay: float, keep: float, fallback: float) -> tuple[np.ndarray, list[tuple]]:
    """(history to keep, [(t, speed)]) after rows (t, speed; a null speed asks) in order of time, samples first.

    An asker gets the speed `delay` before it, between the two samples there, held at both ends; the fallback, 0 at least, before any.
    Of what is older than `keep` one sample stays, so that an asker between it and the next finds both."""
    out = []
    for t, speed in pdf.assign(_ask=pdf["speed"].isna()).sort_values(["t", "_ask"], kind="stable")[["t", "speed"]].to_numpy(float):
        if math.isnan(speed):
            out.append((t, float(np.interp(t - delay, history[:, 0], history[:, 1])) if len(history) else max(0.0, fallback)))
        elif not len(history) or t > history[-1, 0]:
            history = np.vstack([history, (t, speed)])
            history = history[max(0, int(np.searchsorted(history[:, 0], t - keep, "left")) - 1) :]
    return history, out


class _Delayed(StatefulProcessor):
    def __init__(self, delay: float, keep: float, fallback: float):
        self.delay, self.keep, self.fallback = delay, keep, fallback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", StructType([StructField("t", DoubleType()), StructField("speed", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = np.array([tuple(x) for x in self.history.get()], float).reshape(-1, 2)
        kept, out = played(kept, pd.concat(list(rows)), self.delay, self.keep, self.fallback)
        if len(kept):
            self.history.put([tuple(map(float, x)) for x in kept])
        yield pd.DataFrame(out, columns=["t", "speed"]).astype("float64").assign(session_id=key[0])[["session_id", "t", "speed"]]

    def close(self) -> None:
        pass


def delayed_stream(stream: DataFrame, delay: float, keep: float | None = None, fallback: float = 0.0) -> DataFrame:
    """Answers (session_id, t, speed) to the askers of a stream (session_id, t, speed): rows with a speed are samples, rows without ask.

    keep: seconds of history, the delay and two more by default. Equals `asof.delayed` where samples lie closer than the delay."""
    d = stream.select("session_id", "t", "speed")
    return d.groupBy("session_id").transformWithStateInPandas(_Delayed(delay, max(keep if keep is not None else delay + 2.0, delay), fallback), PLAYED, "Append", "None")


# ---------------------------------------------------------------- alerts with the last surfaces and speed

#: Columns of the one stream that brings what a ride sees: lane events (kind set), surface reports and speeds.
FEED = "session_id string, t double, seq long, lane int, kind string, score double, surfaces array<string>, speed double"


def feed(events: DataFrame, reports: DataFrame, speed: DataFrame) -> DataFrame:
    """Lane events (session_id, t, seq, lane, kind, score), reports (session_id, t, surfaces) and speeds (session_id, t, speed) as one table or stream."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kinds = dict(p.strip().split(" ", 1) for p in FEED.split(", "))
    full = lambda df: df.select(*[F.col(c).cast(k).alias(c) if c in df.columns else none(c, k) for c, k in kinds.items()])
    own = [d.select(*[c for c in kinds if c in d.columns and c in wanted]) for d, wanted in ((events, {"session_id", "t", "seq", "lane", "kind", "score"}), (reports, {"session_id", "t", "surfaces"}), (speed, {"session_id", "t", "speed"}))]
    return full(own[0]).unionByName(full(own[1])).unionByName(full(own[2]))


class _Alerts(StatefulProcessor):
    def __init__(self, settings: dict):
        self.settings = AdmissionSettings(**settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", StructType([StructField("json", StringType())]))
        self.known = handle.getValueState("known", StructType([StructField("surfaces", ArrayType(StringType())), StructField("speed", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gate = json.loads(self.gate.get()[0]) if self.gate.exists() else new_state(self.settings)
        surfaces, speed = self.known.get() if self.known.exists() else (None, None)
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(_event=pdf["kind"].notna()).sort_values(["t", "_event", "seq"], kind="stable")
        seen = []
        for s, v, is_event in zip(pdf["surfaces"], pdf["speed"], pdf["_event"]):
            if not is_event and s is not None:
                surfaces = list(s)
            elif not is_event and not pd.isna(v):
                speed = float(v)
            seen.append((surfaces, speed))
        pdf["surfaces"], pdf["speed"] = pd.Series([s for s, _ in seen], index=pdf.index, dtype=object), pd.Series([v for _, v in seen], index=pdf.index, dtype="float64")
        out = _step(gate, pdf[pdf["_event"]].astype({"lane": int, "seq": int}), self.settings)  # whole numbers again, without the other rows' nulls
        self.gate.update((json.dumps(gate),))
        self.known.update((surfaces, speed))
        yield pd.DataFrame(out, columns=ALERT_NAMES[1:]).assign(session_id=key[0])[ALERT_NAMES]

    def close(self) -> None:
        pass


def alerts_stream(stream: DataFrame, settings: AdmissionSettings = AdmissionSettings()) -> DataFrame:
    """Admitted alerts of a stream as from `feed`, with the surfaces and the speed last known at each; equals `roadside.alerts`."""
    return stream.groupBy("session_id").transformWithStateInPandas(_Alerts(asdict(settings)), ALERTS, "Append", "None")
