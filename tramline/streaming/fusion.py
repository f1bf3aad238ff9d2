"""Speed of a ride from GPS fixes and motion readings: one state a ride, stepped in time order.

The state is a small dict, so the same step serves a batch (one ride a group) and a stream (kept state).
Fixes give the speed; acceleration along a learned forward axis carries it between fixes, and tells a stop
by the shape of the braking before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class FusionSettings:
    stale: float = 1.5
    missing: float = 30.0
    return_blend: float = 1.5
    hard_braking: float = -2.3
    hard_braking_time: float = 0.18
    dead_zone: float = 0.2
    gps_weight: float = 0.9
    max_acceleration: float = 8.0
    max_speed: float = 80.0
    stop_hold: float = 0.75
    retention: float = 0.999
    max_accuracy: float = 75.0
    standing: float = 0.75
    loss_timeout: float = 15.0


# Evidence thresholds of the estimator.
START_ACCELERATION, START_TIME, START_TIME_GPS, START_SIMILARITY, START_COURSE = 0.55, 0.18, 0.12, 0.72, 45.0
MOVING_FIXES, GPS_SUPPRESSED, QUIET_UNLOCK = 3, 5.0, 0.3
AXIS_GPS, AXIS_MOTION, AXIS_RATE, AXIS_SIMILARITY = 0.3, 0.08, 0.25, 0.5
SMOOTHING, BIAS_TIME, BIAS_LIMIT = 0.12, 8.0, 0.35
SERVICE_BRAKING, LONG_TIME, LONG_DROP, LONG_RESIDUAL, LONG_SHARE = -0.35, 2.5, 1.5, 4.0, 0.5
SHORT_DROP, SHORT_RESIDUAL, SHORT_RESIDUAL_SHARE, SHORT_SHARE = 1.0, 2.0, 4.0, 0.82
QUIET_STOP, BRAKING_RESET = 0.35, 1.5
COURSE_SPEED, COURSE_CHANGE, COURSE_ACCURACY, MOTION_STALE = 2.5, 100.0, 0.6, 1.0

ZERO = [0.0, 0.0, 0.0]
OUTPUT = "session_id string, t double, speed double, acceleration double, confidence double, health string, stationary boolean, braking boolean, hard_braking boolean, sudden_stop boolean, signal_lost boolean"


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a):
    return math.sqrt(_dot(a, a))


def _unit(a):
    n = _norm(a)
    return [x / n for x in a] if n > 1e-9 else list(ZERO)


def _lerp(a, b, k):
    return [x + (y - x) * k for x, y in zip(a, b)]


def _slerp(a, b, k):
    """Between two unit vectors along the arc; opposite ones meet on a straight line."""
    angle = math.acos(max(-1.0, min(1.0, _dot(a, b))))
    if angle < 1e-6 or math.pi - angle < 1e-6:
        return _unit(_lerp(a, b, k))
    return _unit([(math.sin((1 - k) * angle) * x + math.sin(k * angle) * y) / math.sin(angle) for x, y in zip(a, b)])


def _turn(q, v):
    n = sum(c * c for c in q)
    if not n >= 0.5 or math.isinf(n):
        return list(v)
    x, y, z, w = (c / math.sqrt(n) for c in q)
    t = [2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])]
    return [v[0] + w * t[0] + y * t[2] - z * t[1], v[1] + w * t[1] + z * t[0] - x * t[2], v[2] + w * t[2] + x * t[1] - y * t[0]]


def _wrap(a):
    return (a + 540.0) % 360.0 - 180.0


def new_state() -> dict:
    return {
        "speed": 0.0, "acc": 0.0, "still": True, "fix": None, "fix_speed": 0.0, "fix_acc": 0.0, "motion_t": None, "tick_t": None, "smooth": ZERO, "bias": ZERO, "sum": ZERO,
        "axis": ZERO, "start_axis": ZERO, "start": 0.0, "quiet": QUIET_UNLOCK, "moving": 0, "course": None, "last_course": None, "hold": -1.0, "deaf": -1.0, "blend": None,
        "brake": 0.0, "drop": 0.0, "entry": 0.0, "brake_quiet": 0.0, "peak": 0.0, "braking": False, "hard": False,
    }


def _release_brake(s: dict) -> None:
    s.update(brake=0.0, drop=0.0, entry=0.0, brake_quiet=0.0, peak=0.0, braking=False, hard=False)


def _stand(s: dict, t: float, event: bool, c: FusionSettings) -> None:
    s.update(still=True, moving=0, course=None, last_course=None, start=0.0, start_axis=ZERO, quiet=0.0, speed=0.0)
    if event:
        s["hold"], s["deaf"] = max(s["hold"], t + c.stop_hold), max(s["deaf"], t + GPS_SUPPRESSED)
    _release_brake(s)


def _depart(s: dict, t: float, course: float | None, speed: float) -> float:
    """A moving fix while standing: the speed to believe, 0 until there is evidence of a departure."""
    felt = s["start"] >= START_TIME_GPS
    if not felt and t < s["deaf"]:
        s.update(moving=0, course=None)
        return 0.0
    same = course is None or s["course"] is None or abs(_wrap(course - s["course"])) <= START_COURSE
    s.update(moving=s["moving"] + 1 if same else 1, course=course)
    if felt or s["moving"] >= MOVING_FIXES:
        s["still"] = False
        return speed
    return 0.0


def _learn_axis(s: dict, speed: float, accuracy: float, course: float | None, c: FusionSettings) -> None:
    if course is not None and speed >= COURSE_SPEED and accuracy <= c.max_accuracy * COURSE_ACCURACY:
        if s["last_course"] is not None and _norm(s["axis"]) ** 2 >= 0.5:
            change = _wrap(course - s["last_course"])
            if abs(change) <= COURSE_CHANGE:  # turn about the vertical axis (y)
                a, (x, y, z) = math.radians(change), s["axis"]
                s["axis"] = _unit([x * math.cos(a) + z * math.sin(a), y, z * math.cos(a) - x * math.sin(a)])
        s["last_course"] = course
    change = speed - s["fix_speed"]
    if s["fix"] is None or abs(change) < AXIS_GPS or _norm(s["sum"]) < AXIS_MOTION:
        return
    seen = [x * (1 if change >= 0 else -1) for x in _unit(s["sum"])]
    if _norm(s["axis"]) ** 2 < 0.5:
        s["axis"] = seen
    elif _dot(s["axis"], seen) >= AXIS_SIMILARITY:
        s["axis"] = _slerp(s["axis"], seen, AXIS_RATE)


def on_gps(s: dict, t: float, speed: float, accuracy: float, course: float | None, c: FusionSettings) -> None:
    if s["fix"] is not None and t <= s["fix"]:
        return
    measured = min(max(speed, 0.0), c.max_speed)
    believed, first = measured, s["fix"] is None
    age = 0.0 if first else t - s["fix"]
    back = not first and age > c.stale
    departing = s["fix_speed"] <= c.standing and (not s["still"] or s["start"] >= START_TIME_GPS)
    if not first and s["still"] and age > 2 * c.stale:
        s.update(moving=0, course=None)
    if first:
        s["still"] = measured <= c.standing
        s["moving"] = 0 if s["still"] else MOVING_FIXES
    elif measured <= c.standing:
        believed = 0.0
        _stand(s, t, not s["still"] or s["speed"] > c.standing, c)
    elif s["still"]:
        believed = _depart(s, t, course, measured)
    else:
        s.update(moving=MOVING_FIXES, course=course)
    if not first and believed > 0 and not departing and not back:
        allowed = 3.0 + 3.5 * max(0.02, age) + min(max(0.1 * accuracy, 0.0), 7.5)
        if abs(believed - s["speed"]) > allowed:
            believed = s["speed"]
    _learn_axis(s, believed, accuracy, course, c)
    s.update(fix_speed=believed, fix_acc=max(0.0, accuracy), fix=t, sum=ZERO)
    if first or believed <= 0:
        s.update(speed=believed, blend=None)
        return
    q = min(max(accuracy / max(1.0, c.max_accuracy), 0.0), 1.0)
    corrected = s["speed"] + (believed - s["speed"]) * min(1.0, c.gps_weight * (1.0 - 0.92 * q * q))
    if back and c.return_blend > 0:
        s["blend"] = [t, s["speed"], corrected]
    else:
        s.update(speed=corrected, blend=None)


def _start_evidence(s: dict, a: list, dt: float, c: FusionSettings) -> None:
    limit = max(START_ACCELERATION, 2.5 * c.dead_zone)
    size = _norm(a)
    if size < limit:
        s["start"] = max(0.0, s["start"] - 2 * dt)
        if s["start"] <= 0:
            s["start_axis"] = ZERO
        return
    way = _unit(a)
    if s["still"] and _norm(s["axis"]) ** 2 >= 0.5 and s["quiet"] < QUIET_UNLOCK and _dot(way, s["axis"]) < START_SIMILARITY:
        s.update(start=0.0, start_axis=ZERO)
    elif _norm(s["start_axis"]) ** 2 < 0.5 or _dot(s["start_axis"], way) < START_SIMILARITY:
        s.update(start=dt, start_axis=way)
    else:
        s.update(start=s["start"] + dt, start_axis=_slerp(s["start_axis"], way, 0.2))


def _braking_evidence(s: dict, a: float, dt: float, t: float, c: FusionSettings) -> None:
    if s["still"]:
        _release_brake(s)
        return

    def hard_enough() -> bool:
        return s["peak"] >= -c.hard_braking and s["brake"] >= c.hard_braking_time and s["drop"] >= SHORT_DROP

    def long_enough() -> bool:
        return s["brake"] >= LONG_TIME and s["drop"] >= LONG_DROP

    if a <= min(SERVICE_BRAKING, c.hard_braking * 0.25):
        if s["brake"] <= 0:
            s["entry"] = s["speed"]
        s.update(brake=s["brake"] + dt, drop=s["drop"] - a * dt, peak=max(s["peak"], -a), brake_quiet=0.0)
        s["braking"] = s["brake"] >= c.hard_braking_time
        s["hard"] = s["braking"] and s["peak"] >= -c.hard_braking
        if s["speed"] <= c.standing and (hard_enough() or long_enough()):
            _stand(s, t, True, c)
    elif s["brake"] <= 0:
        s["braking"] = False
    elif abs(a) <= c.dead_zone:
        s["brake_quiet"] += dt
        share = 1.0 if s["entry"] <= 0.1 else s["drop"] / s["entry"]
        short = hard_enough() and (s["speed"] <= SHORT_RESIDUAL or (s["speed"] <= SHORT_RESIDUAL_SHARE and share >= SHORT_SHARE))
        long = long_enough() and s["speed"] <= LONG_RESIDUAL and share >= LONG_SHARE
        if s["brake_quiet"] >= QUIET_STOP and (short or long):
            _stand(s, t, True, c)
        elif s["brake_quiet"] >= BRAKING_RESET:
            _release_brake(s)
    elif a > 0:
        _release_brake(s)


def on_motion(s: dict, t: float, a: list, q: list, c: FusionSettings) -> None:
    if s["motion_t"] is not None and t <= s["motion_t"]:
        return
    a = _turn(q, a)
    if s["motion_t"] is None:
        s.update(motion_t=t, smooth=a)
        return
    dt = min(max(t - s["motion_t"], 1e-4), 0.1)
    s["motion_t"] = t
    size = _norm(a)
    if size > c.max_acceleration:
        a = [x * c.max_acceleration / size for x in a]
    if s["still"] and _norm(a) <= BIAS_LIMIT:
        s["bias"] = _lerp(s["bias"], a, 1 - math.exp(-dt / BIAS_TIME))
    a = [x - b for x, b in zip(a, s["bias"])]
    s["smooth"] = _lerp(s["smooth"], a, 1 - math.exp(-dt / SMOOTHING))
    s["sum"] = [x + y * dt for x, y in zip(s["sum"], s["smooth"])]
    if not s["still"]:
        s["quiet"] = 0.0
    elif _norm(a) <= max(START_ACCELERATION, 2.5 * c.dead_zone):
        s["quiet"] += dt
    if not s["still"] or t >= s["hold"]:
        _start_evidence(s, a, dt, c)
    else:
        s.update(start=0.0, start_axis=ZERO)
    if _norm(s["axis"]) ** 2 < 0.5 and s["start"] >= START_TIME / 2:
        s["axis"] = s["start_axis"]
    if s["still"] and t >= s["hold"] and s["start"] >= START_TIME:
        s.update(still=False, axis=_unit(s["start_axis"]))
        _release_brake(s)
    forward = _dot(s["smooth"], s["axis"]) if _norm(s["axis"]) ** 2 >= 0.5 else 0.0
    s["acc"] = 0.0 if abs(forward) <= c.dead_zone else min(max(forward, -c.max_acceleration), c.max_acceleration)
    if not s["still"]:
        s["speed"] = min(max(s["speed"] + s["acc"] * dt, 0.0), c.max_speed)
    _braking_evidence(s, s["acc"], dt, t, c)


def on_tick(s: dict, t: float, c: FusionSettings) -> dict:
    """The estimate at time t; ages the state."""
    dt = 0.0 if s["tick_t"] is None else max(0.0, t - s["tick_t"])
    s["tick_t"] = t
    age = math.inf if s["fix"] is None else max(0.0, t - s["fix"])
    health = "healthy" if age <= c.stale else "stale" if age <= c.missing else "missing"
    if s["fix"] is not None and s["still"]:
        s["speed"] = 0.0
    elif s["fix"] is not None:
        if s["blend"]:
            t0, start, goal = s["blend"]
            k = min(max((t - t0) / c.return_blend, 0.0), 1.0) if c.return_blend > 0 else 1.0
            s["speed"] = start + (goal - start) * k
            if k >= 1:
                s["blend"] = None
        deaf = s["motion_t"] is None or t - s["motion_t"] > MOTION_STALE
        if health == "missing" and deaf and dt > 0:
            s["speed"] *= c.retention**dt
        s["speed"] = min(max(s["speed"], 0.0), c.max_speed)
    q = min(max(s["fix_acc"] / max(1.0, c.max_accuracy), 0.0), 1.0)
    sure = 1.0 - 0.8 * q * q
    if s["fix"] is None:
        confidence = 0.0 if s["still"] else 0.15
    elif health == "healthy":
        confidence = sure
    elif health == "stale":
        k = min(max((age - c.stale) / max(1e-9, c.missing - c.stale), 0.0), 1.0)
        confidence = 0.8 * sure + (0.3 - 0.8 * sure) * k
    else:
        confidence = max(0.05, 0.3 * math.exp(-(age - c.missing) / 45.0))
    return {"t": t, "speed": s["speed"], "acceleration": s["acc"], "confidence": confidence, "health": health, "stationary": s["still"], "braking": s["braking"], "hard_braking": s["hard"], "sudden_stop": t < s["hold"], "signal_lost": age > c.loss_timeout}


def samples(gps: DataFrame, motion: DataFrame) -> DataFrame:
    """gps (session_id, t, speed, accuracy, course) and motion (session_id, t, ax..az, qx..qw) as one table of samples; kind 0 fixes, 1 readings."""
    return gps.select("session_id", "t", F.lit(0).alias("kind"), "speed", "accuracy", "course").unionByName(motion.select("session_id", "t", F.lit(1).alias("kind"), "ax", "ay", "az", "qx", "qy", "qz", "qw"), allowMissingColumns=True)


def _step(s: dict, pdf: pd.DataFrame, c: FusionSettings) -> list[dict]:
    """Feed samples in time order (a fix before a reading of the same time); an estimate after each."""
    out = []
    for r in pdf.sort_values(["t", "kind"], kind="stable").itertuples(index=False):
        if r.kind == 0:
            on_gps(s, r.t, r.speed, r.accuracy, None if pd.isna(r.course) else r.course, c)
        else:
            on_motion(s, r.t, [r.ax, r.ay, r.az], [r.qx, r.qy, r.qz, r.qw], c)
        out.append(on_tick(s, r.t, c))
    return out


_NAMES = [f.strip().split()[0] for f in OUTPUT.split(",")]


def estimate_rides(gps: DataFrame, motion: DataFrame, settings: FusionSettings = FusionSettings()) -> DataFrame:
    """Estimates after each sample. A group is one ride: what a phone records in hours fits a task."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_step(new_state(), pdf, settings)).assign(session_id=key[0])[_NAMES]

    return samples(gps, motion).groupBy("session_id").applyInPandas(run, OUTPUT)


class _Ride(StatefulProcessor):
    def __init__(self, settings: dict):
        self.settings = FusionSettings(**settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ride", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else new_state()
        out = _step(s, pd.concat(list(rows)), self.settings)
        self.state.update((json.dumps(s),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(timerValues.getCurrentWatermarkInMs() + 1000 * self.settings.loss_timeout))
        yield pd.DataFrame(out).assign(session_id=key[0])[_NAMES]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing for the loss timeout: one last row that says so, and the ride's state goes."""
        s = json.loads(self.state.get()[0]) if self.state.exists() else new_state()
        t = (s["tick_t"] or 0.0) + self.settings.loss_timeout
        self.state.clear()
        yield pd.DataFrame([on_tick(s, t, self.settings) | {"signal_lost": True}]).assign(session_id=key[0])[_NAMES]

    def close(self) -> None:
        pass


def estimate_rides_stream(stream: DataFrame, settings: FusionSettings = FusionSettings(), watermark: str = "10 seconds") -> DataFrame:
    """The same over a stream of samples (as from `samples`, with event time `event_ts`); needs the RocksDB state store.

    Samples that come late are dropped by the ride's own rule, newer than the last one; a silent ride ends at the
    loss timeout after the watermark."""
    timed = stream.withWatermark("event_ts", watermark)
    return timed.groupBy("session_id").transformWithStateInPandas(_Ride(asdict(settings)), OUTPUT, "Append", "EventTime")


def stop_events(estimates: DataFrame) -> DataFrame:
    """(session_id, t, event): where sudden_stop and signal_lost turn true."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("t")
    edges = [F.when(F.col(c) & ~F.coalesce(F.lag(c).over(w), F.lit(False)), F.lit(c)) for c in ("sudden_stop", "signal_lost")]
    return estimates.select("session_id", "t", F.array_compact(F.array(*edges)).alias("e")).select("session_id", "t", F.explode("e").alias("event"))
