"""Fair admission of detected obstacles as alerts: order-dependent rules over one ride, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

# Kinds that can be jumped.
JUMPABLE = ["hydrant", "bench", "bush", "sign"]


@dataclass(frozen=True)
class AdmissionSettings:
    lanes: int = 3
    min_speed: float = 1.5
    min_score: float = 0.45
    reaction: float = 1.1
    lead_factor: float = 1.6
    min_distance: float = 8.0
    max_distance: float = 32.0
    same_lane_gap: float = 1.0
    cooldown: float = 1.25
    per_lane: int = 2
    dodge: float = 0.45
    per_second: float = 1.5
    jump_speed: float = 6.0


OUTPUT = "session_id string, t double, seq long, lane int, kind string, distance double, jumpable boolean, arrival double"
_NAMES = [f.strip().split()[0] for f in OUTPUT.split(",")]


def new_state(c: AdmissionSettings) -> dict:
    return {"cooldown": {}, "lanes": [[] for _ in range(c.lanes)], "recent": []}


def _admit(s: dict, r, c: AdmissionSettings) -> dict | None:
    surfaces = list(r.surfaces) if r.surfaces is not None else []
    runnable = [lane for lane in range(c.lanes) if lane < len(surfaces) and surfaces[lane] not in (None, "none")]
    if not runnable or pd.isna(r.speed) or r.speed < c.min_speed or r.score < c.min_score or r.lane not in runnable:
        return None
    if r.kind == "vehicle" and surfaces[r.lane] == "sidewalk":
        return None
    key = f"{r.lane}/{r.kind}"
    if r.t - s["cooldown"].get(key, -1e18) < c.cooldown or len([x for x in s["recent"] if x >= r.t - 1]) >= c.per_second:
        return None
    distance = min(max(r.speed * c.reaction * c.lead_factor, c.min_distance), c.max_distance)
    wait = distance / r.speed
    arrival = r.t + wait
    mine = s["lanes"][r.lane]
    if wait < c.reaction or len(mine) >= c.per_lane or any(abs(x - arrival) < c.same_lane_gap for x in mine):
        return None
    jumpable = r.kind in JUMPABLE
    if not (jumpable and r.speed >= c.jump_speed):
        near = 2 * c.dodge + 4.4 / max(1.0, r.speed)
        if all(lane == r.lane or any(abs(x - arrival) < near for x in s["lanes"][lane]) for lane in runnable):
            return None
    mine.append(arrival)
    s["cooldown"][key] = r.t
    s["recent"].append(r.t)
    return {"t": r.t, "seq": r.seq, "lane": r.lane, "kind": r.kind, "distance": distance, "jumpable": jumpable, "arrival": arrival}


def _step(s: dict, pdf: pd.DataFrame, c: AdmissionSettings) -> list[dict]:
    out = []
    for r in pdf.sort_values(["t", "seq"], kind="stable").itertuples(index=False):
        s["lanes"] = [[x for x in lane if x >= r.t - 2] for lane in s["lanes"]]
        s["recent"] = [x for x in s["recent"] if x >= r.t - 1]
        if (a := _admit(s, r, c)) is not None:
            out.append(a)
    return out


def admit_alerts(events: DataFrame, settings: AdmissionSettings = AdmissionSettings()) -> DataFrame:
    """events (session_id, t, seq, lane, kind, score, speed, surfaces array<string> by lane) -> admitted alerts.

    Speed and surfaces are those in force at the event (an as-of lookup). Every alert counts as a blocker for
    later ones, whether it can be jumped or not, and one runnable lane always stays open."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_step(new_state(settings), pdf, settings), columns=_NAMES[1:]).assign(session_id=key[0])[_NAMES]

    return events.groupBy("session_id").applyInPandas(run, OUTPUT)


class _Gate(StatefulProcessor):
    def __init__(self, settings: dict):
        self.settings = AdmissionSettings(**settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else new_state(self.settings)
        out = _step(s, pd.concat(list(rows)), self.settings)
        self.state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=_NAMES[1:]).assign(session_id=key[0])[_NAMES]

    def close(self) -> None:
        pass


def admit_alerts_stream(stream: DataFrame, settings: AdmissionSettings = AdmissionSettings()) -> DataFrame:
    """The same over a stream of events; a batch's events are taken in order of (t, seq)."""
    return stream.groupBy("session_id").transformWithStateInPandas(_Gate(asdict(settings)), OUTPUT, "Append", "None")
