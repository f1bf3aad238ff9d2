"""Jump cues fitted to what they jump over.

A box that a cue owns stands in the ball's column for a while; the arc gives height for a while. The taps that clear
every such box are found on a grid of 1/60 s; the cue moves to their middle and its window to their width. Where no tap
does, the arc gets longer. Each round depends on the last, so cues are solved in rounds; a round is array arithmetic over
all open cues of many clips, whose rows come sorted by clip.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.plans.audit import K, SKIPPED

# Reach and step of the probes around the peak, the step of taps, rounds, growth and limit of the air time.
REACH, PROBES_S, TAPS_S, ROUNDS, LONGER, LONGEST = 0.55, 30, 60, 8, 1.2, 3.4
NEAR, STANDS, SPARE, LEAST_HALF, MOVED = 0.25, 0.18, 0.03, 0.10, 0.05


#: Rows of whole clips that are solved together, at least; pairs of a tap and a probe that are compared at once, about.
TOGETHER, PAIRS = 200_000, 4_000_000


def _seek(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, past: bool = False) -> np.ndarray:
    """The first place of values[lo:hi] that is not below x (with `past`, that is above x); each such stretch is sorted."""
    lo, hi = lo.copy(), hi.copy()
    while (some := lo < hi).any():
        mid = np.where(some, (lo + hi) // 2, 0)
        on = values[mid] <= x if past else values[mid] < x
        lo, hi = np.where(some & on, mid + 1, lo), np.where(some & ~on, mid, hi)
    return lo


def _each(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, places): n[i] places from first[i] on for each i, one after the other."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Evidence:
    """Resting path, detection frames and boxes of many clips, each clip's in order of time; `*_of`: where each clip's begin, and the end."""

    t: np.ndarray
    y: np.ndarray
    x: np.ndarray
    path_of: np.ndarray
    frames: np.ndarray
    frames_of: np.ndarray
    box_t: np.ndarray
    boxes: np.ndarray
    boxes_of: np.ndarray

    def along(self, clip: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y and x of the path at each probe, between its samples; the ends hold."""
        first, last = self.path_of[clip], self.path_of[clip + 1] - 1
        at = np.clip(_seek(self.t, first, last + 1, probe, past=True) - 1, first, last)
        then = np.minimum(at + 1, last)
        inside = (probe > self.t[at]) & (then > at)
        gap = np.where(inside, self.t[then] - self.t[at], 1.0)
        value = lambda f: np.where(inside, (f[then] - f[at]) / gap * (probe - self.t[at]) + f[at], f[at])
        return value(self.y), value(self.x)

    def occupied(self, clip: np.ndarray, peak: np.ndarray, height: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cue, time, need): times at which a box stands in the column near each cue's peak, in order, and the largest lift that one needs."""
        steps = np.arange(round(2 * REACH * PROBES_S)) / PROBES_S
        cue, probe = np.repeat(np.arange(len(peak)), len(steps)), ((peak - REACH)[:, None] + steps).ravel()
        first, end = self.frames_of[clip[cue]], self.frames_of[clip[cue] + 1]
        after = np.minimum(_seek(self.frames, first, end, probe), end - 1)
        before = np.maximum(after - 1, first)
        near = np.where(np.abs(self.frames[before] - probe) <= np.abs(self.frames[after] - probe), self.frames[before], self.frames[after])
        seen = np.abs(near - probe) <= NEAR
        cue, probe, near = cue[seen], probe[seen], near[seen]
        ground, column = self.along(clip[cue], probe)
        first, end = self.boxes_of[clip[cue]], self.boxes_of[clip[cue] + 1]
        lo = _seek(self.box_t, first, end, near)
        at, box = _each(lo, _seek(self.box_t, lo, end, near, past=True) - lo)
        x1, y1, x2, y2 = self.boxes[box].T
        column, ground, wide = column[at], ground[at], radius[cue[at]]
        crosses = (x2 >= column - wide) & (x1 <= column + wide) & (np.abs(y2 - ground) <= STANDS)
        need = np.minimum(0.45 * np.maximum(ground - y1, 0), 0.85 * height[cue[at]]) * np.clip((x2 - x1) / 0.06, 0.45, 1.0)
        at, need = at[crosses], need[crosses]
        if not len(at):
            return cue[:0], probe[:0], need
        one = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        return cue[at[one]], probe[at[one]], np.maximum.reduceat(need, one)


def _clear(first: np.ndarray, taps: np.ndarray, height: np.ndarray, air: np.ndarray, time: np.ndarray, need: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(how many, mean, least, largest) of each cue's taps whose arc clears all that its probes (n from `of` on) need."""
    found = [np.zeros(len(first), np.int64), *(np.zeros(len(first)) for _ in range(3))]
    cuts = np.searchsorted(np.cumsum(taps * n), np.arange(PAIRS, int((taps * n).sum()) + PAIRS, PAIRS)) + 1
    for lo, hi in zip([0, *np.minimum(cuts, len(first))], np.minimum(cuts, len(first))):
        cue, step = _each(np.zeros(hi - lo, np.int64), taps[lo:hi])
        if not len(cue):
            continue
        cue += lo
        tap = first[cue] + step / TAPS_S
        which, at = _each(of[cue], n[cue])
        mine = cue[which]
        phase = (time[at] - tap[which]) / air[mine]
        lift = np.where((phase > 0) & (phase < 1), height[mine] * 4 * phase * (1 - phase), 0.0)
        good = np.logical_and.reduceat(lift >= need[at] + SPARE, np.cumsum(n[cue]) - n[cue])
        cue, tap = cue[good], tap[good]
        if len(cue):
            one = np.flatnonzero(np.append(True, cue[1:] != cue[:-1]))
            own, many = cue[one], np.diff(np.append(one, len(cue)))
            centre = [tap[i : i + m].mean() for i, m in zip(one, many)]  # summed as one array is, to the last bit
            for out, value in zip(found, (many, centre, tap[one], np.maximum.reduceat(tap, one))):
                out[own] = value
    return tuple(found)


def fitted(clip: np.ndarray, time: np.ndarray, height: np.ndarray, air: np.ndarray, radius: np.ndarray, seen: Evidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, window, airTime) of cues after at most ROUNDS rounds; NaN for a window or air time that the rounds did not touch."""
    time, air, window, longer = time.copy(), air.copy(), np.full(len(time), np.nan), np.full(len(time), np.nan)
    rounded = lambda x: np.array([round(v, 3) for v in x.tolist()])
    live = np.flatnonzero((np.diff(seen.path_of)[clip] > 0) & (np.diff(seen.frames_of)[clip] > 0))
    for _ in range(ROUNDS):
        if not len(live):
            break
        cue, at, need = seen.occupied(clip[live], time[live] + air[live] * 0.5, height[live], radius[live])
        if not len(cue):
            break
        of = np.flatnonzero(np.append(True, cue[1:] != cue[:-1]))
        live, n = live[cue[of]], np.diff(np.append(of, len(cue)))
        first = at[of + n - 1] - air[live] + 0.05
        taps = np.maximum(0, np.ceil((at[of] + 0.01 - first) * TAPS_S - 1e-9)).astype(np.int64)
        many, centre, least, most = _clear(first, taps, height[live], air[live], at, need, of, n)
        none, some = live[many == 0], many > 0
        air[none] = np.minimum(air[none] * LONGER, LONGEST)
        longer[none] = rounded(air[none])
        fit = live[some]
        moved = np.abs(centre[some] - time[fit])
        time[fit], window[fit] = centre[some], rounded(2 * np.maximum((most[some] - least[some]) / 2, LEAST_HALF))
        live = np.concatenate([none, fit[moved > MOVED]])  # else the boxes were measured around another peak: once more
    return time, window, longer


def _solved(rows: pa.Table) -> pa.RecordBatch:
    """The cues among the rows of whole clips, fitted."""
    ends = pc.run_end_encode(rows["_clip"].combine_chunks()).run_ends.to_numpy()
    number = lambda c: rows[c].cast(pa.float64()).to_numpy()
    clip, kind, t = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), rows["kind"].to_numpy(), number("t")
    a, b, c, d = (number(x) for x in "abcd")
    starts = lambda of: np.searchsorted(of, np.arange(len(ends) + 1))
    path, frames, boxes = (np.flatnonzero(kind == k) for k in range(3))
    seen = Evidence(t[path], a[path], b[path], starts(clip[path]), t[frames], starts(clip[frames]), t[boxes], np.stack([a, b, c, d], 1)[boxes], starts(clip[boxes]))
    cues = np.flatnonzero(kind == 3)
    given = rows["_cue"].combine_chunks().take(pa.array(cues))
    columns = dict(zip([f.name for f in given.type], given.flatten()))
    value = lambda name: columns[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
    time, radius = value("time"), a[cues]
    jump = pc.fill_null(pc.equal(columns["type"], "jump"), False).to_numpy(zero_copy_only=False)
    todo = np.flatnonzero(jump & ~np.isnan(radius) & ~np.isnan(time))
    # Nothing and zero both stand for the default, for the fit only.
    usual = lambda name, x: np.where(np.isnan(v := value(name)[todo]) | (v == 0), x, v)
    # The whole diameter, not its half: nearer balls are drawn larger, and the window must hold for the largest.
    new = fitted(clip[cues][todo], time[todo], np.clip(usual("height", 0.22), 0.12, 0.50), usual("airTime", 1.0), radius[todo], seen)
    for name, found in zip(("time", "window", "airTime"), new):
        put = np.zeros(len(cues), bool)
        put[todo] = ~np.isnan(found)
        full = np.zeros(len(cues))
        full[todo] = found
        columns[name] = pc.if_else(pa.array(put), pa.array(full).cast(columns[name].type, safe=False), columns[name])
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by clip, solved as soon as there are enough rows of whole clips."""
    held, n, enough = [], 0, TOGETHER
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= enough:
            rows = pa.Table.from_batches(held)
            ends = pc.run_end_encode(rows["_clip"].combine_chunks()).run_ends
            whole = ends[-2].as_py() if len(ends) > 1 else 0
            if whole:
                yield _solved(rows.slice(0, whole))
            held, n = rows.slice(whole).to_batches(), len(rows) - whole
            enough = max(TOGETHER, 2 * n)
    if n:
        yield _solved(pa.Table.from_batches(held))


def fit_jump_windows(events: DataFrame, path: DataFrame, detections: DataFrame, clips: DataFrame) -> DataFrame:
    """events with time, window and airTime of each jump fitted; other cues, and jumps that nothing crosses, as they were.

    events: (clip_id, time, type, height, airTime, window, ...); path: resting samples (clip_id, t, y, x); detections:
    (clip_id, t, label, x1, y1, x2, y2, width, height), a null label for a frame without boxes; clips: marker_diameter.
    Heights are held to 0.12 .. 0.50 (none: 0.22) and a missing air time is a second, for the fit only. A clip (minutes
    of video) is solved in one task, together with others. A clip without path, frames or diameter keeps its cues."""
    share = lambda c, side: (F.col(c) / F.col(side)).alias({"x1": "a", "y1": "b", "x2": "c", "y2": "d"}[c])
    none = [F.lit(None).cast("double").alias(c) for c in "cd"]
    frames = detections.select(*K, "t").distinct().select(*K, F.lit(1).alias("kind"), F.col("t").cast("double").alias("t"), *[F.lit(None).cast("double").alias(c) for c in "abcd"])
    boxes = detections.filter(F.col("label").isNotNull() & ~F.col("label").isin(SKIPPED)).select(*K, F.lit(2).alias("kind"), F.col("t").cast("double").alias("t"), share("x1", "width"), share("y1", "height"), share("x2", "width"), share("y2", "height"))
    evidence = path.select(*K, F.lit(0).alias("kind"), F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("a"), F.col("x").cast("double").alias("b"), *none).unionByName(frames).unionByName(boxes)
    (key,) = K
    evidence = evidence.filter("t IS NOT NULL").select(F.col(key).alias("_clip"), "kind", "t", *"abcd")
    given = events.join(clips.select(*K, F.col("marker_diameter").cast("double").alias("_radius")), K, "left")
    cues = given.select(F.col(key).alias("_clip"), F.lit(3).alias("kind"), F.lit(None).cast("double").alias("t"), F.col("_radius").alias("a"), F.struct(*events.columns).alias("_cue"))
    rows = evidence.unionByName(cues, allowMissingColumns=True).repartition("_clip").sortWithinPartitions("_clip", "kind", "t", "a", "b")
    return rows.mapInArrow(_solve, events.schema)
