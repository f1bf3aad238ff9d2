"""Whole documents of clips: speed, surface level, authored level and marker, each one JSON value a clip.

clips: (clip_id, file, fps, width, height, duration) everywhere. A document's arrays are one sorted aggregate for each
child table, joined on the clip; a child without rows is an empty array. Numbers are rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.sources.documents import assemble

K = ["clip_id"]


def _r(column: str, places: int) -> Column:
    return F.bround(F.col(column), places)


def _pair(a: str, b: str, places: tuple[int, int]) -> Column:
    return F.array(_r(a, places[0]), _r(b, places[1]))


def _fields(**parts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _source(fps: int, duration: int) -> Column:
    return _fields(file=F.col("file"), fps=_r("fps", fps), width=F.col("width"), height=F.col("height"), duration=_r("duration", duration))


def _analysis(clips: DataFrame, diagnostics: DataFrame | None) -> DataFrame:
    """clips with analysis: what diagnostics (one row a clip) says of them; empty without."""
    if diagnostics is None:
        return clips.withColumn("analysis", F.create_map().cast("map<string,string>"))
    rest = [c for c in diagnostics.columns if c not in K]
    return clips.join(diagnostics.select(*K, F.struct(*rest).alias("analysis")), K, "left")


def _stops(stops: DataFrame) -> tuple[DataFrame, list[str], Column]:
    return stops, ["start"], _fields(start=_r("start", 3), end=_r("end", 3))


def speed_documents(clips: DataFrame, distance_map: DataFrame, stops: DataFrame, samples: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """(clip_id, value) of the map (t, d) as it is to be stored, stops (start, end), samples (t, speed), diagnostics."""
    d = _analysis(clips, diagnostics).select(*K, _source(6, 6).alias("source"), F.lit("relative").alias("distanceUnits"), "analysis")
    return assemble(d, {
        "timeToDistance": (distance_map, ["t"], _pair("t", "d", (5, 5))),
        "stoppedSpans": _stops(stops),
        "speedCurve": (samples, ["t"], _pair("t", "speed", (5, 3))),
    })


def surface_levels(clips: DataFrame, distance_map: DataFrame, segments: DataFrame, gaps: DataFrame, path: DataFrame, obstacles: DataFrame, stops: DataFrame, diagnostics: DataFrame | None = None, column: float = 0.35) -> DataFrame:
    """(clip_id, value), levels of version 1: segments (segment, start, end) with their path (segment, d, y), gaps (start,
    end), obstacles as `clips.obstacle_events` gives them, stops (start, end). The total is the map's last distance."""
    total = distance_map.groupBy(*K).agg(F.max("d").alias("_total"))
    d = _analysis(clips, diagnostics).join(total, K, "left").select(
        *K, F.lit(1).alias("version"), _source(6, 4).alias("source"), F.lit("relative").alias("distanceUnits"), F.lit(column).alias("characterColumn"), F.bround(F.coalesce("_total", F.lit(0.0)), 4).alias("totalDistance"), "analysis",
    )
    points = F.transform(F.array_sort(F.collect_list(F.struct("d", "y"))), lambda p: F.array(F.bround(p["d"], 4), F.bround(p["y"], 5)))
    whole = segments.join(path.groupBy(*K, "segment").agg(points.alias("_path")), [*K, "segment"], "left")
    stretch = {"startDistance": _r("start", 4), "endDistance": _r("end", 4)}
    rounded = {"distance": ("distance", 4), "startDistance": ("start_distance", 4), "endDistance": ("end_distance", 4), "blockage": ("blockage", 3), "height": ("height", 4), "confidence": ("confidence", 3)}
    return assemble(d, {
        "timeToDistance": (distance_map, ["t"], _pair("t", "d", (5, 4))),
        "surfaceSegments": (whole, ["segment"], _fields(**stretch, path=F.col("_path"))),
        "surfaceGaps": (gaps, ["start"], _fields(**stretch)),
        "obstacles": (obstacles, ["id"], _fields(id=F.col("id"), **{"class": F.col("label")}, **{k: _r(*v) for k, v in rounded.items()})),
        "stoppedSpans": _stops(stops),
    })


def authored_levels(clips: DataFrame, distance_map: DataFrame, path: DataFrame, speeds: DataFrame, events: DataFrame, hidden: DataFrame, foreground: DataFrame, labels: list[str], column: float = 0.35) -> DataFrame:
    """(clip_id, value), levels of version 3.

    clips also has playback_file (null: the file), direction and marker_diameter (null: 0), mask_file (null: none). path:
    (d, y, x, z, s); speeds: (d, v); events and hidden as `authoring` gives them, foreground: (d, id, x1 .. y2) and any
    of mask, u1 .. v2. labels: the classes that the foreground was made of."""
    total = distance_map.groupBy(*K).agg(F.max("d").alias("_total"))
    d = clips.join(total, K, "left").select(
        *K, F.lit(3).alias("version"), _source(6, 4).alias("source"), F.coalesce("playback_file", "file").alias("playbackFile"), F.lit("relative").alias("distanceUnits"), F.lit(column).alias("characterColumn"),
        F.col("direction").cast("int").alias("travelDirection"), F.bround(F.coalesce("marker_diameter", F.lit(0.0)), 5).alias("markerDiameter"), F.bround(F.coalesce("_total", F.lit(0.0)), 3).alias("totalDistance"),
        F.coalesce("mask_file", F.lit("")).alias("foregroundMaskFile"), F.array(*map(F.lit, labels)).cast("array<string>").alias("occluderLabels"),
    )
    own = lambda t: [c for c in t.columns if c not in K]
    return assemble(d, {
        "timeToDistance": (distance_map, ["t"], _fields(t=_r("t", 5), d=_r("d", 3))),
        "path": (path, ["d"], _fields(d=_r("d", 3), **{c: _r(c, 5) for c in ("y", "x", "z")}, s=F.col("s"))),
        "screenSpeed": (speeds, ["d"], _fields(d=_r("d", 3), v=_r("v", 5))),
        "foreground": (foreground, ["d", "id"], F.struct(*own(foreground))),
        "events": (events, ["id"], F.struct(*own(events))),
        "hidden": (hidden, ["startTime"], F.struct(*own(hidden))),
    })


def marker_documents(clips: DataFrame, marker: dict[str, DataFrame]) -> DataFrame:
    """(clip_id, value) of marker tables: samples (t, x, y), arcs (start, peak, end, height), clips (animated_until, median_radius)."""
    d = clips.join(marker["clips"], K).select(
        *K, _fields(file=F.col("file"), fps=F.col("fps"), duration=F.col("duration")).alias("source"), F.bround("animated_until", 3).alias("animatedUntil"), F.bround("median_radius", 5).alias("medianRadius"),
    )
    return assemble(d, {
        "samples": (marker["samples"], ["t"], _fields(t=_r("t", 4), x=_r("x", 5), y=_r("y", 5))),
        "arcs": (marker["arcs"], ["start"], _fields(**{c: _r(c, 3) for c in ("start", "peak", "end")}, height=_r("height", 4))),
    })
