"""From evidence and a timeline to a route: the path a ball rolls on, its cues and what surrounds them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.arrays import array_median, plausible_ground
from tramline.functions.scalar import clip, smoothstep
from tramline.operators import series, spans
from tramline.operators.asof import asof_backward, asof_nearest, interp_join, range_rows
from tramline.operators.lineage import cut

K = ["clip_id"]
# Surfaces that are ground; reach in time and columns of ledges and of the ground's edge; how far a ledge may lie from the
# path around it; least number, spread, lowest place and rim of edges; smoothing after a clamp.
GROUND = ["floor", "sidewalk", "grass"]
LEDGE_NEAR, LEDGE_COLUMNS, LEDGE_REACH, LEDGE_OFF = 0.5, 20, 0.5, 0.35
EDGE_NEAR, EDGE_COLUMNS, EDGES, EDGE_SPREAD, EDGE_LOW, EDGE_RIM, SETTLE = 0.25, 25, 2, 0.15, 0.88, 0.02, 0.15


def _line_at(line: str, columns: int) -> Column:
    """Height of a line near column x: the median of what is seen within `columns` of it, as a share; null where nothing is."""
    px = F.greatest(F.lit(0), F.least(F.col("width") - 1, (F.col("x") * F.col("width")).cast("int")))
    low = F.greatest(F.lit(0), px - columns)
    return array_median(F.filter(F.slice(line, low + 1, px + columns + 1 - low), lambda v: v != -1)) / F.col("height")


def snap_to_ledges(p: DataFrame, ledges: DataFrame, until: DataFrame) -> DataFrame:
    """Samples (clip_id, i, t, y, x, s, ...) with y on the ledge of the surface they name.

    ledges: (clip_id, t, surface, line, width, height); until: (clip_id, animated_until), the end of the marker's lead. Up to then a
    sample is measured in the nearest frame of ledges (LEDGE_NEAR at most), and counts if it lies near the path's median around it. In
    each run of one surface with two measured samples or more the ledge is drawn through all of the run, held at its ends."""
    led = p.join(until.select(*K, F.col("animated_until").alias("_end")), K).filter(F.col("t") <= F.col("_end")).select(*K, "i", "t", "x", "s")
    times = ledges.select(*K, "t").distinct().withColumn("ledge_t", F.col("t"))
    at = asof_nearest(led, times, K, "t", LEDGE_NEAR).filter("ledge_t IS NOT NULL").drop("t_found")
    lines = ledges.select(*K, F.col("t").alias("ledge_t"), F.col("surface").alias("s"), "line", "width", "height")
    seen = at.join(lines, [*K, "ledge_t", "s"]).withColumn("value", _line_at("line", LEDGE_COLUMNS)).filter("value IS NOT NULL").select(*K, "i", "t", "value")
    around = range_rows(seen, p.select(*K, "t", "y"), K, "t", LEDGE_REACH).filter(F.col("t_fact") < F.col("t") + LEDGE_REACH)
    known = around.groupBy(*K, "i", "value").agg(F.expr("percentile(y, 0.5)").alias("_local")).filter(F.abs(F.col("value") - F.col("_local")) < LEDGE_OFF).select(*K, "i", F.col("value").cast("double").alias("_ledge"))
    w = Window.partitionBy(*K).orderBy("i")
    runs = p.withColumn("_run", F.sum(F.coalesce((~F.lag("s").over(w).eqNullSafe(F.col("s"))).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = runs.select(*K, "i", "_run").join(known, [*K, "i"])
    enough = own.groupBy(*K, "_run").agg(F.count("*").alias("_n")).filter("_n >= 2").select(*K, "_run")
    out = interp_join(runs, own.join(enough, [*K, "_run"]), [*K, "_run"], "i", ["_ledge"])
    return out.withColumn("y", F.coalesce("_ledge", "y")).drop("_run", "_ledge").select(*p.columns)


def ground_edges(p: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(clip_id, i, edge): the far edge of the visible ground at the samples that name ground, where the frames within EDGE_NEAR agree."""
    good = surfaces.filter(plausible_ground(F.col("coverage"))).select(*K, "t", "run_line", "width", "height")
    near = range_rows(p.filter(F.col("s").isin(GROUND)).select(*K, "i", "t", "x"), good, K, "t", EDGE_NEAR).withColumn("edge", _line_at("run_line", EDGE_COLUMNS)).filter("edge IS NOT NULL")
    agreed = near.groupBy(*K, "i").agg(F.count("*").alias("n"), (F.max("edge") - F.min("edge")).alias("spread"), F.expr("percentile(edge, 0.5)").alias("edge"))
    return agreed.filter((F.col("n") >= EDGES) & (F.col("spread") <= EDGE_SPREAD) & (F.col("edge") <= EDGE_LOW)).select(*K, "i", "edge")


def clamp_to_ground(p: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Samples with y no higher than just inside the visible ground, clamped, settled, clamped again and settled. Where samples stand
    does not change in between, so the edges are found once."""
    d = p.join(cut(ground_edges(p, surfaces)), [*K, "i"], "left")
    for _ in range(2):
        d = d.withColumn("y", F.greatest("y", F.col("edge") - EDGE_RIM))
        d = series.gaussian_smooth(d, K, "t", "y", SETTLE)
    return d.select(*p.columns)


@dataclass(frozen=True)
class PathConfig:
    samples: int = 1400
    step_ramp: float = 0.45
    smoothing: float = 0.35
    marker_smoothing: float = 0.25
    seam: float = 1.2
    min_column: float = 0.10
    max_column: float = 0.90
    column: float = 0.35
    adjust_ramp: float = 0.4
    depth_ramp: float = 0.3


def authored_path(level_map: DataFrame, ground: DataFrame, timeline: dict[str, DataFrame], marker: dict[str, DataFrame] | None = None, config: PathConfig = PathConfig(), ledges: DataFrame | None = None, surfaces: DataFrame | None = None) -> DataFrame:
    """(clip_id, i, t, d, y, x, z, s): evenly timed samples of the path.

    With ledges and a marker the path runs on the ledges of the surfaces it names; with surfaces (clip_id, t, run_line, coverage, width,
    height) it stays inside the ground that is seen.

    ground: (clip_id, d, y) of the runnable segments. timeline: surfaces (t, surface), settings (surfaceOffsets,
    post_marker_column), pathAdjust (start, end, dy) and sizeDepth (start, end, y). marker: samples (t, x, y) and clips
    (animated_until), which lead where the marker was animated. z is the line that size is read from: the path, but for
    spans that name a depth, whose edges ramp to the path's value there."""
    c = config
    p = series.resample_even(level_map, K, "t", ["d"], c.samples)
    p = interp_join(p, ground, K, "d", ["y"])
    p = asof_backward(p, timeline["surfaces"].select(*K, "t", F.col("surface").alias("s")), K, "t", default={"s": "floor"}).drop("t_found")
    p = p.join(timeline["settings"].select(*K, "surfaceOffsets", "post_marker_column"), K, "left")
    p = p.withColumn("_o", F.coalesce(F.try_element_at("surfaceOffsets", F.col("s")), F.lit(0.0)))
    p = series.smooth_step(p, K, "t", "_o", c.step_ramp)
    p = p.withColumns({"y": F.col("y") + F.col("_o"), "x": F.lit(c.column)}).drop("_o", "surfaceOffsets")
    if marker is not None:
        m = series.ground_baseline(marker["samples"], K, "t", "y", 3.0)
        m = series.gaussian_smooth(series.gaussian_smooth(m, K, "t", "baseline", c.marker_smoothing), K, "t", "x", c.marker_smoothing)
        p = interp_join(p, m.select(*K, "t", F.col("baseline").alias("_my"), F.col("x").alias("_mx")), K, "t", ["_my", "_mx"])
        p = p.join(marker["clips"].select(*K, F.col("animated_until").alias("_end")), K, "left")
        w = smoothstep(clip((F.col("_end") - F.col("t")) / c.seam, 0.0, 1.0))
        ease = smoothstep(clip((F.col("t") - F.col("_end") + 2.3) / 2.0, 0.0, 1.0))
        home = clip(F.coalesce("post_marker_column", F.lit(c.column)), c.min_column, c.max_column)
        p = p.withColumns({
            "y": F.when(F.col("_my").isNull() | F.col("_end").isNull(), F.col("y")).otherwise(F.col("y") * (1 - w) + F.col("_my") * w),
            "x": F.when(F.col("_mx").isNull() | F.col("_end").isNull(), F.col("x")).otherwise(clip(F.col("_mx"), c.min_column, c.max_column) * (1 - ease) + home * ease),
        }).drop("_my", "_mx", "_end")
    p = p.drop("post_marker_column")
    if ledges is not None and marker is not None:
        p = snap_to_ledges(cut(p), ledges, marker["clips"])
    p = series.gaussian_smooth(series.gaussian_smooth(p, K, "t", "y", c.smoothing), K, "t", "x", c.smoothing)
    p = p.withColumn("x", clip(F.col("x"), c.min_column, c.max_column))
    if surfaces is not None:
        p = clamp_to_ground(cut(p), surfaces)
    p = spans.span_adjust(p, timeline["pathAdjust"], K, "t", "y", c.adjust_ramp)
    edges = timeline["sizeDepth"].select(*K, "start", "end", F.col("y").alias("depth"))
    edges = interp_join(edges.withColumn("t", F.col("start")), p.select(*K, "t", "y"), K, "t", ["y"]).withColumnRenamed("y", "y0").drop("t")
    edges = interp_join(edges.withColumn("t", F.col("end")), p.select(*K, "t", "y"), K, "t", ["y"]).withColumnRenamed("y", "y1").drop("t")
    e = edges.select(F.col("clip_id").alias("_k"), "start", "end", "depth", "y0", "y1")
    j = p.select(*K, "i", "t").join(e, (F.col("clip_id") == F.col("_k")) & F.col("t").between(F.col("start"), F.col("end")))
    out = lambda a: 1 - clip(a / c.depth_ramp, 0.0, 1.0)
    z = F.col("depth") + (F.col("y0") - F.col("depth")) * out(F.col("t") - F.col("start")) + (F.col("y1") - F.col("depth")) * out(F.col("end") - F.col("t"))
    last = j.groupBy(*K, "i").agg(F.max_by(z, "start").alias("z"))
    return p.join(last, [*K, "i"], "left").select(*K, "i", "t", "d", "y", "x", F.coalesce("z", "y").alias("z"), "s")


def cues(timeline: dict[str, DataFrame], marker: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cues in order (clip_id, time, type, label, height, airTime, duration, window, lead, source).

    Where the timeline is binding its events stand, and windows and leads come from the gaps between those that are
    played. Elsewhere the marker's arcs come first, and the timeline's events after the marker's end."""
    binding = timeline["settings"].select(*K, "authoritative_events")
    e = timeline["events"].withColumnRenamed("t", "time").join(binding, K, "left").withColumn("authoritative_events", F.coalesce("authoritative_events", F.lit(False)))
    own = e.filter("authoritative_events").withColumn("_hop", F.col("type") == "hop")
    own = series.scoring_windows(own, K, "time", "_hop").withColumn("window", F.col("window_s"))
    columns = [*K, "time", "type", "label", "height", "airTime", "duration", "window", "lead", "source"]
    out = own.withColumn("source", F.lit("timeline")).select(columns)
    free = e.filter("NOT authoritative_events").withColumns({"lead": F.lit(None).cast("double"), "source": F.lit("timeline")})
    if marker is not None:
        free = free.join(marker["clips"].select(*K, "animated_until"), K, "left").filter("animated_until IS NULL OR time > animated_until")
        none = F.lit(None).cast("double")
        arcs = marker["arcs"].join(binding.filter("authoritative_events"), K, "left_anti")
        arcs = arcs.select(*K, F.col("start").alias("time"), F.lit("jump").alias("type"), F.lit("marker").alias("label"), "height", clip(F.col("end") - F.col("start"), 0.8, 3.4).alias("airTime"), none.alias("duration"), none.alias("window"), none.alias("lead"), F.lit("marker").alias("source"))
        out = out.unionByName(arcs)
    return out.unionByName(free.select(columns))


def level_events(cues_: DataFrame, level_map: DataFrame, settings: DataFrame) -> DataFrame:
    """Event rows of a level: numbered by time, with distance and the half-window in distance.

    A cue without a window takes its type's from settings (eventWindows), else 0.55 seconds."""
    d = cues_.join(settings.select(*K, "eventWindows"), K, "left").withColumn("type", F.coalesce("type", F.lit("jump")))
    d = d.withColumn("window", F.coalesce("window", F.try_element_at("eventWindows", F.col("type")), F.lit(0.55)))
    d = interp_join(d.withColumn("t", F.col("time")), level_map, K, "t", ["d"]).withColumnRenamed("d", "distance").drop("t")
    d = d.join(level_map.groupBy(*K).agg(F.max("t").alias("_end")), K)
    d = interp_join(d.withColumn("t", F.least(F.col("time") + F.col("window") / 2, F.col("_end"))), level_map, K, "t", ["d"])
    n = F.row_number().over(Window.partitionBy(*K).orderBy("time", "type", "label")) - 1
    def rounded(c: str, places: int, default: float = 0.0):
        return F.bround(F.coalesce(c, F.lit(default)), places)

    return d.select(*K, n.alias("id"), "type", F.coalesce("label", "type").alias("label"), rounded("time", 3).alias("time"), rounded("distance", 3).alias("distance"), rounded("window", 3).alias("window"), F.bround(F.col("d") - F.col("distance"), 3).alias("windowDistance"), rounded("height", 4).alias("height"), rounded("window", 3).alias("windowSeconds"), rounded("lead", 3, 0.55).alias("lead"), rounded("airTime", 3).alias("airTime"), rounded("duration", 3).alias("duration"), "source")


def hidden_spans(timeline: dict[str, DataFrame], level_map: DataFrame) -> DataFrame:
    """Hidden spans by time and distance."""
    h = timeline["hidden"].select(*K, "start", "end")
    a = interp_join(h.withColumn("t", F.col("start")), level_map, K, "t", ["d"]).withColumnRenamed("d", "startDistance").drop("t")
    b = interp_join(a.withColumn("t", F.col("end")), level_map, K, "t", ["d"])
    return b.select(*K, F.bround("startDistance", 3).alias("startDistance"), F.bround("d", 3).alias("endDistance"), F.bround("start", 3).alias("startTime"), F.bround("end", 3).alias("endTime"))
