"""Clip evidence to events: obstacles, surface segments, marker, ledges, occluders, ambient light."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import arrays
from tramline.functions.scalar import clip, luma
from tramline.operators import series, spans, tracks
from tramline.operators.asof import asof_nearest, interp_join

K = ["clip_id"]
# What may be run on; labels that name the ground itself, and runnable classes of detections.
SURFACE_LABELS = ["sidewalk", "railing", "fence"]
RUNNABLE = {"railing": "rail", "fence": "rail", "bush": "hedge"}


@dataclass(frozen=True)
class ObstacleConfig:
    column: float = 0.35
    half: float = 0.03
    blocked_share: float = 0.5
    notch: float = 0.035
    baseline_window: int = 61
    column_smoothing: int = 9
    max_rise: float = 0.15
    min_valid: float = 0.6
    merge_gap: int = 3
    min_frames: int = 1
    height_divisor: str = "width"


def column_profile(surfaces: DataFrame, config: ObstacleConfig = ObstacleConfig()) -> DataFrame:
    """Each surface frame with baseline, height, fraction, depth, trustworthy, blocked and free_ground of the character's column.

    The baseline is the frame's median ground, filled over frames without ground by rank and smoothed by a running
    median that shrinks on short clips. Columns without ground count as the bottom of the frame."""
    c = config
    w = Window.partitionBy(*K).orderBy("t", "frame")
    d = surfaces.withColumns({"_i": F.row_number().over(w).cast("double"), "_m": arrays.line_median(F.col("run_line"), F.col("height")), "_frames": F.count("*").over(Window.partitionBy(*K)), "frame_height": F.col("height")})
    d = series.fill_linear(d, K, "_i", "_m").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    smooth = series.median_filter(d, K, "_i", "_m", c.baseline_window, out="baseline")
    # A clip shorter than the window takes the largest odd window that fits; padding makes both the same there.
    smooth = smooth.withColumn("baseline", F.when(F.col("_frames") >= c.baseline_window, F.col("baseline")))
    short = smooth.filter(F.col("_frames") < c.baseline_window)
    odd = F.when(F.col("_frames") % 2 == 1, F.col("_frames")).otherwise(F.col("_frames") - 1)
    near = Window.partitionBy(*K).orderBy("_i").rowsBetween(-(c.baseline_window // 2), c.baseline_window // 2)
    short = short.withColumn("_all", F.collect_list("_m").over(near)).withColumn("_half", (odd / 2).cast("int"))
    first = F.greatest(F.lit(1), F.col("_i").cast("int") - c.baseline_window // 2)
    at = F.transform(F.sequence(-F.col("_half"), F.col("_half")), lambda k: F.get("_all", F.greatest(F.lit(1), F.least(F.col("_frames").cast("int"), F.col("_i").cast("int") + k)) - first))
    short = short.withColumn("baseline", F.when(odd > 1, arrays.array_median(at)).otherwise(F.col("_m"))).drop("_all", "_half")
    d = smooth.filter(F.col("_frames") >= c.baseline_window).unionByName(short)
    profile = arrays.column_median(F.transform("run_line", lambda v: F.when(v == -1, F.lit(1.0)).otherwise(v / F.col("frame_height"))), c.column_smoothing)
    middle = F.floor(F.col("width") * c.column).cast("int")
    half = F.greatest(F.lit(1), F.floor(F.col("width") * c.half).cast("int"))
    start = F.greatest(F.lit(0), middle - half)
    foot = F.slice(profile, start + 1, F.greatest(F.lit(0), F.least(F.col("width"), middle + half + 1) - start))
    d = d.withColumn("_foot", foot)
    share, depth = arrays.displaced(F.col("_foot"), F.col("baseline"), c.notch)
    d = d.withColumns({"fraction": share, "depth": depth, "profile_height": arrays.array_median(F.col("_foot"))})
    sure = arrays.plausible_ground(F.col("coverage")) & (F.coalesce(arrays.valid_fraction(F.col("run_line")), F.lit(0.0)) >= c.min_valid) & (F.col("profile_height") > F.col("baseline") - c.max_rise)
    d = d.withColumn("trustworthy", F.coalesce(sure, F.lit(False)))
    d = d.withColumn("blocked", F.col("trustworthy") & (F.col("fraction") >= c.blocked_share))
    return d.withColumn("free_ground", F.col("trustworthy") & ~F.col("blocked")).drop("_i", "_m", "_frames", "_foot", "frame_height")


def obstacle_events(surfaces: DataFrame, distance_map: DataFrame, detections: DataFrame, config: ObstacleConfig = ObstacleConfig()) -> DataFrame:
    """(clip_id, id, distance, start_distance, end_distance, label, confidence, blockage, height) of blocked runs.

    A run is named by the best detection over the column while it lasts, or in the single frame nearest its middle;
    surfaces and trees name nothing. The height is a share of the frame's width unless height_divisor says height."""
    c = config
    p = column_profile(surfaces, c).select(*K, "t", "frame", "width", "blocked", "fraction")
    p = interp_join(p, distance_map, K, "t", ["d"])
    runs = spans.merge_runs(p, K, "t", "blocked", c.merge_gap, c.min_frames).select(*K, "run", "start", "end")
    inside = p.join(runs, K).filter(F.col("t").between(F.col("start"), F.col("end")))
    events = inside.groupBy(*K, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("d", "t").alias("start_distance"), F.max_by("d", "t").alias("end_distance"),
        F.max_by("d", F.struct(F.col("fraction"), -F.col("t"))).alias("distance"), F.max("fraction").alias("blockage"), F.min("width").alias("_w"),
    )
    frames = detections.select(*K, "t", "frame").distinct()
    during = events.join(frames, K).filter(F.col("t").between(F.col("start"), F.col("end"))).select(*K, "run", "frame")
    empty = events.join(during, [*K, "run"], "left_anti").withColumn("t", (F.col("start") + F.col("end")) / 2)
    near = asof_nearest(empty.select(*K, "run", "t"), frames, K, "t", tie=["frame"]).filter("frame is not null").select(*K, "run", "frame")
    at = F.col("_w") * c.column
    hits = events.join(during.unionByName(near), [*K, "run"]).join(detections, [*K, "frame"])
    hits = hits.filter(~F.col("label").isin(*SURFACE_LABELS, "tree") & at.between(F.col("x1"), F.col("x2")) & (F.col("score") > 0))
    best = hits.groupBy(*K, "run").agg(F.max_by(F.struct("label", "score", F.abs(F.col("y2") - F.col("y1")).alias("h"), F.col("_w").alias("w"), F.col("height").alias("f")), F.struct(F.col("score"), -F.col("frame"), -F.col("pos"))).alias("b"))
    out = events.join(best, [*K, "run"], "left")
    divisor = F.col("b.w") if c.height_divisor == "width" else F.col("b.f")
    number = F.row_number().over(Window.partitionBy(*K).orderBy("start")) - 1
    return out.select(*K, number.alias("id"), "distance", "start_distance", "end_distance", F.coalesce("b.label", F.lit("unknown")).alias("label"), F.coalesce("b.score", F.lit(0.0)).alias("confidence"), "blockage", F.coalesce(F.col("b.h") / divisor, F.lit(0.0)).alias("height"))


def surface_segments(surfaces: DataFrame, distance_map: DataFrame, config: ObstacleConfig = ObstacleConfig(), min_gap_frames: int = 3, points: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, gaps, path): runnable stretches in distance with short gaps bridged, what lies between, and the ground
    along each segment, filled over blocked frames and thinned to an equal share of the points."""
    p = column_profile(surfaces, config).select(*K, "t", "free_ground", "profile_height")
    p = interp_join(p, distance_map, K, "t", ["d"])
    runs, holes = spans.segments(p, K, "d", "free_ground", min_gap_frames)
    runs = runs.withColumn("segment", F.row_number().over(Window.partitionBy(*K).orderBy("start")) - 1)
    inside = p.join(runs.select(*K, "segment", "start", "end"), K).filter(F.col("d").between(F.col("start"), F.col("end")))
    filled = series.fill_linear(inside.withColumn("y", F.when(F.col("free_ground"), F.col("profile_height"))), [*K, "segment"], "d", "y")
    n = F.max("segment").over(Window.partitionBy(*K)) + 1
    share = F.greatest(F.lit(16), F.floor(F.lit(points) / n))
    rank = Window.partitionBy(*K, "segment")
    d = filled.withColumns({"_k": share, "_i": F.row_number().over(rank.orderBy("d")) - 1, "_n": F.count("*").over(rank)})
    step = F.greatest(F.lit(1.0), (F.col("_n") - 1) / (F.col("_k") - 1))
    j = F.floor(F.col("_i") / step)
    keep = (F.col("_i") == F.col("_n") - 1) | (F.floor(j * step) == F.col("_i")) | (F.floor((j + 1) * step) == F.col("_i"))
    return runs, holes, d.filter((F.col("_n") <= F.col("_k")) | keep).select(*K, "segment", "d", "y")


def level_quality(segments: DataFrame, gaps: DataFrame, path: DataFrame, obstacles: DataFrame) -> DataFrame:
    """One row a clip: share of the way that can be run, share of gaps, obstacles inside a segment, steps of the path."""
    s = segments.groupBy(*K).agg(F.sum(F.col("end") - F.col("start")).alias("_run"))
    g = gaps.groupBy(*K).agg(F.sum(F.col("end") - F.col("start")).alias("_gap"), F.count("*").alias("gaps"))
    every = segments.select(*K, "start", "end").unionByName(gaps.select(*K, "start", "end")).groupBy(*K).agg((F.max("end") - F.min("start")).alias("_all"))
    steps = path.withColumn("_dy", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy(*K, "segment").orderBy("d")))).groupBy(*K).agg(F.expr("percentile(_dy, array(0.5, 0.99))").alias("_q"), F.max("_dy").alias("max_step"))
    on = spans.in_spans(obstacles, segments, K, "distance").groupBy(*K).agg(F.count("*").alias("obstacles_inside"))
    out = every
    for part in (s, g, steps, on, obstacles.groupBy(*K).agg(F.count("*").alias("obstacles"))):
        out = out.join(part, K, "left")
    return out.select(*K, (F.coalesce("_run", F.lit(0.0)) / F.col("_all")).alias("runnable"), (F.coalesce("_gap", F.lit(0.0)) / F.col("_all")).alias("gap_share"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("obstacles_inside", F.lit(0)).alias("obstacles_inside"), F.coalesce("obstacles", F.lit(0)).alias("obstacles"), F.get("_q", F.lit(0)).alias("median_step"), F.get("_q", F.lit(1)).alias("p99_step"), "max_step")


def marker_track(candidates: DataFrame) -> dict[str, DataFrame]:
    """candidates (clip_id, frame, t, pos, cx, cy, area, perimeter, frame_w, frame_h) -> samples with baseline, arcs, clips.

    A candidate is small and round enough; of a frame's the best goes, near the last one."""
    share = F.col("area") / (F.col("frame_w") * F.col("frame_h"))
    roundness = F.when(F.col("perimeter") > 0, 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    good = candidates.withColumns({"score": roundness, "radius": F.sqrt(F.col("area") / F.pi()) / F.col("frame_w"), "x": F.col("cx"), "y": F.col("cy")})
    good = good.filter(share.between(0.0006, 0.06) & (F.col("score") >= 0.62)).select(*K, "t", "x", "y", "radius", "score")
    samples = series.ground_baseline(tracks.follow_marker(good, K), K, "t", "y", 3.0)
    arcs = series.find_arcs(samples, K, "t", "y", "baseline")
    parked = series.parked_after(samples, K, "t", "x", "y").withColumnRenamed("parked", "animated_until")
    clips = samples.groupBy(*K).agg(F.expr("percentile(radius, 0.5)").alias("median_radius"), F.count("*").alias("samples")).join(parked, K)
    frames = candidates.groupBy(*K).agg(F.count_distinct("frame").alias("_f"))
    counted = arcs.join(parked, K).groupBy(*K).agg(F.count("*").alias("arcs"), F.count_if(F.col("peak") <= F.col("animated_until")).alias("arcs_animated"))
    clips = clips.join(frames, K).join(counted, K, "left").withColumn("sample_share", F.col("samples") / F.col("_f")).drop("_f").fillna(0, ["arcs", "arcs_animated"])
    return {"samples": samples, "arcs": arcs, "clips": clips}


def ledge_boxes(detections: DataFrame, most: int = 6, min_score: float = 0.28) -> DataFrame:
    """The widest boxes of each runnable surface in a frame."""
    surface = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in RUNNABLE.items()])
    d = detections.withColumn("surface", surface).filter(F.col("surface").isNotNull() & (F.col("score") >= min_score))
    return tracks.top_k(d, [*K, "frame", "surface"], [F.desc(F.col("x2") - F.col("x1")), F.col("pos")], most)


def top_edges(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """pixels (clip_id, frame, surface, col, row) of masks, of which several may cover a surface -> the top line of each
    surface in a frame, -1 where it has no pixel. frames: (clip_id, frame, t, width, height)."""
    top = pixels.groupBy(*K, "frame", "surface", "col").agg(F.min("row").alias("row"))
    held = top.groupBy(*K, "frame", "surface").agg(F.map_from_entries(F.collect_list(F.struct("col", "row"))).alias("_top"))
    line = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("_top", c), F.lit(-1)))
    return held.join(frames, [*K, "frame"]).select(*K, "t", "surface", line.alias("line"), "width", "height")


def surface_coverage(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(clip_id, frame, surface, coverage): the share of a frame's pixels that the surface's masks cover; a pixel in several
    masks counts once. frames: (clip_id, frame, width, height)."""
    once = pixels.select(*K, "frame", "surface", "col", "row").distinct().groupBy(*K, "frame", "surface").count()
    return once.join(frames.select(*K, "frame", "width", "height"), [*K, "frame"]).select(*K, "frame", "surface", (F.col("count") / (F.col("width").cast("long") * F.col("height"))).alias("coverage"))


def ledge_lines(edges: DataFrame, max_step_share: float = 0.06) -> DataFrame:
    """Ledge lines without jumps and gaps."""
    return edges.withColumn("line", arrays.clean_line(F.col("line"), F.col("height") * max_step_share))


@dataclass(frozen=True)
class OcclusionConfig:
    labels: tuple[str, ...] = ("pole", "traffic sign", "tree", "car", "truck", "bus")
    thin: tuple[str, ...] = ("pole", "traffic sign")
    min_score: float = 0.30
    margin: float = 0.03
    reach: float = 0.25
    pad: float = 0.01
    dodge_before: float = 0.25
    dodge_after: float = 1.0


def suppress_spans(front: DataFrame, dodges: DataFrame, hidden: DataFrame, config: OcclusionConfig = OcclusionConfig()) -> DataFrame:
    """(clip_id, start, end) in which nothing occludes: spans in front, windows around dodges, hidden spans."""
    around = dodges.select(*K, (F.col("t") - config.dodge_before).alias("start"), (F.col("t") + config.dodge_after).alias("end"))
    return front.select(*K, "start", "end").unionByName(around).unionByName(hidden.select(*K, "start", "end"))


def occluder_tracks(detections: DataFrame, line: DataFrame, suppressed: DataFrame, forced: DataFrame, config: OcclusionConfig = OcclusionConfig(), chain: tracks.ChainConfig = tracks.ChainConfig()) -> DataFrame:
    """Chained sightings of what stands before the ball: one a frame, in shares of the frame. line: (clip_id, t, y, x), the
    ball's ground and column. A base below the line (by the margin) stands in front, or any base in a forced span; thin
    things go before others, then the nearest centre, which is that of the padded box."""
    c = config
    d = detections.filter(F.col("label").isin(*c.labels) & (F.col("score") >= c.min_score))
    d = d.select(*K, "frame", "t", "pos", "label", "score", (F.col("x1") / F.col("width")).alias("rx1"), (F.col("y1") / F.col("height")).alias("y1"), (F.col("x2") / F.col("width")).alias("rx2"), (F.col("y2") / F.col("height")).alias("y2"))
    d = spans.not_in_spans(d, suppressed, K, "t")
    d = interp_join(d, line.withColumnsRenamed({"y": "line_y", "x": "column"}), K, "t", ["line_y", "column"])
    free = d.filter(F.col("y2") >= F.col("line_y") + c.margin).unionByName(spans.in_spans(d.filter(F.col("y2") < F.col("line_y") + c.margin), forced, K, "t"))
    near = free.filter(F.abs((F.col("rx1") + F.col("rx2")) / 2 - F.col("column")) <= c.reach)
    near = near.withColumns({"x1": clip(F.col("rx1") - c.pad, 0.0, 1.0), "x2": clip(F.col("rx2") + c.pad, 0.0, 1.0)})
    best = tracks.first_by(near, [*K, "frame"], ~F.col("label").isin(*c.thin), F.abs((F.col("x1") + F.col("x2")) / 2 - F.col("column")), F.col("pos"))
    return tracks.chain_tracks(best.select(*K, "frame", "t", "label", "score", "x1", "y1", "x2", "y2"), K, chain)


def foreground(tracks_: DataFrame, distance_map: DataFrame) -> DataFrame:
    """Occluder sightings by distance, ordered."""
    return interp_join(tracks_, distance_map, K, "t", ["d"]).select(*K, "d", F.col("track_id").alias("id"), "x1", "y1", "x2", "y2")


def patch_colours(pixels: DataFrame) -> DataFrame:
    """Mean colour (0 to 1) of the pixels (clip_id, frame, t, r, g, b) of each frame's patch."""
    return pixels.groupBy(*K, "frame", "t").agg(*[(F.avg(c) / 255).alias(c) for c in "rgb"])


def ambient_light(samples: DataFrame, patches: DataFrame, stride: int, fps: float) -> DataFrame:
    """Light along a path: samples (clip_id, t, ...) take the last patch within three quarters of a stride, missing ones
    are filled along t, and all are scaled so that the clip's median luma is 1; a clip without light is 1 throughout."""
    reach = 0.75 * stride / fps
    from tramline.operators.asof import range_rows

    near = range_rows(samples.select(*K, "t").distinct(), patches.select(*K, F.col("t"), F.struct("r", "g", "b").alias("rgb")), K, "t", reach)
    last = near.groupBy(*K, "t").agg(F.max_by("rgb", "t_fact").alias("rgb"))
    d = samples.join(last, [*K, "t"], "left")
    for c in "rgb":
        d = series.fill_linear(d.withColumn(c, F.col(f"rgb.{c}")), K, "t", c)
    d = d.drop("rgb").withColumn("_l", luma(F.col("r"), F.col("g"), F.col("b")))
    m = d.groupBy(*K).agg(F.expr("percentile(_l, 0.5) FILTER (WHERE _l > 0)").alias("_m"))
    d = d.join(m, K)
    scaled = [F.when(F.col("_m").isNull(), F.lit(1.0)).otherwise(clip(F.col(c) / F.col("_m"), 0.35, 1.8)).alias(c) for c in "rgb"]
    return d.select(*[c for c in d.columns if c not in ("r", "g", "b", "_l", "_m")], *scaled)


def counts(detections: DataFrame) -> DataFrame:
    """Detections by clip and label, most first."""
    return detections.groupBy(*K, "label").agg(F.count("*").alias("n")).orderBy(*K, F.desc("n"), "label")


def event_counts(events: DataFrame) -> DataFrame:
    """Events of each clip by type and source, and the mean distance from one event to the next of that kind."""
    w = Window.partitionBy(*K, "type", "source").orderBy("time")
    d = events.withColumn("_step", F.col("time") - F.lag("time").over(w))
    return d.groupBy(*K, "type", "source").agg(F.count("*").alias("n"), F.avg("_step").alias("spacing"))


def surface_summary(surfaces: DataFrame) -> DataFrame:
    """Median coverage and valid share of each clip, and frames with less than a fifth valid."""
    d = surfaces.withColumn("_v", F.coalesce(arrays.valid_fraction(F.col("run_line")), F.lit(0.0)))
    return d.groupBy(*K).agg(F.expr("percentile(coverage, 0.5)").alias("median_coverage"), F.expr("percentile(_v, 0.5)").alias("median_valid"), F.count_if(F.col("_v") < 0.2).alias("poor_frames"), F.count("*").alias("frames"))


def ledge_presence(ledges: DataFrame, frames: DataFrame) -> DataFrame:
    """Share of a clip's frames in which each surface shows."""
    seen = ledges.filter(F.exists("line", lambda v: v != -1)).groupBy(*K, "surface").agg(F.count_distinct("t").alias("_n"))
    return seen.join(frames.groupBy(*K).agg(F.count_distinct("t").alias("_all")), K).select(*K, "surface", (F.col("_n") / F.col("_all")).alias("presence"))
