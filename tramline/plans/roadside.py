"""Detector output to lane events, class maps to lane surfaces, and alerts of a ride."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.geometry import grid_cell, letterbox_scale
from tramline.operators import tracks
from tramline.operators.asof import asof_backward
from tramline.streaming.admission import AdmissionSettings, admit_alerts

# Detector class ids and the kind of obstacle each stands for; class ids of a segmented street.
KINDS = {0: "person", 1: "vehicle", 2: "vehicle", 3: "vehicle", 5: "vehicle", 6: "vehicle", 7: "vehicle", 9: "traffic_light", 10: "hydrant", 11: "sign", 13: "bench", 58: "bush"}
ROAD, SIDEWALK, VEGETATION, TERRAIN, TRAIN = 0, 1, 8, 9, 16


def kind_of(class_id: Column) -> Column:
    """Obstacle kind of a class id; null for what is no obstacle."""
    return F.coalesce(*[F.when(class_id == k, v) for k, v in KINDS.items()])


def decode_rows(raw: DataFrame, size: int = 416, min_score: float = 0.35, iou: float = 0.45) -> DataFrame:
    """Raw rows (image_id, row_idx, values: x, y, w, h, objectness, class scores) -> suppressed boxes in detector pixels."""
    v = F.transform("values", lambda x: x.cast("double"))
    d = raw.withColumn("v", v)
    scores = F.transform(F.slice("v", 6, 80), lambda c: F.get("v", F.lit(4)) * c)
    d = d.withColumn("s", scores).withColumn("score", F.array_max("s")).filter(F.col("score") >= min_score)
    gx, gy, stride = grid_cell(F.col("row_idx"), size)
    d = d.withColumns({"class_id": (F.array_position("s", F.col("score")) - 1).cast("int"), "_s": stride, "_x": gx, "_y": gy}).filter("_s is not null")
    def value(i: int) -> Column:
        return F.get("v", F.lit(i))

    cx, cy, w, h = (value(0) + F.col("_x")) * F.col("_s"), (value(1) + F.col("_y")) * F.col("_s"), F.exp(value(2)) * F.col("_s"), F.exp(value(3)) * F.col("_s")
    boxes = d.select("image_id", "class_id", "row_idx", "score", (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))
    return tracks.nms(boxes, ["image_id", "class_id"], iou, tie=["row_idx"])


def to_source(boxes: DataFrame, images: DataFrame, size: int = 416) -> DataFrame:
    """Boxes in source pixels; images: (image_id, src_w, src_h). The detector saw the image scaled to fit its square."""
    scale = letterbox_scale(F.col("src_w"), F.col("src_h"), size, size)
    return boxes.join(images, "image_id").withColumns({c: F.col(c) / scale for c in ("x1", "y1", "x2", "y2")})


def lane_events(boxes: DataFrame, lanes: int = 3, min_bottom: float = 0.45, min_height: float = 0.04) -> DataFrame:
    """Boxes (class_id, score, x1.., src_w, src_h) that are obstacles and low and tall enough, with kind and lane."""
    d = boxes.withColumn("kind", kind_of(F.col("class_id"))).filter("kind is not null AND src_w > 0 AND src_h > 0")
    d = d.filter((F.col("y2") >= min_bottom * F.col("src_h")) & (F.col("y2") - F.col("y1") >= min_height * F.col("src_h")))
    lane = F.greatest(F.lit(0), F.least(F.lit(lanes - 1), F.floor((F.col("x1") + F.col("x2")) / 2 / F.col("src_w") * lanes))).cast("int")
    return d.withColumn("lane", lane)


def lane_surfaces(runs: DataFrame, lanes: int = 3, band: float = 0.6, least: float = 0.3) -> dict[str, DataFrame]:
    """Class-map runs (image_id, width, height, run, class_id, length) -> lanes (image_id, lane, surface, fraction), images
    (image_id, dominant, vegetation_left, vegetation_right).

    Runs are cut at row ends and lane borders, never spread to pixels. Of equal votes road goes before sidewalk, rail
    and path; a lane without enough votes has no surface; the dominant surface is that of the most voted lane."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    d = runs.withColumn("a", F.coalesce(F.sum("length").over(w), F.lit(0))).withColumn("b", F.col("a") + F.col("length")).filter("length > 0")
    d = d.withColumns({"top": F.floor(F.col("height") * band).cast("long"), "lw": F.floor(F.col("width") / lanes).cast("long"), "side": F.greatest(F.lit(1), F.floor(F.col("width") / 6)).cast("long")})
    d = d.filter((F.col("b") > F.col("top") * F.col("width")) & (F.col("width") >= lanes))
    row = F.explode(F.sequence(F.greatest("top", F.floor(F.col("a") / F.col("width"))), F.floor((F.col("b") - 1) / F.col("width"))))
    d = d.withColumn("y", row)
    d = d.withColumns({"x0": F.greatest(F.lit(0), F.col("a") - F.col("y") * F.col("width")), "x1": F.least(F.col("width").cast("long"), F.col("b") - F.col("y") * F.col("width"))})
    def inside(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least("x1", hi) - F.greatest("x0", lo))

    lane = d.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    hi = F.when(F.col("lane") == lanes - 1, F.col("width").cast("long")).otherwise((F.col("lane") + 1) * F.col("lw"))
    lane = lane.withColumn("n", inside(F.col("lane") * F.col("lw"), hi))
    votes = lane.groupBy("image_id", "lane").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("class_id") == c, F.col("n")).otherwise(0)).alias(s) for s, c in (("road", ROAD), ("sidewalk", SIDEWALK), ("rail", TRAIN), ("path", TERRAIN))])
    best = F.greatest("road", "sidewalk", "rail", "path")
    kind = F.coalesce(*[F.when(F.col(s) == best, s) for s in ("road", "sidewalk", "rail", "path")])
    out = votes.filter("total > 0").withColumns({"fraction": best / F.col("total"), "_best": best})
    out = out.withColumn("surface", F.when(F.col("fraction") >= least, kind).otherwise("none"))
    dominant = out.groupBy("image_id").agg(F.max_by("surface", F.struct(F.col("surface") != "none", F.col("_best"), -F.col("lane"))).alias("dominant"))
    green = d.filter(F.col("class_id") == VEGETATION).groupBy("image_id").agg(F.sum(inside(F.lit(0), F.col("side"))).alias("_l"), F.sum(inside(F.col("width") - F.col("side"), F.col("width"))).alias("_r"))
    area = d.groupBy("image_id").agg(F.first((F.col("height") - F.col("top")) * F.col("side")).alias("_a"))
    images = area.join(dominant, "image_id", "left").join(green, "image_id", "left")
    return {
        "lanes": out.select("image_id", "lane", "surface", "fraction"),
        "images": images.select("image_id", F.coalesce("dominant", F.lit("none")).alias("dominant"), *[F.coalesce(F.col(c) / F.col("_a"), F.lit(0.0)).alias(n) for c, n in (("_l", "vegetation_left"), ("_r", "vegetation_right"))]),
    }


def alerts(events: DataFrame, reports: DataFrame, speed: DataFrame, settings: AdmissionSettings = AdmissionSettings()) -> DataFrame:
    """Admitted alerts of lane events (session_id, t, seq, lane, kind, score), with the surfaces (session_id, t, surfaces)
    and the speed (session_id, t, speed) last known at each."""
    d = asof_backward(events, reports.select("session_id", "t", "surfaces"), ["session_id"], "t").drop("t_found")
    d = asof_backward(d, speed.select("session_id", "t", "speed"), ["session_id"], "t").drop("t_found")
    return admit_alerts(d, settings)


def ride_score(speed: DataFrame, dodges: DataFrame) -> DataFrame:
    """(session_id, metres, score): way travelled, and the way plus ten for each dodge, rounded half to even."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("t")
    way = speed.withColumn("_m", F.coalesce(F.col("speed") * (F.col("t") - F.lag("t").over(w)), F.lit(0.0))).groupBy("session_id").agg(F.sum("_m").alias("metres"))
    n = dodges.groupBy("session_id").agg(F.count("*").alias("_n"))
    return way.join(n, "session_id", "left").select("session_id", "metres", F.bround(F.col("metres") + 10 * F.coalesce("_n", F.lit(0))).cast("long").alias("score"))
