"""Evidence documents of clips: detections, marker tracks, timelines, levels, cached lines and raw detector rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline import schemas


def _clip() -> Column:
    """A document's clip: that of its folder clip_id=..., as write_documents makes them, else its file name without the ending."""
    path = F.input_file_name()  # a URI, in which the escapes of the folder's name are escaped once more
    own = F.regexp_extract(path, r"/clip_id=([^/]+)/[^/]*$", 1)

    def decoded(c: Column) -> Column:
        return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    return F.when(own != "", decoded(decoded(own))).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.[^/]*)?$", 1))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("clip_id", _clip())


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, detections): frames (clip_id, frame, t, width, height), also those without a detection; detections
    (…, pos, label, score, x1, y1, x2, y2) in pixels."""
    d = _read(spark, path, schemas.DETECTIONS).select("clip_id", "width", "height", F.explode("frames").alias("f"))
    frames = d.select("clip_id", F.col("f.index").alias("frame"), F.col("f.time").alias("t"), "width", "height")
    each = d.select("clip_id", F.col("f.index").alias("frame"), F.col("f.time").alias("t"), "width", "height", F.posexplode("f.detections").alias("pos", "x"))
    return frames, each.select("clip_id", "frame", "t", "width", "height", "pos", "x.label", "x.score", *[F.get("x.box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def detection_documents(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """(clip_id, value): the JSON that read_detections reads; time, score and box rounded to 5, 4 and 2 places."""
    box = F.array(*[F.bround(c, 2) for c in ("x1", "y1", "x2", "y2")])
    one = F.struct("pos", F.struct("label", F.bround("score", 4).alias("score"), box.alias("box")).alias("v"))
    per = detections.groupBy("clip_id", "frame").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]).alias("detections"))
    f = frames.join(per, ["clip_id", "frame"], "left")
    row = F.struct(F.col("frame").alias("index"), F.bround("t", 5).alias("time"), F.coalesce("detections", F.from_json(F.lit("[]"), "array<struct<label: string, score: double, box: array<double>>>")).alias("detections"))
    g = f.groupBy("clip_id", "width", "height").agg(F.array_sort(F.collect_list(row)).alias("frames"))
    return g.select("clip_id", F.to_json(F.struct("width", "height", "frames")).alias("value"))


def read_marker(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """samples (clip_id, t, x, y, radius), arcs (clip_id, start, peak, end, height), clips (clip_id, animated_until, median_radius)."""
    d = _read(spark, path, schemas.MARKER)
    return {
        "samples": d.select("clip_id", F.inline("samples")),
        "arcs": d.select("clip_id", F.inline("arcs")),
        "clips": d.select("clip_id", F.col("animatedUntil").alias("animated_until"), F.col("medianRadius").alias("median_radius")),
    }


def read_timeline(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table for each section of the timelines, in order, with defaults for what is absent."""
    d = _read(spark, path, schemas.TIMELINE)
    def section(name: str) -> DataFrame:
        return d.select("clip_id", F.inline(F.array_sort(name)))

    spans = {n: section(n).withColumnsRenamed({"from": "start", "to": "end"}) for n in ("hidden", "behindSpans", "frontSpans", "pathAdjust", "sizeDepth")}
    settings = d.select(
        "clip_id", F.coalesce("authoritativeEvents", F.lit(False)).alias("authoritative_events"), F.coalesce("ballScale", F.lit(1.0)).alias("ball_scale"), F.coalesce("postMarkerColumn", F.lit(0.35)).alias("post_marker_column"),
        F.coalesce("occluderLabels", F.array().cast("array<string>")).alias("occluder_labels"), "surfaceOffsets", "eventWindows",
    )
    return {"surfaces": section("surfaces").withColumnRenamed("from", "t"), "events": section("events").withColumnRenamed("time", "t"), "settings": settings, **spans}


def read_level(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Child tables of the levels (map, path, speed, ambient, events, hidden, foreground, clips); rejected: clips with a
    path of fewer than two points. A z of 0 is the ride line, an x of 0 the character's column, no surface is floor."""
    d = _read(spark, path, schemas.LEVEL)
    good = d.filter("size(path) >= 2")
    path_ = good.select("clip_id", F.coalesce("characterColumn", F.lit(0.35)).alias("_c"), F.inline("path"))
    events = good.select("clip_id", F.inline("events")).withColumn("type", F.when(F.col("type").isin("jump", "platform", "hop", "dodge"), F.col("type")).otherwise("jump"))
    return {
        "clips": good.select("clip_id", "version", F.coalesce(F.nullif("playbackFile", F.lit("")), "source.file").alias("playback"), F.when(F.coalesce("travelDirection", F.lit(-1.0)) >= 0, 1).otherwise(-1).alias("direction"), F.coalesce(F.nullif("markerDiameter", F.lit(0.0)), F.lit(0.173)).alias("marker_diameter")),
        "map": good.select("clip_id", F.inline("timeToDistance")),
        "path": path_.select("clip_id", "d", "y", F.when(F.col("x") > 0, F.col("x")).otherwise(F.col("_c")).alias("x"), F.when(F.col("z") > 0, F.col("z")).otherwise(F.col("y")).alias("z"), F.coalesce(F.nullif("s", F.lit("")), F.lit("floor")).alias("s")),
        "speed": good.select("clip_id", F.inline("screenSpeed")), "ambient": good.select("clip_id", F.inline("ambient")), "events": events,
        "hidden": good.select("clip_id", F.inline("hidden")), "foreground": good.select("clip_id", F.inline("foreground")),
        "rejected": d.filter("coalesce(size(path), 0) < 2").select("clip_id", F.lit("path of fewer than two points").alias("reason")),
    }


def level_documents(clips: DataFrame, children: dict[str, tuple[DataFrame, str]], version: int) -> DataFrame:
    """(clip_id, value): level JSON of clips (clip_id and scalars). children: field -> (table, order column). One sorted
    array for each child, joined on the clip."""
    out = clips
    for name, (table, order) in children.items():
        rest = [c for c in table.columns if c != "clip_id"]
        rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("v")))), lambda x: x["v"])
        out = out.join(table.groupBy("clip_id").agg(rows.alias(name)), "clip_id", "left")
    fields = [c for c in out.columns if c != "clip_id"]
    return out.select("clip_id", F.to_json(F.struct(F.lit(version).alias("version"), *fields)).alias("value"))


def assemble(clips: DataFrame, children: dict[str, tuple[DataFrame, list[str], Column]]) -> DataFrame:
    """(clip_id, value): the JSON of clips (clip_id and any fields, nested ones too) with an array for each child.

    children: field -> (table with clip_id, columns that order it, value of an element). A clip without rows of a child
    gets an empty array. A clip's document is one value, so its children meet in one task."""
    out = clips
    for name, (table, order, value) in children.items():
        rows = table.select("clip_id", F.struct(F.struct(*order).alias("o"), value.alias("v")).alias("_e"))
        rows = rows.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["v"]).alias(name))
        out = out.join(rows, "clip_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out.select("clip_id", F.to_json(F.struct(*[c for c in out.columns if c != "clip_id"])).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents (clip_id, value) as text, a folder clip_id=... for each clip, which the readers tell the clip from."""
    docs.select("clip_id", "value").write.partitionBy("clip_id").text(path)


def quantized_path(path: DataFrame) -> DataFrame:
    """Path samples rounded as they are stored: 3 places of d, 5 of y, x and z, half to even."""
    return path.withColumns({"d": F.bround("d", 3), **{c: F.bround(c, 5) for c in ("y", "x", "z") if c in path.columns}})


# ---------------------------------------------------------------- binary caches


def read_surface_cache(spark: SparkSession, path: str) -> DataFrame:
    """NumPy archives (indices, times, run_lines, coverage, size) -> surfaces; the table itself is kept as Parquet from then on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["clip_id"], pdf["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                w, h = (int(v) for v in z["size"])
                for lo in range(0, len(z["times"]), 256):
                    s = slice(lo, lo + 256)
                    yield pd.DataFrame({"clip_id": name, "frame": z["indices"][s].astype("int32"), "t": z["times"][s].astype(float), "run_line": list(z["run_lines"][s].astype("int32")), "coverage": z["coverage"][s].astype(float), "width": w, "height": h})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1).alias("clip_id"), "content")
    return files.mapInPandas(run, schemas.SURFACES)


def read_ledge_cache(spark: SparkSession, path: str) -> DataFrame:
    """NumPy archives (times, size, line_<surface> stacks) -> one row for each frame and surface; no stack, no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["clip_id"], pdf["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                w, h = (int(v) for v in z["size"])
                for key in (k for k in z.files if k.startswith("line_")):
                    for lo in range(0, len(z["times"]), 256):
                        s = slice(lo, lo + 256)
                        yield pd.DataFrame({"clip_id": name, "t": z["times"][s].astype(float), "surface": key[5:], "line": list(z[key][s].astype("int32")), "width": w, "height": h})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1).alias("clip_id"), "content")
    return files.mapInPandas(run, schemas.LEDGES)


def read_raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """Detector dumps: two little-endian ints (rows, values a row), then for each row its index and its floats."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["image_id"], pdf["content"]):
                rows, width = np.frombuffer(content, "<i4", 2)
                kind = np.dtype([("row_idx", "<i4"), ("values", "<f4", (int(width),))])
                data = np.frombuffer(content, kind, int(rows), 8)
                yield pd.DataFrame({"image_id": name, "row_idx": data["row_idx"].astype("int32"), "values": list(data["values"].astype("float32"))})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1).alias("image_id"), "content")
    return files.mapInPandas(run, schemas.RAW_ROWS)
