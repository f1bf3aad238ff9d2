"""Recorded sessions: a folder each, with sensors.jsonl, session.json and video.mov."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline import schemas
from tramline.functions.geo import to_kmh
from tramline.operators import series

REQUIRED = ["sensors.jsonl", "session.json", "video.mov"]
GRAVITY = 9.80665


def _session(path: Column | None = None) -> Column:
    """A file's folder: the session."""
    return F.element_at(F.split(path if path is not None else F.input_file_name(), "/"), -2)


def read_sensor_log(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the logs below path; blank ones are skipped, unreadable ones kept in _corrupt_record."""
    raw = spark.read.text(path).filter(F.trim("value") != "").withColumn("session_id", _session())
    row = F.from_json("value", schemas.SENSOR_LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select("session_id", row.alias("r")).select("session_id", "r.*").withColumn("_bad", F.col("_corrupt_record").isNotNull())


def gps(log: DataFrame) -> DataFrame:
    """Fixes of a log; a negative speed, accuracy or course is unknown (null)."""
    def known(c: str) -> Column:
        return F.when(F.col(c) >= 0, F.col(c))

    return log.filter("type = 'gps' AND NOT _bad").select("session_id", "seq", "t", "unix", "lat", "lon", known("speed").alias("speed"), known("hacc").alias("accuracy"), known("course").alias("course"))


def motion(log: DataFrame) -> DataFrame:
    """Motion readings with acceleration in metres per second squared (logged in g) and the attitude as x, y, z, w."""
    return log.filter("type = 'motion' AND NOT _bad").select("session_id", "seq", "t", *[(F.col(f"ua{a}") * GRAVITY).alias(f"a{a}") for a in "xyz"], "qx", "qy", "qz", "qw")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Session documents; reason tells why one can't be used (no start clock), error what went wrong while recording."""
    m = spark.read.schema(schemas.SESSION_META).option("multiLine", True).json(path).withColumn("session_id", _session())
    start = F.col("clock.videoStartHostTime")
    return m.select("session_id", start.alias("t0"), F.col("clock.stopHostTime").alias("t_stop"), "device", "units", F.col("recordingError").alias("error"), F.when(F.coalesce(start, F.lit(0.0)) == 0, "no start clock").alias("reason"))


def missing_files(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, missing): the required files that a session's folder lacks. Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_session(F.col("path")).alias("session_id"), F.element_at(F.split("path", "/"), -1).alias("name"))
    found = files.groupBy("session_id").agg(F.collect_set("name").alias("found"))
    return found.select("session_id", F.array_except(F.array(*map(F.lit, REQUIRED)), "found").alias("missing"))


def aligned_speed(fixes: DataFrame, meta: DataFrame) -> DataFrame:
    """(session_id, t_video_s, speed_mps, hacc_m) of usable fixes after the video began; an unknown accuracy is -1."""
    j = fixes.join(meta.filter("reason is null").select("session_id", "t0"), "session_id")
    return j.filter("t >= t0 AND speed IS NOT NULL").select("session_id", (F.col("t") - F.col("t0")).alias("t_video_s"), F.col("speed").alias("speed_mps"), F.coalesce("accuracy", F.lit(-1.0)).alias("hacc_m"))


def summarize(fixes: DataFrame, readings: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a session: duration, fixes, usable rows, path, mean and top speed, motion rate, GPS gaps."""
    path = series.path_steps(fixes, ["session_id"], "t", "lat", "lon").groupBy("session_id").agg(F.count("*").alias("fixes"), F.sum("step_m").alias("metres"))
    speed = aligned_speed(fixes, meta).groupBy("session_id").agg(F.count("*").alias("usable"), to_kmh(F.avg("speed_mps")).alias("mean_kmh"), to_kmh(F.max("speed_mps")).alias("top_kmh"))
    span = F.max("t") - F.min("t")
    rate = readings.groupBy("session_id").agg(F.count("*").alias("readings"), F.when(span > 0, (F.count("*") - 1) / span).otherwise(0.0).alias("motion_hz"))
    holes = series.gaps(fixes, ["session_id"], "t", 2.0).groupBy("session_id").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest_gap"))
    out = meta.select("session_id", (F.col("t_stop") - F.col("t0")).alias("duration"), "error", "reason")
    for part in (path, speed, rate, holes):
        out = out.join(part, "session_id", "left")
    return out.fillna(0, ["fixes", "usable", "readings", "gaps"])


def speed_lines(speed: DataFrame) -> DataFrame:
    """Rows of speed.csv as text columns: three, three and one decimals."""
    return speed.select("session_id", F.format_string("%.3f", "t_video_s").alias("t_video_s"), F.format_string("%.3f", "speed_mps").alias("speed_mps"), F.format_string("%.1f", "hacc_m").alias("hacc_m"))


def write_speed(speed: DataFrame, path: str) -> None:
    speed_lines(speed).write.partitionBy("session_id").option("header", True).mode("overwrite").csv(path)


def track_lines(fixes: DataFrame, meta: DataFrame) -> DataFrame:
    """(session_id, value): a GeoJSON line of each session's fixes since the video began."""
    j = fixes.join(meta.filter("reason is null").select("session_id", "t0"), "session_id").filter("t >= t0")
    line = F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    g = j.groupBy("session_id").agg(line.alias("coordinates"))
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("session_id").alias("name")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("coordinates")).alias("geometry")))
    return g.select("session_id", doc.alias("value"))


def ingest_sessions(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Everything of the sessions below root: missing, meta, gps, motion, speed, tracks, gaps, summary, bad_lines."""
    log = read_sensor_log(spark, f"{root}/*/sensors.jsonl")
    meta = read_meta(spark, f"{root}/*/session.json")
    fixes, readings = gps(log), motion(log)
    return {
        "missing": missing_files(spark, root), "meta": meta, "gps": fixes, "motion": readings, "speed": aligned_speed(fixes, meta), "tracks": track_lines(fixes, meta),
        "gaps": series.gaps(fixes, ["session_id"], "t", 2.0), "summary": summarize(fixes, readings, meta), "bad_lines": log.filter("_bad").select("session_id", "_corrupt_record"),
    }


# ---------------------------------------------------------------- speed traces


def parse_trace(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Text lines (keys, line_no, value) of speed traces -> samples. 'g' lines hold t, speed, accuracy, course and 'm' lines t,
    acceleration, attitude; comments, blanks and lines that are short or not numbers are skipped."""
    p = F.transform(F.split(F.trim("value"), ","), lambda x: F.trim(x))
    d = lines.filter(~F.trim("value").startswith("#")).withColumn("p", p)
    n = F.transform(F.slice("p", 2, 8), lambda x: x.try_cast("double"))
    d = d.withColumns({"k": F.get("p", F.lit(0)), "n": n, "size": F.size("p")})
    def ok(count: int) -> Column:
        return F.forall(F.slice("n", 1, count), lambda x: x.isNotNull())

    fix = (F.col("k") == "g") & (F.col("size") >= 5) & ok(4)
    reading = (F.col("k") == "m") & (F.col("size") >= 9) & ok(8)
    def num(i: int, when: Column) -> Column:
        return F.when(when, F.get("n", F.lit(i)))

    course = F.when(fix & ~F.isnan(F.get("n", F.lit(3))) & (F.get("n", F.lit(3)) >= 0), F.get("n", F.lit(3)))
    cols = [F.when(fix, 0).otherwise(1).alias("kind"), F.get("n", F.lit(0)).alias("t"), num(1, fix).alias("speed"), num(2, fix).alias("accuracy"), course.alias("course")]
    cols += [num(i + 1, reading).alias(c) for i, c in enumerate(("ax", "ay", "az", "qx", "qy", "qz", "qw"))]
    return d.filter(fix | reading).select(*keys, "line_no", *cols)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the trace files below path; session_id is the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("session_id"), "value")
    lines = raw.select("session_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return parse_trace(lines, ["session_id"])


def trace_lines(samples: DataFrame) -> DataFrame:
    """(session_id, line_no, value): trace text of samples, times from the session's first."""
    w = Window.partitionBy("session_id").orderBy("t", "kind")
    t = F.format_string("%.4f", F.col("t") - F.min("t").over(Window.partitionBy("session_id")))
    def text(c: str) -> Column:
        return F.coalesce(F.format_string("%.5f", F.when(F.col(c).isNotNull(), F.col(c))), F.lit("NaN"))

    fix = F.concat_ws(",", F.lit("g"), t, text("speed"), text("accuracy"), F.when(F.col("course").isNull(), F.lit("-1")).otherwise(text("course")))
    reading = F.concat_ws(",", F.lit("m"), t, *map(text, ("ax", "ay", "az", "qx", "qy", "qz", "qw")))
    return samples.select("session_id", F.row_number().over(w).alias("line_no"), F.when(F.col("kind") == 0, fix).otherwise(reading).alias("value"))


def replay(samples: DataFrame, loops: int = 1) -> DataFrame:
    """Samples repeated `loops` times, each round later by the session's duration, so that time keeps rising."""
    length = samples.groupBy("session_id").agg((F.max("t") - F.min("t")).alias("_length"))
    rounds = samples.join(length, "session_id").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    return rounds.withColumn("t", F.col("t") + F.col("_round") * F.col("_length")).drop("_round", "_length")
