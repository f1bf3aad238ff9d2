"""Queries of whole documents, pixel coverage and confidence over the given tables: rides and customers stand for clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline import schemas
from tramline.functions import scalar
from tramline.operators import series, spans
from tramline.plans import clips, writing
from tramline.plans.driver_queries import _E, _table, r, telemetry
from tramline.plans.footage_queries import _BOXES, _FRAMES, detections_of, frames_of

QUERIES = {}
ORACLES = {}
K = ["clip_id"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("$E", _E).replace("$F", _FRAMES).replace("$B", _BOXES)
        return f

    return register


def _clips(df: DataFrame) -> DataFrame:
    c = df.select("clip_id").distinct()
    return c.select("clip_id", F.concat(F.col("clip_id").cast("string"), F.lit(".mov")).alias("file"), F.lit(29.97).alias("fps"), F.lit(960).alias("width"), F.lit(540).alias("height"), F.lit(60.0).alias("duration"))


_SPEED = "source struct<file: string>, timeToDistance array<array<double>>, stoppedSpans array<struct<start: double, `end`: double>>, speedCurve array<array<double>>"


@query("""WITH $E, s AS (SELECT user_id, floor(t) AS t, max(value) AS v FROM e GROUP BY 1, 2),
p AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv, v < 60 AS low, lag(v < 60) OVER w AS was FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
d AS (SELECT user_id, count(*) AS points, sum(coalesce((t - pt) * (greatest(v, 1e-3) + greatest(pv, 1e-3)) / 2, 0)) AS dist, sum(v) AS v FROM p GROUP BY 1),
i AS (SELECT user_id, t, low, sum(CASE WHEN was IS NULL OR low <> was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM p),
x AS (SELECT user_id, run, max(t) - min(t) AS len FROM i WHERE low GROUP BY 1, 2 HAVING max(t) - min(t) >= 3600),
n AS (SELECT user_id, count(*) AS stops, sum(len) AS stood FROM x GROUP BY 1)
SELECT user_id AS clip_id, user_id || '.mov' AS file, points, round(dist, 4) AS distance, points AS curve, round(v, 2) AS speeds, coalesce(stops, 0) AS stops, coalesce(stood, 0.0) AS stood FROM d LEFT JOIN n USING (user_id)""")
def speed_documents(spark, sf):
    e = telemetry(spark, sf).groupBy(F.col("user_id").alias("clip_id"), F.floor("t").cast("double").alias("t")).agg(F.max("value").alias("speed"))
    way = series.integrate(e, K, "t", "speed").select("clip_id", "t", "d")
    docs = writing.speed_documents(_clips(e), way, spans.spans_below(e, K, "t", "speed", 60.0, 3600.0), e)
    d = docs.select("clip_id", F.from_json("value", _SPEED).alias("j")).select("clip_id", "j.*")
    total = lambda c, of: F.aggregate(c, F.lit(0.0), lambda a, x: a + of(x))
    return d.select(
        "clip_id", "source.file", F.size("timeToDistance").cast("long").alias("points"), r(F.element_at(F.element_at("timeToDistance", -1), 2), 4).alias("distance"), F.size("speedCurve").cast("long").alias("curve"),
        r(total("speedCurve", lambda x: x[1]), 2).alias("speeds"), F.size("stoppedSpans").cast("long").alias("stops"), total("stoppedSpans", lambda x: x["end"] - x["start"]).alias("stood"),
    )


@query("""WITH $F, $B, q AS (SELECT clip_id, count(*) AS points, round(sum(frame % 100 / 100.0::DOUBLE), 2) AS heights, max(i) * 2.0::DOUBLE AS total FROM f GROUP BY 1),
o AS (SELECT clip_id, count(*) AS strips, round(sum(x1 + y1), 2) AS corners FROM b GROUP BY 1)
SELECT clip_id, clip_id || '.mov' AS playback, CAST(-1 AS INT) AS direction, points, heights, total, coalesce(strips, 0) AS strips, coalesce(corners, 0) AS corners FROM q LEFT JOIN o USING (clip_id)""")
def authored_documents(spark, sf):
    f = frames_of(spark, sf).withColumn("d", F.col("i") * 2.0)
    y = F.col("frame") % 100 / 100.0
    path = f.select("clip_id", "d", y.alias("y"), F.lit(0.35).alias("x"), y.alias("z"), F.lit("floor").alias("s"))
    foreground = detections_of(spark, sf).filter("label is not null").select("clip_id", (F.col("frame") * 1.0).alias("d"), F.col("pos").alias("id"), "x1", "y1", "x2", "y2")
    none = f.limit(0)
    hidden = none.select("clip_id", *[F.lit(0.0).alias(c) for c in ("startDistance", "endDistance", "startTime", "endTime")])
    made = _clips(f).withColumns({"playback_file": F.lit(None).cast("string"), "direction": F.lit(-1), "marker_diameter": F.lit(0.17), "mask_file": F.lit(None).cast("string")})
    docs = writing.authored_levels(made, f.select("clip_id", "t", "d"), path, path.select("clip_id", "d", F.lit(1.0).alias("v")), none.select("clip_id", F.lit(0).alias("id")), hidden, foreground, ["car"])
    d = docs.select("clip_id", F.from_json("value", schemas.LEVEL).alias("j")).select("clip_id", "j.*")
    total = lambda c, of: F.aggregate(c, F.lit(0.0), lambda a, x: a + of(x))
    return d.select(
        "clip_id", F.col("playbackFile").alias("playback"), F.col("travelDirection").cast("int").alias("direction"), F.size("path").cast("long").alias("points"), r(total("path", lambda x: x["y"]), 2).alias("heights"),
        F.element_at("timeToDistance", -1)["d"].alias("total"), F.size("foreground").cast("long").alias("strips"), r(total("foreground", lambda x: x["x1"] + x["y1"]), 2).alias("corners"),
    )


@query("""SELECT l_orderkey % 10 AS clip_id, l_orderkey AS frame, l_returnflag AS surface, round(count(DISTINCT (l_partkey % 16) * 9 + l_suppkey % 9) / 144.0::DOUBLE, 6) AS coverage FROM lineitem GROUP BY 1, 2, 3""")
def mask_coverage(spark, sf):
    pixels = _table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("clip_id"), F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("surface"), (F.col("l_partkey") % 16).alias("col"), (F.col("l_suppkey") % 9).alias("row"))
    frames = _table(spark, sf, "orders").select((F.col("o_orderkey") % 10).alias("clip_id"), F.col("o_orderkey").alias("frame"), F.lit(16).alias("width"), F.lit(9).alias("height"))
    return clips.surface_coverage(pixels, frames).withColumn("coverage", r("coverage"))


@query("""WITH v AS (SELECT event_id, event_id % 97 * 0.75::DOUBLE AS age, (event_id % 89)::DOUBLE AS acc FROM events),
s AS (SELECT *, 1 - 0.8::DOUBLE * power(least(acc / 75, 1), 2) AS sure FROM v)
SELECT event_id, round(CASE WHEN age <= 1.5 THEN sure WHEN age <= 30 THEN 0.8::DOUBLE * sure + (0.3::DOUBLE - 0.8::DOUBLE * sure) * ((age - 1.5) / 28.5) ELSE greatest(0.05::DOUBLE, 0.3::DOUBLE * exp((30 - age) / 45)) END, 6) AS confidence FROM s""")
def gps_confidence(spark, sf):
    c = F.col("event_id")
    return _table(spark, sf, "events").select("event_id", r(scalar.gps_confidence(c % 97 * 0.75, (c % 89).cast("double"))).alias("confidence"))
