"""Speed of a clip from feature flow, its distance map, and checks of estimates against truth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators import series, spans
from tramline.operators.asof import interp_join


@dataclass(frozen=True)
class SpeedConfig:
    min_features: int = 12
    min_motion: float = 0.35
    max_error: float = 20.0
    median_window: int = 9
    rise_per_median: float = 0.5
    stop_share: float = 0.06
    min_stop: float = 0.5
    min_speed: float = 1e-3


def frame_flow(features: DataFrame, keys: Sequence[str], moving: Column, usable: Column, least: int = 12) -> DataFrame:
    """(keys, dx, confidence): signed median of dx of the usable moving features and the share that agrees in sign.

    Too few usable or moving features give (0, 0). Two aggregates and one join on the keys; a group is one frame."""
    d = features.withColumns({"_u": usable, "_m": usable & moving})
    m = d.groupBy(*keys).agg(F.count_if("_u").alias("_used"), F.count_if("_m").alias("_moved"), F.expr("percentile(dx, 0.5) FILTER (WHERE _m)").alias("_dx"))
    agree = d.join(m, list(keys)).groupBy(*keys, "_used", "_moved", "_dx").agg(F.count_if(F.col("_m") & (F.signum("dx") == F.signum("_dx"))).alias("_a"))
    ok = (F.col("_used") >= least) & (F.col("_moved") >= least)
    return agree.select(*keys, F.when(ok, F.col("_dx")).otherwise(0.0).alias("dx"), F.when(ok, F.col("_a") / F.col("_moved")).otherwise(0.0).alias("confidence"))


def speed_curve(features: DataFrame, config: SpeedConfig = SpeedConfig()) -> tuple[DataFrame, DataFrame]:
    """(samples, diagnostics) of feature_flow rows (clip_id, frame, t, prev_t, feature, dx, status, error, masked).

    A frame whose mask is missing (masked null in all its rows) can't be measured; it is filled from its
    neighbours. Clips with fewer than two samples, or none measurable, have no samples and say so in error."""
    c = config
    keys = ["clip_id", "frame", "t", "prev_t"]
    usable = (F.col("status") == 1) & (F.col("error") < c.max_error) & F.coalesce(F.col("masked"), F.lit(False))
    flow = frame_flow(features, keys, F.abs("dx") > c.min_motion, usable, c.min_features)
    known = features.groupBy(*keys).agg(F.max(F.col("masked").isNotNull()).alias("_known"))
    raw = flow.join(known, keys).withColumn("_flow", F.when(F.col("_known"), F.col("dx") / (F.col("t") - F.col("prev_t"))))
    raw = raw.withColumn("raw", F.abs("_flow"))
    samples = series.fill_linear(raw, ["clip_id"], "t", "raw", out="speed")
    samples = series.median_filter(samples.filter("speed is not null"), ["clip_id"], "t", "speed", c.median_window)
    stats = samples.groupBy("clip_id").agg(
        F.expr("percentile(speed, 0.5) FILTER (WHERE speed > 0)").alias("median_speed"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("samples"),
        F.avg(F.col("raw").isNull().cast("int")).alias("unmeasurable"), F.when(F.sum(F.signum(F.coalesce("_flow", F.lit(0.0)))) >= 0, F.lit(-1)).otherwise(F.lit(1)).alias("direction"),
        F.greatest(F.avg((F.col("_flow") > 0).cast("int")), F.avg((F.col("_flow") < 0).cast("int"))).alias("direction_agreement"),
    )
    limited = samples.join(stats.select("clip_id", "median_speed"), "clip_id")
    limited = series.limit_rise(limited, ["clip_id"], "t", "speed", c.rise_per_median * F.coalesce("median_speed", F.lit(0.0)), out="_held")
    clipped = limited.groupBy("clip_id").agg(F.avg((F.col("_held") < F.col("speed") - 1e-9).cast("int")).alias("clipped"))
    every = features.groupBy("clip_id").agg(F.count_distinct("frame").alias("frames"))
    diagnostics = every.join(stats, "clip_id", "left").join(clipped, "clip_id", "left").withColumn("stop_threshold", c.stop_share * F.col("median_speed"))
    diagnostics = diagnostics.withColumn("error", F.when(F.col("frames") < 2, "fewer than two samples").when(F.col("samples").isNull(), "nothing measurable"))
    return limited.select("clip_id", "t", "raw", F.col("_held").alias("speed"), "confidence"), diagnostics


def distance_document(samples: DataFrame, config: SpeedConfig = SpeedConfig(), points: int = 400) -> dict[str, DataFrame]:
    """Of speed samples (clip_id, t, speed): map (t, d), even (resampled map), stops, violations of the map."""
    c = config
    full = series.integrate(samples, ["clip_id"], "t", "speed", c.min_speed).select("clip_id", "t", "d", "speed")
    limit = samples.groupBy("clip_id").agg((c.stop_share * F.expr("percentile(speed, 0.5) FILTER (WHERE speed > 0)")).alias("_limit"))
    low = samples.join(limit, "clip_id").withColumn("_rel", F.col("speed") - F.col("_limit"))
    return {
        "map": full.select("clip_id", "t", "d"),
        "even": series.resample_even(full, ["clip_id"], "t", ["d"], points),
        "stops": spans.spans_below(low, ["clip_id"], "t", "_rel", 0.0, c.min_stop),
        "violations": series.map_violations(full, ["clip_id"], "t", "d"),
    }


def evaluate_rides(estimates: DataFrame, truth: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Scores of estimates (keys, t, speed, stationary) against truth (keys, t, speed): MAE and nearest-rank P95 of the
    error where the truth moves at 1 or more, false stops (stationary above 2), longest wait for a stop to be seen."""
    at = interp_join(estimates.withColumnRenamed("speed", "estimate"), truth.select(*keys, "t", F.col("speed").alias("truth")), list(keys), "t", ["truth"])
    at = at.withColumn("error", F.abs(F.col("estimate") - F.col("truth")))
    scores = at.groupBy(*keys).agg(
        F.expr("avg(error) FILTER (WHERE truth >= 1)").alias("mae"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY error) FILTER (WHERE truth >= 1)").alias("p95"),
        F.count_if(F.col("stationary") & (F.col("truth") > 2)).alias("false_stops"),
    )
    stops = spans.spans_below(at, keys, "t", "truth", 0.05, 0.0).select(*keys, "start", "end")
    seen = at.filter("stationary").join(stops, list(keys)).filter(F.col("t").between(F.col("start"), F.col("end")))
    first = seen.groupBy(*keys, "start").agg((F.min("t") - F.first("start")).alias("wait"))
    return scores.join(first.groupBy(*keys).agg(F.max("wait").alias("stop_latency")), list(keys), "left")
