"""Series operators: one sorted run for each key, by window frames; nothing is collected to the driver.

Every ordering takes an optional list of tie columns, so that rows at one time have a defined order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.arrays import array_median
from tramline.functions.geo import bearing_deg, haversine_m
from tramline.operators.asof import asof_backward, interp_join

_PAST = (Window.unboundedPreceding, 0)


def _w(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def range_frame(expr: str, keys: Sequence[str], order: str, before: float, after: float) -> Column:
    """Aggregate over the rows within [order - before, order + after]; fractional bounds need SQL text."""
    part = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"{expr} OVER (PARTITION BY {part} ORDER BY `{order}` RANGE BETWEEN {float(before)!r}D PRECEDING AND {float(after)!r}D FOLLOWING)")


def monotonic(df: DataFrame, keys: Sequence[str], t: str, arrival: str) -> DataFrame:
    """Rows newer than everything that arrived before them; of equal times the first to arrive stays."""
    seen = F.max(t).over(_w(keys, arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col(t) > F.col("_seen"))).drop("_seen")


def gaps(df: DataFrame, keys: Sequence[str], t: str, min_gap: float = 2.0) -> DataFrame:
    """(keys, t, gap) of rows followed by nothing for more than min_gap, at the earlier row."""
    return df.select(*keys, t, (F.lead(t).over(_w(keys, t)) - F.col(t)).alias("gap")).filter(F.col("gap") > min_gap)


def path_steps(df: DataFrame, keys: Sequence[str], t: str, lat: str, lon: str) -> DataFrame:
    """Adds step_m: metres from the fix before, 0 at the first."""
    w = _w(keys, t)
    step = haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return df.withColumn("step_m", F.coalesce(step, F.lit(0.0)))


def median_filter(df: DataFrame, keys: Sequence[str], t: str, v: str, window: int, tie: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Running median over an odd window (an even one grows by one), the series' ends repeated beyond it."""
    h = (window | 1) // 2
    w, n = _w(keys, t, *tie), Window.partitionBy(*keys)
    row = F.row_number().over(w)
    near = F.collect_list(v).over(w.rowsBetween(-h, h))
    d = df.withColumns({"_row": row, "_n": F.count("*").over(n), "_near": near})
    before, after = F.greatest(F.lit(0), h + 1 - F.col("_row")).cast("int"), F.greatest(F.lit(0), F.col("_row") + h - F.col("_n")).cast("int")
    padded = F.concat(F.array_repeat(F.get("_near", F.lit(0)), before), F.col("_near"), F.array_repeat(F.element_at("_near", -1), after))
    return d.withColumn(out or v, array_median(padded)).drop("_row", "_n", "_near")


def limit_rise(df: DataFrame, keys: Sequence[str], t: str, v: str, max_change_per_second: float | Column, out: str | None = None) -> DataFrame:
    """v held so that it rises by at most the given change a second, looking from either side; falls stay.

    From the left that is the least of v_j + c (t - t_j) over the rows before, from the right the same over
    the rows after; the smaller of the two is taken. A change of 0 or less, or a single row, changes nothing."""
    c = max_change_per_second if isinstance(max_change_per_second, Column) else F.lit(float(max_change_per_second))
    w = _w(keys, t)
    d = df.withColumn("_c", c)
    d = d.withColumns({"_lo": F.col(v) - F.col("_c") * F.col(t), "_hi": F.col(v) + F.col("_c") * F.col(t)})
    left = F.min("_lo").over(w.rowsBetween(*_PAST)) + F.col("_c") * F.col(t)
    right = F.min("_hi").over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("_c") * F.col(t)
    return d.withColumn(out or v, F.when(F.col("_c") > 0, F.least(left, right)).otherwise(F.col(v))).drop("_c", "_lo", "_hi")


def integrate(df: DataFrame, keys: Sequence[str], t: str, v: str, min_speed: float = 1e-3, out: str = "d") -> DataFrame:
    """Adds the distance: cumulative trapezoids of v, which counts as min_speed at least; 0 at the first row."""
    w = _w(keys, t)
    d = df.withColumn("_v", F.greatest(F.col(v).cast("double"), F.lit(min_speed)))
    d = d.withColumn("_area", F.coalesce((F.col(t) - F.lag(t).over(w)) * (F.col("_v") + F.lag("_v").over(w)) / 2, F.lit(0.0)))
    return d.withColumn(out, F.sum("_area").over(w.rowsBetween(*_PAST))).drop("_v", "_area")


def map_violations(df: DataFrame, keys: Sequence[str], t: str, d: str) -> DataFrame:
    """(keys, samples, t_not_rising, d_not_rising) of maps that are too short or do not rise strictly."""
    w = _w(keys, t, d)
    marked = df.withColumns({"_t": F.col(t) <= F.lag(t).over(w), "_d": F.col(d) <= F.lag(d).over(w)})
    out = marked.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if("_t").alias("t_not_rising"), F.count_if("_d").alias("d_not_rising"))
    return out.filter("samples < 2 OR t_not_rising > 0 OR d_not_rising > 0")


def fill_linear(df: DataFrame, keys: Sequence[str], x: str, v: str, out: str | None = None) -> DataFrame:
    """Missing v by a straight line between the known neighbours along x, held at the ends; all missing stay missing."""
    w = _w(keys, x)
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(v).cast("double").alias("v")))
    d = df.withColumn("_k", known)
    d = d.withColumns({"_b": F.last("_k", True).over(w.rowsBetween(*_PAST)), "_f": F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    share = F.try_divide(F.col(x) - F.col("_b.x"), F.col("_f.x") - F.col("_b.x"))
    line = F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * F.coalesce(share, F.lit(0.0))
    return d.withColumn(out or v, F.coalesce(F.col(v).cast("double"), line, F.col("_b.v"), F.col("_f.v"))).drop("_k", "_b", "_f")


def ground_baseline(df: DataFrame, keys: Sequence[str], t: str, y: str, window: float = 3.0, out: str = "baseline") -> DataFrame:
    """Centred rolling maximum of y over the window, then the rolling mean of that."""
    d = df.withColumn("_top", range_frame(f"max(`{y}`)", keys, t, window / 2, window / 2))
    return d.withColumn(out, range_frame("avg(_top)", keys, t, window / 2, window / 2)).drop("_top")


def gaussian_smooth(df: DataFrame, keys: Sequence[str], t: str, v: str, window: float, out: str | None = None) -> DataFrame:
    """Gaussian mean over +-window with deviation window / 2; fewer than 3 rows in a key, or no window: unchanged."""
    out = out or v
    if window <= 0:
        return df.withColumn(out, F.col(v))
    s = window / 2
    d = df.withColumn("_near", range_frame(f"collect_list(struct(`{t}` AS t, CAST(`{v}` AS double) AS v))", keys, t, window, window))
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    def weight(p: Column) -> Column:
        return F.exp(-0.5 * F.pow((p["t"] - F.col(t)) / s, F.lit(2.0)))

    top = F.aggregate("_near", F.lit(0.0), lambda a, p: a + weight(p) * p["v"])
    low = F.aggregate("_near", F.lit(0.0), lambda a, p: a + weight(p))
    return d.withColumn(out, F.when(F.col("_n") >= 3, top / low).otherwise(F.col(v).cast("double"))).drop("_near", "_n")


def find_arcs(df: DataFrame, keys: Sequence[str], t: str, y: str, baseline: str, min_height: float = 0.05, min_duration: float = 0.15, merge_gap: float = 0.25) -> DataFrame:
    """Rises above the baseline: (keys, start, peak, end, height); short pauses join rises, the first highest row is the peak."""
    from tramline.operators.spans import merge_runs

    d = df.withColumn("_rise", F.col(baseline) - F.col(y)).withColumn("_up", F.col("_rise") > min_height)
    runs = merge_runs(d, keys, t, "_up", merge_gap, min_duration, by="time").select(*keys, "run", "start", "end")
    # runs of a key are disjoint: the last one begun is the only one that can hold a row
    runs = runs.withColumn(t, F.col("start"))
    inside = asof_backward(d, runs, keys, t).filter(F.col(t).between(F.col("start"), F.col("end")))
    return inside.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max_by(t, F.struct(F.col("_rise"), -F.col(t))).alias("peak"), F.max("end").alias("end"), F.max("_rise").alias("height")).drop("run")


def parked_after(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, tolerance: float = 0.01, minimum_span: float = 3.0) -> DataFrame:
    """(keys, parked): last time the place differs from the final one; the end where less than minimum_span follows."""
    whole = _w(keys, t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({"_x": F.last(x).over(whole), "_y": F.last(y).over(whole), "_row": F.row_number().over(_w(keys, t))})
    away = (F.abs(F.col(x) - F.col("_x")) > tolerance) | (F.abs(F.col(y) - F.col("_y")) > tolerance)
    out = d.groupBy(*keys).agg(F.max(F.when(away & (F.col("_row") > 1), F.col(t))).alias("_moved"), F.min(t).alias("_first"), F.max(t).alias("_end"))
    since = F.coalesce("_moved", "_first")
    return out.select(*keys, F.when(F.col("_end") - since < minimum_span, F.col("_end")).otherwise(since).alias("parked"))


def gps_window_speed(df: DataFrame, keys: Sequence[str], t: str, lat: str, lon: str, min_baseline: float = 2.5, max_baseline: float = 6.0, max_samples: int | None = 32) -> DataFrame:
    """Adds window_speed: median of distance over time from each fix of the last max_baseline seconds that is at
    least min_baseline old; and window_course from the oldest of them. Null where there is none. max_samples: the most
    fixes of a window, the newest (None: all of its time)."""
    past = range_frame(f"collect_list(struct(`{t}` AS t, `{lat}` AS lat, `{lon}` AS lon))", keys, t, max_baseline, 0.0)
    d = df.withColumn("_past", past)
    past = F.array_sort("_past")
    if max_samples:
        past = F.slice(past, -F.least(F.size("_past"), F.lit(max_samples)), max_samples)
    d = d.withColumn("_past", F.filter(past, lambda p: F.col(t) - p["t"] >= min_baseline))
    speeds = F.transform("_past", lambda p: haversine_m(p["lat"], p["lon"], F.col(lat), F.col(lon)) / (F.col(t) - p["t"]))
    oldest = F.get("_past", F.lit(0))
    return d.withColumns({"window_speed": array_median(speeds), "window_course": bearing_deg(oldest["lat"], oldest["lon"], F.col(lat), F.col(lon))}).drop("_past")


def smooth_step(df: DataFrame, keys: Sequence[str], t: str, v: str, ramp: float, out: str | None = None) -> DataFrame:
    """Each jump of v turned into a cubic ease of length `ramp` that begins at the row before it. The last jump governs,
    and v stays at its new value until the next; a jump without a row in its ramp is passed over."""
    w = _w(keys, t)
    d = df.withColumns({"_to": F.lead(v).over(w), "_next": F.lead(t).over(w)})
    jump = (F.col("_to") != F.col(v)) & (F.col("_next") - F.col(t) <= ramp)
    d = d.withColumn("_jump", F.when(jump, F.struct(F.col(t).alias("t0"), F.col(v).alias("a"), F.col("_to").alias("b"))))
    d = d.withColumn("_j", F.last("_jump", True).over(w.rowsBetween(*_PAST)))
    x = (F.col(t) - F.col("_j.t0")) / ramp
    eased = F.when(x <= 1, F.col("_j.a") + (F.col("_j.b") - F.col("_j.a")) * x * x * (3 - 2 * x)).otherwise(F.col("_j.b"))
    return d.withColumn(out or v, F.coalesce(eased, F.col(v).cast("double"))).drop("_to", "_next", "_jump", "_j")


def resample_even(curve: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], count: int) -> DataFrame:
    """The curve at `count` evenly spaced places from its first to its last: (keys, i, x, ys)."""
    if count < 2:
        raise ValueError("count must be 2 or more")
    ends = curve.groupBy(*keys).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    place = F.when(F.col("i") == count - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("i") * ((F.col("_hi") - F.col("_lo")) / (count - 1)))
    return interp_join(grid.select(*keys, "i", place.alias(x)), curve, keys, x, ys)


def thin(df: DataFrame, keys: Sequence[str], order: str, max_points: int) -> DataFrame:
    """At most max_points rows of each key, evenly spread by rank, the first and last among them."""
    w = _w(keys, order)
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    step = (F.col("_n") - 1) / F.lit(float(max(1, max_points - 1)))
    j = F.coalesce(F.floor(F.try_divide(F.col("_i"), step)), F.lit(0))
    at = lambda k: F.floor(k * step)
    hit = (F.col("_i") == F.col("_n") - 1) | ((j < max_points - 1) & (at(j) == F.col("_i"))) | ((j + 1 < max_points - 1) & (at(j + 1) == F.col("_i")))
    return d.filter((F.col("_n") <= max_points) | hit).drop("_i", "_n")


def low_streak(df: DataFrame, keys: Sequence[str], t: str, v: str, below: float = 0.75, rows: int = 3, out: str | None = None) -> DataFrame:
    """v set to 0 from the rows-th consecutive value below the limit on."""
    from tramline.operators.spans import islands

    d = islands(df.withColumn("_low", F.col(v) < below), keys, [t], "_low", "_run")
    k = F.row_number().over(_w([*keys, "_run"], t))
    return d.withColumn("_k", k).withColumn(out or v, F.when(F.col("_low") & (F.col("_k") >= rows), F.lit(0.0)).otherwise(F.col(v))).drop("_low", "_run", "_k")


def hysteresis(df: DataFrame, keys: Sequence[str], t: str, v: str, entry: float, stop: float, out: str = "on") -> DataFrame:
    """Adds a state: 1 from v at entry or above, 0 from v at stop or below, else as before; 0 at first."""
    if entry <= stop:
        raise ValueError("entry must exceed stop")
    mark = F.when(F.col(v) <= stop, 0).when(F.col(v) >= entry, 1)
    return df.withColumn(out, F.coalesce(F.last(mark, True).over(_w(keys, t).rowsBetween(*_PAST)), F.lit(0)))


def held_for(df: DataFrame, keys: Sequence[str], t: str, flag: str, out: str = "held") -> DataFrame:
    """Adds how long the flag has been true without a break, null where it is not."""
    from tramline.operators.spans import islands

    d = islands(df, keys, [t], flag, "_run")
    return d.withColumn(out, F.when(F.col(flag), F.col(t) - F.min(t).over(Window.partitionBy(*keys, "_run")))).drop("_run")


def retime(df: DataFrame, keys: Sequence[str], t: str, rate: str, duration: float | Column, out: str = "video_t") -> DataFrame:
    """Position on a recorded route: the rate summed over time, held at the route's end."""
    w = _w(keys, t)
    step = F.coalesce(F.col(rate) * (F.col(t) - F.lag(t).over(w)), F.lit(0.0))
    d = df.withColumn("_step", step)
    end = duration if isinstance(duration, Column) else F.lit(float(duration))
    return d.withColumn(out, F.least(end, F.sum("_step").over(w.rowsBetween(*_PAST)))).drop("_step")


def scoring_windows(events: DataFrame, keys: Sequence[str], t: str, hop: str) -> DataFrame:
    """Adds window_s and lead from the gaps to the scored events around; hops score nothing and count for nobody."""
    w = _w(keys, t)
    scored = events.filter(~F.col(hop)).select(*keys, t).distinct()
    near = scored.withColumns({"_p": F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(99.0)), "_n": F.coalesce(F.lead(t).over(w) - F.col(t), F.lit(99.0))})
    d = events.join(near, [*keys, t], "left")
    window = F.greatest(F.lit(0.24), F.least(F.lit(0.7), 0.8 * F.least("_p", "_n")))
    lead = F.greatest(F.lit(0.45), F.least(F.lit(0.9), 0.7 * F.col("_p")))
    return d.withColumns({"window_s": F.when(F.col(hop), F.lit(0.0)).otherwise(window), "lead": F.when(F.col(hop), F.lit(0.0)).otherwise(lead)}).drop("_p", "_n")


def order_statistics(df: DataFrame, keys: Sequence[str], v: str, shares: dict[str, float]) -> DataFrame:
    """(keys, <name> ...): of each key's n sorted values the one at floor(n * share), counted from 0; nulls are left out.

    A window numbers the rows and only the wanted ones are kept; no array of a key's values is made."""
    w = Window.partitionBy(*keys)
    d = df.filter(F.col(v).isNotNull()).select(*keys, F.col(v).alias("_v"), (F.row_number().over(w.orderBy(v)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    at = {name: F.col("_i") == F.floor(F.col("_n") * share) for name, share in shares.items()}
    hit = F.lit(False)
    for c in at.values():
        hit |= c
    return d.filter(hit).groupBy(*keys).agg(*[F.max(F.when(c, F.col("_v"))).alias(name) for name, c in at.items()])
