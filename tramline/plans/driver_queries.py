"""Queries over the given tables: events stands for ride telemetry (user_id a ride, ts its time, value its speed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import arrays, geo, geometry, scalar
from tramline.operators import asof, series, spans, tracks

K = ["user_id"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """events with t: seconds since 1970, whatever the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    return _table(spark, sf, "events").select("user_id", "event_id", t.alias("t"), "value", "event_type")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_E = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, event_type FROM events)"
_W = "OVER (PARTITION BY user_id ORDER BY t)"
QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("$E", _E).replace("$W", _W)
        return f

    return register


@query("""WITH $E, s AS (SELECT *, lag(t) $W AS pt, lag(value) $W AS pv, lead(t) $W - t AS gap FROM e),
d AS (SELECT user_id, sum(coalesce((t - pt) * (greatest(value, 1e-3) + greatest(pv, 1e-3)) / 2, 0)) AS dist, count(*) AS fixes, max(t) - min(t) AS dur,
    avg(value) AS av, max(value) AS mv, count(*) FILTER (gap > 14400) AS gaps FROM s GROUP BY user_id),
l AS (SELECT user_id, t, value < 60 AS low, lag(value < 60) $W AS p FROM e),
i AS (SELECT user_id, t, low, sum(CASE WHEN p IS NULL OR p <> low THEN 1 ELSE 0 END) $W AS run FROM l),
x AS (SELECT user_id, run, max(t) - min(t) AS len FROM i WHERE low GROUP BY user_id, run HAVING max(t) - min(t) >= 3600),
n AS (SELECT user_id, count(*) AS stops, sum(len) AS stood FROM x GROUP BY user_id)
SELECT d.user_id, fixes, round(dur, 3) AS duration, round(dist, 3) AS distance, round(av, 6) AS mean_speed, mv AS max_speed, gaps, coalesce(stops, 0) AS stops, round(coalesce(stood, 0), 3) AS stood
FROM d LEFT JOIN n USING (user_id)""")
def flagship_ride_profile(spark, sf):
    e = telemetry(spark, sf)
    d = series.integrate(e, K, "t", "value").withColumn("gap", F.lead("t").over(Window.partitionBy(*K).orderBy("t")) - F.col("t"))
    rides = d.groupBy(*K).agg(F.count("*").alias("fixes"), r(F.max("t") - F.min("t"), 3).alias("duration"), r(F.max("d"), 3).alias("distance"), r(F.avg("value")).alias("mean_speed"), F.max("value").alias("max_speed"), F.count_if(F.col("gap") > 14400).alias("gaps"))
    stops = spans.spans_below(e, K, "t", "value", 60.0, 3600.0).groupBy(*K).agg(F.count("*").alias("stops"), F.sum(F.col("end") - F.col("start")).alias("stood"))
    return rides.join(stops, K, "left").withColumns({"stops": F.coalesce("stops", F.lit(0)), "stood": r(F.coalesce("stood", F.lit(0.0)), 3)})


@query("""WITH $E, a AS (SELECT *, event_id * 7919 % 10007 AS arrival FROM e),
m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT user_id, event_id, t FROM m WHERE seen IS NULL OR t > seen""")
def monotonic_filter(spark, sf):
    e = telemetry(spark, sf).withColumn("arrival", F.struct((F.col("event_id") * 7919 % 10007).alias("a"), "event_id"))
    return series.monotonic(e, K, "t", "arrival").select("user_id", "event_id", "t")


@query("""WITH $E, g AS (SELECT user_id, t, lead(t) $W - t AS gap FROM e) SELECT user_id, t, round(gap, 6) AS gap FROM g WHERE gap > 14400""")
def telemetry_gaps(spark, sf):
    return series.gaps(telemetry(spark, sf), K, "t", 14400.0).withColumn("gap", r("gap"))


@query("""WITH $E, p AS (SELECT user_id, t, 37.0 + (event_id % 1000) / 1000.0 AS lat, -122.0 + (event_id % 777) / 777.0 AS lon FROM e),
q AS (SELECT *, radians(lag(lat) $W) AS a, radians(lat) AS b, radians(lon) - radians(lag(lon) $W) AS dl FROM p)
SELECT user_id, count(*) AS fixes, round(sum(CASE WHEN a IS NULL THEN 0 ELSE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(dl / 2), 2)))) END), 3) AS metres
FROM q GROUP BY user_id""")
def path_length(spark, sf):
    p = telemetry(spark, sf).withColumns({"lat": 37.0 + (F.col("event_id") % 1000) / 1000.0, "lon": -122.0 + (F.col("event_id") % 777) / 777.0})
    return series.path_steps(p, K, "t", "lat", "lon").groupBy(*K).agg(F.count("*").alias("fixes"), r(F.sum("step_m"), 3).alias("metres"))


@query("""WITH $E, s AS (SELECT *, coalesce((t - lag(t) $W) * (greatest(value, 1e-3) + lag(greatest(value, 1e-3)) $W) / 2, 0) AS a FROM e)
SELECT user_id, event_id, round(sum(a) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 3) AS d FROM s""")
def distance_map(spark, sf):
    return series.integrate(telemetry(spark, sf), K, "t", "value").select("user_id", "event_id", r("d", 3).alias("d"))


@query("""WITH $E, s AS (SELECT user_id, event_type, t, value, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, value))
SELECT user_id, event_type, count(*) AS samples, count(*) FILTER (t <= pt) AS t_not_rising, count(*) FILTER (value <= pv) AS d_not_rising FROM s
GROUP BY ALL HAVING count(*) < 2 OR count(*) FILTER (t <= pt) > 0 OR count(*) FILTER (value <= pv) > 0""")
def map_violations(spark, sf):
    return series.map_violations(telemetry(spark, sf), [*K, "event_type"], "t", "value")


_LOW = """l AS (SELECT user_id, t, value < 60 AS low, lag(value < 60) $W AS p FROM e),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> low THEN 1 ELSE 0 END) $W AS run, row_number() $W AS n FROM l)"""


@query(f"""WITH $E, {_LOW} SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS samples FROM i WHERE low GROUP BY user_id, run HAVING max(t) - min(t) >= 3600""")
def stopped_spans(spark, sf):
    return spans.spans_below(telemetry(spark, sf), K, "t", "value", 60.0, 3600.0)


@query(f"""WITH $E, {_LOW}, u AS (SELECT user_id, run, min(n) AS a, max(n) AS b, min(t) AS s, max(t) AS e FROM i WHERE low GROUP BY user_id, run),
g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a) - 1 <= 1 THEN 0 ELSE 1 END AS nw FROM u),
h AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a) AS m FROM g)
SELECT user_id, min(s) AS start, max(e) AS "end", min(a)::INT AS first_row, max(b)::INT AS last_row FROM h GROUP BY user_id, m HAVING max(b) - min(a) + 1 >= 4""")
def merged_runs(spark, sf):
    e = telemetry(spark, sf).withColumn("low", F.col("value") < 60)
    return spans.merge_runs(e, K, "t", "low", 1, 4).drop("run")


@query(f"""WITH $E, {_LOW} SELECT user_id, t, low OR count(*) OVER (PARTITION BY user_id, run) < 3 AS low FROM i""")
def bridged_flags(spark, sf):
    e = telemetry(spark, sf).withColumn("low", F.col("value") < 60)
    return spans.bridge_short(e, K, ["t"], "low", 3).select("user_id", "t", "low")


@query("""WITH $E, n AS (SELECT *, row_number() $W AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
p AS (SELECT n.user_id, n.event_id, m.value AS v FROM n, range(-4, 5) g(k) JOIN n m ON true WHERE m.user_id = n.user_id AND m.i = greatest(1, least(n.n, n.i + k)))
SELECT user_id, event_id, round(median(v), 6) AS smooth FROM p GROUP BY ALL""")
def rolling_median_edge(spark, sf):
    return series.median_filter(telemetry(spark, sf), K, "t", "value", 9, out="smooth").select("user_id", "event_id", r("smooth").alias("smooth"))


@query("""WITH $E SELECT user_id, event_id, round(least(min(value - 0.01 * t) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) + 0.01 * t,
    min(value + 0.01 * t) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.01 * t), 5) AS held FROM e""")
def rise_limited(spark, sf):
    return series.limit_rise(telemetry(spark, sf), K, "t", "value", 0.01, out="held").select("user_id", "event_id", r("held", 5).alias("held"))


_FILL = """k AS (SELECT user_id, event_id, t, CASE WHEN value <= 100 THEN value END AS v FROM e),
f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS bt, last_value(v IGNORE NULLS) OVER p AS bv,
    first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER q AS ft, first_value(v IGNORE NULLS) OVER q AS fv FROM k
    WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH $E, {_FILL} SELECT user_id, event_id, round(coalesce(v, bv + (fv - bv) * CASE WHEN ft = bt THEN 0 ELSE (t - bt) / (ft - bt) END, bv, fv), 6) AS filled FROM f""")
def linear_fill(spark, sf):
    e = telemetry(spark, sf).withColumn("v", F.when(F.col("value") <= 100, F.col("value")))
    return series.fill_linear(e, K, "t", "v", out="filled").select("user_id", "event_id", r("filled").alias("filled"))


@query("""WITH $E, m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS top FROM e)
SELECT user_id, event_id, round(avg(top) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING), 6) AS baseline FROM m""")
def rolling_baseline(spark, sf):
    return series.ground_baseline(telemetry(spark, sf), K, "t", "value", 86400.0).select("user_id", "event_id", r("baseline").alias("baseline"))


@query("""WITH $E, w AS (SELECT a.user_id, a.event_id, exp(-0.5 * pow((b.t - a.t) / 10800.0, 2)) AS w, b.value AS v FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 21600 AND a.t + 21600)
SELECT user_id, event_id, round(sum(w * v) / sum(w), 6) AS smooth FROM w GROUP BY ALL""")
def gaussian_smooth(spark, sf):
    return series.gaussian_smooth(telemetry(spark, sf), K, "t", "value", 21600.0, out="smooth").select("user_id", "event_id", r("smooth").alias("smooth"))


def _clicks(spark, sf):
    e = telemetry(spark, sf)
    return e.filter("event_type = 'click'").select("user_id", "event_id", "t"), e.filter("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("purchase"), F.col("value").alias("paid"))


_CP = "c AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'click'), p AS (SELECT user_id, t, event_id AS purchase, value AS paid FROM e WHERE event_type = 'purchase')"


@query(f"""WITH $E, {_CP}, b AS (SELECT c.*, p.t AS bt, p.purchase AS bp, p.paid AS bv FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t),
f AS (SELECT b.*, p.t AS ft, p.purchase AS fp, p.paid AS fv FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.t),
x AS (SELECT *, ft IS NULL OR t - bt <= ft - t AS back, least(t - bt, ft - t) <= 86400 AS near FROM f)
SELECT user_id, event_id, CASE WHEN near THEN CASE WHEN back THEN bp ELSE fp END END AS purchase, CASE WHEN near THEN CASE WHEN back THEN bv ELSE fv END END AS paid FROM x""")
def asof_nearest(spark, sf):
    c, p = _clicks(spark, sf)
    return asof.asof_nearest(c, p, K, "t", tolerance=86400.0, tie=["purchase"]).select("user_id", "event_id", "purchase", "paid")


@query(f"""WITH $E, {_CP} SELECT c.user_id, c.event_id, p.purchase, coalesce(p.paid, 0.0) AS paid FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t""")
def asof_backward(spark, sf):
    c, p = _clicks(spark, sf)
    return asof.asof_backward(c, p, K, "t", default={"paid": 0.0}, tie=["purchase"]).select("user_id", "event_id", "purchase", "paid")


_INTERP = f"""{_CP}, b AS (SELECT c.*, p.t AS bt, p.paid AS bv FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t - $D),
f AS (SELECT b.*, p.t AS ft, p.paid AS fv FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.t - $D)"""


@query(f"""WITH $E, {_INTERP.replace(" - $D", "")} SELECT user_id, event_id, round(CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv - bv) * ((t - bt) / (ft - bt)) END, 6) AS paid FROM f""")
def interp_lookup(spark, sf):
    c, p = _clicks(spark, sf)
    return asof.interp_join(c, p, K, "t", ["paid"]).select("user_id", "event_id", r("paid").alias("paid"))


@query(f"""WITH $E, c AS (SELECT user_id, event_id, t - 3600 AS t FROM e WHERE event_type = 'click'), p AS (SELECT user_id, t, event_id AS purchase, value AS paid FROM e WHERE event_type = 'purchase'),
{_INTERP.replace(" - $D", "").split("), ", 2)[2]} SELECT user_id, event_id, round(coalesce(CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv - bv) * ((t - bt) / (ft - bt)) END, 0), 6) AS paid FROM f""")
def delayed_lookup(spark, sf):
    c, p = _clicks(spark, sf)
    return asof.delayed(c, p, K, "t", "paid", 3600.0).select("user_id", "event_id", r("paid").alias("paid"))


_SPANS = "s AS (SELECT user_id, t AS a, t + 7200 AS b FROM e WHERE event_type = 'signup')"


def _spans(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'signup'").select("user_id", F.col("t").alias("start"), (F.col("t") + 7200).alias("end"))


@query(f"""WITH $E, {_SPANS} SELECT user_id, event_id FROM e WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.t BETWEEN a AND b)""")
def span_semi(spark, sf):
    e = telemetry(spark, sf)
    return spans.in_spans(e, _spans(e), K, "t").select("user_id", "event_id")


@query(f"""WITH $E, {_SPANS} SELECT user_id, event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.t BETWEEN a AND b)""")
def span_anti(spark, sf):
    e = telemetry(spark, sf)
    return spans.not_in_spans(e, _spans(e), K, "t").select("user_id", "event_id")


@query("""WITH $E, s AS (SELECT user_id, t AS a, t + 7200 AS b, value AS dy FROM e WHERE event_type = 'signup'),
f AS (SELECT e.user_id, e.event_id, sum(s.dy * least(1.0, (t - a) / 600, (b - t) / 600)) AS x FROM e JOIN s ON s.user_id = e.user_id AND t BETWEEN a AND b GROUP BY ALL)
SELECT e.user_id, e.event_id, round(value + coalesce(x, 0), 6) AS value FROM e LEFT JOIN f USING (user_id, event_id)""")
def span_ramps(spark, sf):
    e = telemetry(spark, sf)
    s = e.filter("event_type = 'signup'").select("user_id", F.col("t").alias("start"), (F.col("t") + 7200).alias("end"), F.col("value").alias("dy"))
    return spans.span_adjust(e, s, K, "t", "value", 600.0).select("user_id", "event_id", r("value").alias("value"))


@query(f"""WITH $E, {_CP}, n AS (SELECT c.event_id, median(paid) AS m, max(paid) - min(paid) AS spread, count(*) AS n FROM c JOIN p ON c.user_id = p.user_id AND abs(c.t - p.t) <= 86400 GROUP BY 1)
SELECT c.user_id, c.event_id, coalesce(n, 0) AS n, round(spread, 6) AS spread, CASE WHEN n >= 2 AND spread <= 60 THEN round(m, 6) END AS paid FROM c LEFT JOIN n USING (event_id)""")
def evidence_window(spark, sf):
    c, p = _clicks(spark, sf)
    out = asof.range_median(c, p, K, "t", 86400.0, "paid", min_count=2, max_spread=60.0)
    return out.select("user_id", "event_id", "n", r("spread").alias("spread"), r("paid").alias("paid"))


@query("""WITH $E, z AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1),
c AS (SELECT user_id, g.i::INT AS i, CASE WHEN g.i = 49 THEN hi ELSE lo + g.i * ((hi - lo) / 49) END AS t FROM z, range(50) g(i)),
b AS (SELECT c.*, e.t AS bt, e.value AS bv FROM c ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.t >= e.t),
f AS (SELECT b.*, e.t AS ft, e.value AS fv FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.t <= e.t)
SELECT user_id, i, round(CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv - bv) * ((t - bt) / (ft - bt)) END, 5) AS value FROM f""")
def curve_resample(spark, sf):
    return series.resample_even(telemetry(spark, sf), K, "t", ["value"], 50).select("user_id", "i", r("value", 5).alias("value"))


@query("""WITH $E, n AS (SELECT user_id, event_id, row_number() $W - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, event_id FROM n WHERE n <= 20 OR i IN (SELECT CASE WHEN k = 19 THEN n - 1 ELSE floor(k * ((n - 1) / 19.0)) END FROM range(20) g(k))""")
def thin_path(spark, sf):
    return series.thin(telemetry(spark, sf), K, "t", 20).select("user_id", "event_id")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rank FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, rank::INT AS rank FROM w WHERE rank <= 3""")
def top_k_widest(spark, sf):
    l = _table(spark, sf, "lineitem")
    return tracks.top_k(l, ["l_orderkey"], [F.desc("l_quantity"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))], 3).select("l_orderkey", "l_linenumber", "l_quantity", "rank")


@query("""WITH w AS (SELECT l_partkey, l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag <> 'R', abs(l_quantity - 25), l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem)
SELECT l_partkey, l_orderkey, l_quantity FROM w WHERE k = 1""")
def best_per_group(spark, sf):
    l = _table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", "l_returnflag", "l_linenumber", "l_extendedprice")
    return tracks.first_by(l, ["l_partkey"], F.col("l_returnflag") != "R", F.abs(F.col("l_quantity") - 25), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")).select("l_partkey", "l_orderkey", "l_quantity")


@query("""SELECT label, count(*) AS parts FROM (SELECT CASE WHEN contains(lower(trim(p_name)), 'ring') THEN 'ring' WHEN contains(lower(trim(p_name)), 'widget') THEN 'widget' WHEN contains(lower(trim(p_name)), 'red') THEN 'red'
ELSE coalesce(nullif(lower(trim(p_name)), ''), 'unknown') END AS label FROM part) GROUP BY label""")
def label_normalize(spark, sf):
    return _table(spark, sf, "part").select(scalar.label_name(F.col("p_name"), ["ring", "widget", "red"]).alias("label")).groupBy("label").agg(F.count("*").alias("parts"))


_CLASSES = {"ring": ["round", "metal"], "red": ["bright"], "widget": ["part", "metal"]}


@query("""WITH m(k, c) AS (VALUES ('ring', 'round'), ('ring', 'metal'), ('red', 'bright'), ('widget', 'part'), ('widget', 'metal'))
SELECT p_partkey, string_agg(DISTINCT c, ',' ORDER BY c) AS classes FROM part JOIN m ON contains(lower(p_name), k) GROUP BY p_partkey""")
def label_classes(spark, sf):
    pairs = [(k, c) for k, cs in _CLASSES.items() for c in cs]
    named = tracks.labels_to_classes(_table(spark, sf, "part"), "p_name", pairs).filter("classes IS NOT NULL")
    return named.select("p_partkey", F.array_join("classes", ",").alias("classes"))


@query("""WITH $E, l AS (SELECT user_id, list_sort(list(value)) AS v FROM e GROUP BY 1)
SELECT user_id, CASE WHEN ok THEN a ELSE 0.45 END AS lo, CASE WHEN ok THEN b ELSE 0.95 END AS hi FROM
(SELECT user_id, v[1 + (len(v) * 0.05)::DOUBLE::INT - CASE WHEN (len(v) * 0.05)::DOUBLE::INT > len(v) * 0.05 THEN 1 ELSE 0 END] AS a, v[1 + floor(len(v) * 0.95::DOUBLE)::INT] AS b, len(v) >= 60 AS ok FROM l)""")
def order_stat_range(spark, sf):
    e = telemetry(spark, sf)
    g = e.groupBy(*K).agg(F.count("value").alias("n")).join(series.order_statistics(e, K, "value", {"a": 0.05, "b": 0.95}), K)
    ok = F.col("n") >= 60
    return g.select("user_id", F.when(ok, F.col("a")).otherwise(0.45).alias("lo"), F.when(ok, F.col("b")).otherwise(0.95).alias("hi"))


@query("""WITH $E SELECT user_id, quantile_disc(value, 0.95) AS p95, round(avg(value) FILTER (value >= 10), 6) AS mean_moving, count(*) FILTER (value < 5) AS slow FROM e GROUP BY 1""")
def p95_nearest_rank(spark, sf):
    return telemetry(spark, sf).groupBy(*K).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), r(F.expr("avg(value) FILTER (WHERE value >= 10)")).alias("mean_moving"), F.count_if(F.col("value") < 5).alias("slow"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_quantity - 25 AS dx, l_quantity <> 25 AS mv FROM lineitem),
m AS (SELECT k, median(dx) FILTER (mv) AS m, count(*) FILTER (mv) AS n FROM x GROUP BY k)
SELECT x.k AS frame, CASE WHEN any_value(n) >= 3 THEN round(any_value(m), 6) ELSE 0 END AS dx,
    CASE WHEN any_value(n) >= 3 THEN round((count(*) FILTER (mv AND sign(dx) = sign(m)))::DOUBLE / any_value(n), 6) ELSE 0 END AS confidence FROM x JOIN m USING (k) GROUP BY x.k""")
def median_agree(spark, sf):
    from tramline.plans.speed import frame_flow

    l = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_quantity") - 25).alias("dx"))
    out = frame_flow(l, ["frame"], F.col("dx") != 0, F.lit(True), least=3)
    return out.select("frame", r("dx").alias("dx"), r("confidence").alias("confidence"))


@query("""WITH $E, l AS (SELECT user_id, event_id, 0.299 * value + 0.587 * (value / 2) + 0.114 * (value / 4) AS l FROM e), m AS (SELECT user_id, median(l) FILTER (l > 0) AS m FROM l GROUP BY 1)
SELECT user_id, event_id, round(greatest(0.35, least(1.8, l / m)), 6) AS light FROM l JOIN m USING (user_id)""")
def luma_normalize(spark, sf):
    e = telemetry(spark, sf).withColumn("l", scalar.luma(F.col("value"), F.col("value") / 2, F.col("value") / 4))
    m = F.expr("percentile(l, 0.5) FILTER (WHERE l > 0)")
    out = e.join(e.groupBy(*K).agg(m.alias("m")), K)
    return out.select("user_id", "event_id", r(scalar.clip(F.col("l") / F.col("m"), 0.35, 1.8)).alias("light"))


@query("""WITH $E SELECT user_id, event_id, round(CASE WHEN value > 0 THEN greatest(0, least(10, 10 * (0.85 * value / 30 + 0.15 * ln(1 + 0.08 * value) / ln(1 + 0.08 * 30)))) ELSE 0 END, 6) AS game FROM e""")
def speed_curve_map(spark, sf):
    return telemetry(spark, sf).select("user_id", "event_id", r(scalar.speed_curve(F.col("value"))).alias("game"))


@query("""WITH $E, b AS (SELECT user_id, event_id, t / 86400 AS t, event_type, value / 500 AS c, 0.1 + (event_id % 7) * 0.02 AS h FROM e),
g AS (SELECT *, t - lag(t) OVER w AS gap, abs(c - lag(c) OVER w) AS mv, lag(event_type) OVER w AS pl, lag(h) OVER w AS ph FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, CASE WHEN pl IS NULL OR pl <> event_type OR gap > 2 OR mv > least(0.9 * gap, 0.18) OR greatest(h, ph) / least(h, ph) > 1.6 THEN 1 ELSE 0 END AS nw FROM g),
s AS (SELECT *, sum(nw) $W AS tr FROM n), z AS (SELECT *, count(*) OVER (PARTITION BY user_id, tr) AS k, max(t) OVER (PARTITION BY user_id, tr) - min(t) OVER (PARTITION BY user_id, tr) AS sp FROM s)
SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY tr)::INT AS track_id FROM z WHERE k >= 2 AND sp >= 0.15""")
def track_chain(spark, sf):
    c, h = F.col("value") / 500, 0.1 + (F.col("event_id") % 7) * 0.02
    e = telemetry(spark, sf).select("user_id", "event_id", (F.col("t") / 86400).alias("t"), F.col("event_type").alias("label"), c.alias("x1"), c.alias("x2"), F.lit(0.0).alias("y1"), h.alias("y2"))
    return tracks.chain_tracks(e, K, tracks.ChainConfig(max_gap=2.0)).select("user_id", "event_id", "track_id")


@query("""WITH $E, h AS (SELECT user_id, event_id, t / 3600 AS t, event_type = 'view' AS hop FROM e),
g AS (SELECT *, coalesce(t - lag(t) $W, 99) AS p, coalesce(lead(t) $W - t, 99) AS n FROM h WHERE NOT hop)
SELECT h.user_id, h.event_id, CASE WHEN h.hop THEN 0 ELSE round(greatest(0.24, least(0.7, 0.8 * least(p, n))), 6) END AS window_s, CASE WHEN h.hop THEN 0 ELSE round(greatest(0.45, least(0.9, 0.7 * p)), 6) END AS lead
FROM h LEFT JOIN g USING (user_id, event_id)""")
def scoring_windows(spark, sf):
    e = telemetry(spark, sf).select("user_id", "event_id", (F.col("t") / 3600).alias("t"), (F.col("event_type") == "view").alias("hop"))
    return series.scoring_windows(e, K, "t", "hop").select("user_id", "event_id", r("window_s").alias("window_s"), r("lead").alias("lead"))


@query("""WITH $E SELECT user_id, event_id, coalesce(last_value(CASE WHEN value <= 30 THEN 0 WHEN value >= 80 THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS "on" FROM e""")
def hysteresis(spark, sf):
    return series.hysteresis(telemetry(spark, sf), K, "t", "value", 80.0, 30.0).select("user_id", "event_id", "on")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE * 1000)::INT) AS l FROM embeddings),
y AS (SELECT vec_id, l, list_slice(l, 1 + floor(0.32 * len(l))::INT, ceil(0.38 * len(l))::INT) AS f, list_median(list_filter(l, lambda v: v <> -1)) AS m FROM x)
SELECT vec_id, round(len(list_filter(l, lambda v: v <> -1)) / len(l), 6) AS valid, round(list_median(f), 6) AS foot, round(len(list_filter(f, lambda v: v - m > 35)) / len(f), 6) AS blocked, round(greatest(0, list_max(list_transform(f, lambda v: v - m))), 6) AS depth FROM y""")
def array_footprint(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.rint(v.cast("double") * 1000).cast("int")).alias("l"))
    foot = e.withColumns({"f": arrays.footprint(F.col("l"), F.size("l")), "m": arrays.array_median(arrays.valid(F.col("l")))})
    share, depth = arrays.displaced(F.col("f"), F.col("m"), 35)
    return foot.select("vec_id", r(arrays.valid_fraction(F.col("l"))).alias("valid"), r(arrays.array_median(F.col("f"))).alias("foot"), r(share).alias("blocked"), r(depth).alias("depth"))


@query("""WITH c AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS nw FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(nw::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, run::INT AS run, any_value(role) AS role, count(*) AS length FROM s GROUP BY conv_id, run""")
def rle_encode(spark, sf):
    from tramline.sources.rle import encode

    return encode(_table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role").withColumn("run", F.col("run").cast("int"))


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS pos, role FROM conversations""")
def rle_decode(spark, sf):
    from tramline.sources.rle import decode, encode

    return decode(encode(_table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role"), ["conv_id"], "role").withColumn("pos", F.col("pos").cast("long"))


_BOX = "b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 100 / 100.0 AS cx, l_suppkey % 100 / 100.0 AS cy, l_quantity / 100 AS w, 0.1 + l_discount AS h, l_extendedprice AS s FROM lineitem)"


def _boxes(spark, sf):
    return _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 100 / 100.0).alias("cx"), (F.col("l_suppkey") % 100 / 100.0).alias("cy"), (F.col("l_quantity") / 100).alias("w"), (0.1 + F.col("l_discount")).alias("h"), F.col("l_extendedprice").alias("s"))


@query(f"""WITH {_BOX}, p AS (SELECT a.k, a.n AS a, b.n AS b, greatest(0, least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2)) * greatest(0, least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2)) AS i, a.w * a.h + b.w * b.h AS s FROM b a JOIN b ON a.k = b.k AND a.n < b.n)
SELECT k, a, b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou FROM p""")
def iou_pairs(spark, sf):
    b = _boxes(spark, sf)
    x, y = b.alias("x"), b.alias("y")
    j = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.n") < F.col("y.n")))
    box = lambda a: tuple(F.col(f"{a}.{c}") for c in ("cx", "cy", "w", "h"))
    return j.select("x.k", F.col("x.n").alias("a"), F.col("y.n").alias("b"), r(geometry.iou(box("x"), box("y"))).alias("iou"))


_CROSS = "greatest(0, least(q.x2, x[1].x2) - greatest(q.x1, x[1].x1)) * greatest(0, least(q.y2, x[1].y2) - greatest(q.y1, x[1].y1))"
_AREAS = "(q.x2 - q.x1) * (q.y2 - q.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1)"


@query(f"""WITH {_BOX}, c AS (SELECT k, n, s, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM b),
l AS (SELECT k, list([{{'n': n, 's': s, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY s DESC, x1, y1, x2, y2) AS l FROM c GROUP BY k),
r AS (SELECT k, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda q: {_CROSS} >= 0.2 * ({_AREAS} - {_CROSS}))) > 0 THEN a ELSE list_concat(a, x) END)) AS b FROM l)
SELECT k, b.n AS n, b.s AS score FROM r""")
def nms(spark, sf):
    b = _boxes(spark, sf).select("k", "n", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"), F.col("s").alias("score"))
    return tracks.nms(b, ["k"], 0.2).select("k", "n", "score")


@query("""WITH $E SELECT user_id, event_type, floor(t / 86400)::BIGINT AS day, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY ALL""")
def tumbling_windows(spark, sf):
    return telemetry(spark, sf).groupBy("user_id", "event_type", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("""WITH $E, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, s""")
def session_windows(spark, sf):
    e = _table(spark, sf, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))
    return s.select("user_id", "n", "total", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("start_us"))


@query("""WITH w AS (SELECT user_id, value, (floor(epoch_us(ts) / 21600e6) - k) * 21600 AS s, ts FROM events, range(4) g(k))
SELECT user_id, s::BIGINT AS start_s, count(*) AS n, max(value) AS top FROM w GROUP BY ALL""")
def sliding_windows(spark, sf):
    e = _table(spark, sf, "events").groupBy("user_id", F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return e.select("user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("start_s"), "n", "top")


@query()
def fusion_estimate(spark, sf):
    from tramline.streaming.fusion import estimate_rides

    e = telemetry(spark, sf).withColumns({"session_id": F.col("user_id").cast("string"), "s": F.col("t") / 3600})
    fixes = e.filter("event_type <> 'error'").select("session_id", F.col("s").alias("t"), (F.col("value") / 10).alias("speed"), (5.0 + F.col("event_id") % 50).alias("accuracy"), F.lit(None).cast("double").alias("course"))
    readings = e.filter("event_type = 'error'").select("session_id", F.col("s").alias("t"), (F.col("value") / 100).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"))
    return estimate_rides(fixes, readings)


@query()
def asym_ema(spark, sf):
    from tramline.streaming.smooth import asymmetric_ema

    e = telemetry(spark, sf).withColumn("t", F.col("t") / 3600)
    return asymmetric_ema(e, K, "t", "value", 12.0, 18.0).select("user_id", "event_id", r("smooth").alias("smooth"))


@query()
def conditioned_rate(spark, sf):
    from tramline.streaming.smooth import condition_rate

    e = telemetry(spark, sf).withColumns({"t": F.col("t") / 3600, "v": F.col("value") / 50})
    return condition_rate(e, K, "t", "v").select("user_id", "event_id", r("rate").alias("rate"))


@query()
def admission(spark, sf):
    from tramline.streaming.admission import admit_alerts

    e = telemetry(spark, sf)
    kind = F.when(F.col("event_type") == "error", "vehicle").when(F.col("event_type") == "view", "hydrant").otherwise("person")
    surfaces = F.array(F.lit("road"), F.when(F.col("event_id") % 5 == 0, "none").otherwise("sidewalk"), F.lit("path"))
    d = e.select(F.col("user_id").cast("string").alias("session_id"), (F.col("t") / 36000).alias("t"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("lane"), kind.alias("kind"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), (F.col("value") / 20).alias("speed"), surfaces.alias("surfaces"))
    return admit_alerts(d)


@query("""WITH $E, l AS (SELECT *, value < 20 AS low, lag(value < 20) $W AS p FROM e), i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> low THEN 1 ELSE 0 END) $W AS run FROM l)
SELECT user_id, event_id, CASE WHEN low AND row_number() OVER (PARTITION BY user_id, run ORDER BY t) >= 2 THEN 0 ELSE value END AS value FROM i""")
def low_streak_zero(spark, sf):
    return series.low_streak(telemetry(spark, sf), K, "t", "value", 20.0, 2).select("user_id", "event_id", "value")


@query("""WITH $E, l AS (SELECT *, value >= 20 AS f, lag(value >= 20) $W AS p FROM e), i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> f THEN 1 ELSE 0 END) $W AS run FROM l)
SELECT user_id, event_id, CASE WHEN f THEN round(t - min(t) OVER (PARTITION BY user_id, run), 5) END AS held FROM i""")
def held_flags(spark, sf):
    return series.held_for(telemetry(spark, sf).withColumn("f", F.col("value") >= 20), K, "t", "f").select("user_id", "event_id", r("held", 5).alias("held"))


@query("""WITH $E, s AS (SELECT *, coalesce(value / 50 * (t - lag(t) $W), 0) AS st FROM e)
SELECT user_id, event_id, round(least(2000000.0, sum(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)), 3) AS video_t FROM s""")
def retimed_ride(spark, sf):
    e = telemetry(spark, sf).withColumn("rate", F.col("value") / 50)
    return series.retime(e, K, "t", "rate", 2_000_000.0).select("user_id", "event_id", r("video_t", 3).alias("video_t"))


@query("""WITH $E, z AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS s FROM e), d AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS m, last_value(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fv, row_number() $W AS n FROM z),
p AS (SELECT user_id, max(t) FILTER (abs(value - fv) > 30 AND n > 1) AS moved, min(t) AS first, max(t) AS last FROM d GROUP BY 1)
SELECT user_id, CASE WHEN last - coalesce(moved, first) < 86400 THEN last ELSE coalesce(moved, first) END AS parked FROM p""")
def parked_since(spark, sf):
    return series.parked_after(telemetry(spark, sf), K, "t", "value", "value", 30.0, 86400.0)


@query("""WITH $E, f AS (SELECT user_id, event_id, t / 3600 AS t, 37 + (event_id % 100) / 1000.0 AS lat, -122 + (event_id % 77) / 1000.0 AS lon FROM e),
p AS (SELECT a.user_id, a.event_id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)))) / (a.t - b.t) AS v
FROM f a JOIN f b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 48 AND a.t - 5)
SELECT f.user_id, f.event_id, round(median(v), 4) AS speed FROM f LEFT JOIN p USING (user_id, event_id) GROUP BY ALL""")
def windowed_gps_speed(spark, sf):
    e = telemetry(spark, sf).select("user_id", "event_id", (F.col("t") / 3600).alias("t"), (37 + (F.col("event_id") % 100) / 1000.0).alias("lat"), (-122 + (F.col("event_id") % 77) / 1000.0).alias("lon"))
    return series.gps_window_speed(e, K, "t", "lat", "lon", 5.0, 48.0, None).select("user_id", "event_id", r("window_speed", 4).alias("speed"))


@query("""WITH $E, j AS (SELECT user_id, event_id, t / 3600 AS t, CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END AS v FROM e),
g AS (SELECT *, lead(v) $W AS b, lead(t) $W - t AS gap FROM j),
k AS (SELECT *, last_value(CASE WHEN b <> v AND gap <= 20 THEN t END IGNORE NULLS) OVER w AS t0, last_value(CASE WHEN b <> v AND gap <= 20 THEN v END IGNORE NULLS) OVER w AS v0,
    last_value(CASE WHEN b <> v AND gap <= 20 THEN b END IGNORE NULLS) OVER w AS v1 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)), m AS (SELECT *, (t - t0) / 20 AS x FROM k)
SELECT user_id, event_id, round(CASE WHEN t0 IS NULL THEN v WHEN x <= 1 THEN v0 + (v1 - v0) * x * x * (3 - 2 * x) ELSE v1 END, 6) AS eased FROM m""")
def step_easing(spark, sf):
    e = telemetry(spark, sf).select("user_id", "event_id", (F.col("t") / 3600).alias("t"), F.when(F.col("value") > 60, 1.0).otherwise(0.0).alias("v"))
    return series.smooth_step(e, K, "t", "v", 20.0, out="eased").select("user_id", "event_id", r("eased").alias("eased"))
