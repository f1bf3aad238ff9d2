"""Run-length tables: encode rows to runs, decode runs to rows, and the one-line text form of a class map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def encode(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, run from 1, value, length): runs of equal value in order; nulls are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_new", F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1)))
    first = F.row_number().over(w) == 1
    d = d.withColumn("_new", F.when(first, F.lit(1)).otherwise(F.col("_new")))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def decode(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, pos from 0, value): one row for each unit of length."""
    w = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    d = runs.withColumn("_start", F.coalesce(F.sum("length").over(w), F.lit(0))).filter("length > 0")
    return d.select(*keys, value, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("length") - 1)).alias("pos"))


def read_class_maps(spark: SparkSession, path: str) -> DataFrame:
    """Text files 'w h' followed by value and length pairs -> (image_id, width, height, run, class_id, length, complete).

    complete: whether the lengths fill the map exactly; an image that doesn't stays, so it can be reported."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), F.split(F.trim("value"), r"\s+").alias("p"))
    raw = raw.select("image_id", F.transform("p", lambda x: x.try_cast("int")).alias("p"))
    raw = raw.select("image_id", F.get("p", F.lit(0)).alias("width"), F.get("p", F.lit(1)).alias("height"), F.slice("p", 3, F.greatest(F.lit(0), F.size("p") - 2)).alias("p"))
    n = F.floor(F.size("p") / 2).cast("int")
    runs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: i <= n), lambda i: F.struct(i.alias("run"), F.get("p", 2 * i - 2).alias("class_id"), F.get("p", 2 * i - 1).alias("length")))
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return raw.withColumn("runs", runs).withColumn("complete", total == F.col("width").cast("long") * F.col("height")).select("image_id", "width", "height", "complete", F.explode_outer("runs").alias("r")).select("image_id", "width", "height", "r.run", "r.class_id", "r.length", "complete")


def class_map_text(runs: DataFrame) -> DataFrame:
    """(image_id, text): the inverse of read_class_maps, for runs (image_id, width, height, run, class_id, length)."""
    g = runs.groupBy("image_id", "width", "height").agg(F.array_sort(F.collect_list(F.struct("run", "class_id", "length"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["class_id"], x["length"])), " ")
    return g.select("image_id", F.concat_ws(" ", "width", "height", body).alias("text"))
