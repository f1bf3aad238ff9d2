"""Cutting lineage: a table that several later steps read is written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: What holds while a table is written: the shuffle files of the write, which nothing reads again, go when it ends. With `grouped`, rows
#: that lie together by some of a join's keys stay where they are.
CLEANUP, ALL_KEYS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition"


def cut(df: DataFrame, grouped: bool = False) -> DataFrame:
    """df as Parquet below `spark.checkpoint.dir`, where it stays until the folder's owner clears it. Only a local session may go without
    that setting, and uses a folder of its own; on a cluster it is an error.

    grouped: joins by a clip and more keep the clip's rows in the task that has them, instead of dealing them out by all keys."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(named or f'file://{tempfile.mkdtemp(prefix="spark-")}').rstrip('/')}/tramline/cut-{uuid.uuid4().hex}"
    held = {CLEANUP: "true"} | ({ALL_KEYS: "false"} if grouped else {})
    before = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)
