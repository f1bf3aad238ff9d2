"""Pieces the text operators share: tables cut to shared storage, and NumPy views of Arrow text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go when a local session names no shared folder.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: `spark.checkpoint.dir` of the session. Only a session whose
    executors are its own process may go without; on a cluster a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def materialize(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. The files stay until the owner of the folder clears it; the shuffle
    files of the write, which nothing reads again, go when it ends.
    options: those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tramline/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, since texts may be long; the session keeps a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether the row belongs to the named fold: crc32 of the id as text, modulo folds. Null ids are in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sliced_rank(df: DataFrame, group: list[str], order: list[Column], slices: int, key: Column, name: str) -> DataFrame:
    """Gapless rank from 0 inside each group without putting a whole group into one task.

    Rows are dealt to `slices` slices by `key`; slices are counted, offsets are running sums over the
    few slice rows, and only the rows of one slice are sorted together. `slices` should grow with the
    largest group. Ranks follow (slice, order); rows that tie in all of `order` are interchangeable.
    """
    from pyspark.sql import Window

    d = df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    counts = d.groupBy(*group, "_slice").count()
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_offset"))
    local = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)) - 1)
    on = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(offsets, on).withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long"))
    return out.drop("_slice", "_s", "_offset", "_rn", *[f"_g{i}" for i in range(len(group))])


# ---------------------------------------------------------------- Arrow text as NumPy

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240).integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), _U(base), _U)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: (first row, end row, bytes, offsets from 0)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a chunk, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    np.logical_not(gap, out=gap)
    starts, ends = np.flatnonzero(gap & before), np.flatnonzero(gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from one running polynomial over the chunk."""
    if not len(starts):
        return np.zeros(0, _U)
    n = len(lowered)
    run = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[lowered] * _power("up", _BASE, n), out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", _INVERSE, n)[starts] + (ends - starts).astype(_U) * _GOLD)
