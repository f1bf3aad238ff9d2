"""Sharding by Karmarkar-Karp differencing: indivisible groups of rows into shards of nearly equal bytes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm._common import materialize, sliced_rank

#: Groups that one task differences at once; parts of a shard from which a group counts as large (so there are at
#: most LARGE times as many as shards); and how much smaller each pass is than the one before.
BLOCK, LARGE, SHRINK = 2048, 64, 16


def differencing(vectors: list[list[int]], k: int) -> list[list[int]]:
    """Combine partial k-way partitions into one. vectors: for each partition its k subset sums.
    Returns for each of them the final subset of each of its subsets.

    The two partitions of largest spread are combined again and again, the largest subset of one with
    the smallest of the other, so that their differences cancel."""
    heap = []
    for i, v in enumerate(vectors):
        order = sorted(range(k), key=v.__getitem__, reverse=True)
        sums = [v[j] for j in order]
        heap.append((sums[-1] - sums[0], i, sums, [[(i, j)] for j in order]))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, ma = heapq.heappop(heap)
        _, _, b, mb = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        for x, y in zip(ma, reversed(mb)):
            x.extend(y)
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        sums = [sums[j] for j in order]
        heapq.heappush(heap, (sums[-1] - sums[0], serial, sums, [ma[j] for j in order]))
        serial += 1
    out = [[0] * k for _ in vectors]
    if heap:
        for subset, members in enumerate(heap[0][3]):
            for i, j in members:
                out[i][j] = subset
    return out


def fill(sizes: list[int], load: list[float]) -> list[int]:
    """Shard of each group, so that the groups level what the shards hold already (load). The load takes part in the
    differencing as a partial partition of its own, which tells the subsets apart."""
    k = len(load)
    placed = differencing([[round(v) for v in load], *([b] + [0] * (k - 1) for b in sizes)], k)
    shard = {subset: j for j, subset in enumerate(placed[0])}
    return [shard[p[0]] for p in placed[1:]]


def _filled(load: list[int], total: int):
    """One block of groups (block, key, bytes) -> (key, bytes, shard), levelling its share of the load."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=False, kind="stable")
        part = float(pdf["bytes"].sum()) / max(1, total)
        return pdf.assign(shard=fill([int(b) for b in pdf["bytes"]], [v * part for v in load]))[["key", "bytes", "shard"]]

    return run


def assign_groups(groups: DataFrame, shards: int, block: int = BLOCK, label: str = "shards") -> DataFrame:
    """groups (key long, bytes long), each key once -> (key, bytes, shard).

    The few groups of over 1/LARGE of a shard are differenced together. The others follow in passes, each
    SHRINK times smaller than the one before. In a pass, blocks of about `block` groups are differenced in
    parallel, each against its share of what the shards hold by then; so a pass levels what the one before
    left, and no task holds more than a block, whatever the number of groups."""
    groups = materialize(groups, f"{label}-groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    limit = total // (shards * LARGE)
    large = groups.filter(F.col("bytes") > limit)
    spark, schema = groups.sparkSession, "key long, bytes long, shard int"
    done = [materialize(large.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_filled([0] * shards, 1), schema), label)]
    lots = [1.0]
    while n * lots[-1] > block:
        lots.append(lots[-1] / SHRINK)
    load = _load(done[0], shards)
    for k, share in enumerate(lots):
        low, high = (lots[k + 1] if k + 1 < len(lots) else 0.0), share
        place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
        part = groups.filter((F.col("bytes") <= limit) & (place >= low) & (place < high))
        count, mass = part.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        dealt = part.select(F.pmod(F.xxhash64("key", F.lit(k)), F.lit(max(1, -(-count // block)))).alias("block"), "key", "bytes")
        done.append(materialize(dealt.groupBy("block").applyInPandas(_filled(load, mass), schema), label))
        load = [a + b for a, b in zip(load, _load(done[-1], shards))]
    out = spark.createDataFrame([], schema)
    for d in done:
        out = out.unionByName(d)
    return out


def _load(placed: DataFrame, shards: int) -> list[int]:
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    return [held.get(j, 0) for j in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 40, group: Column | None = None, overhead: int = 16, label: str = "shards") -> DataFrame:
    """Put all rows of docs into shards of nearly equal bytes; rows of one group stay together.

    docs: doc_id, text. group: what is indivisible, by default equal texts (null and empty texts are one
    group). Returns doc_id, size (UTF-8 bytes of the text, null 0, plus overhead), text_crc32 (0 for null),
    law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null: this law moves rows when
    the number of shards changes), group_key.

    Groups go by a 64-bit hash; two groups that share one would only stay together as well. A group larger
    than an equal share fills its shard alone. With fewer groups than shards some shards stay empty; an
    empty table gives an empty result. Rows that repeat a doc_id get slots of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(group if group is not None else text).alias("group_key"))
    rows = materialize(rows, f"{label}-rows")
    groups = rows.groupBy(F.col("group_key").alias("key")).agg(F.sum("size").alias("bytes"))
    placed = materialize(rows.join(assign_groups(groups, shards, label=label).select("key", "shard"), F.col("group_key") == F.col("key")).drop("key"), f"{label}-placed")
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    out = sliced_rank(placed, ["shard"], [F.col("doc_id").asc_nulls_last(), F.col("group_key")], max(32, -(-largest // 50_000)), F.struct("doc_id", "group_key"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_key")
