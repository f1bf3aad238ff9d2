"""Packing by optimal length buckets: boundaries by dynamic programming over the global histogram of lengths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm._common import materialize, sliced_rank

def words_of(text: Column) -> Column:
    """Number of words of a text: runs of anything but ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _layer(before: np.ndarray, c: np.ndarray, s: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: for each end j the least of before[i] + padding of the lengths i .. j - 1 in one bucket, and its i.

    The best i never falls as j rises, so the middle of each stretch of ends bounds the search on both sides of it.
    All stretches of a level are searched at once."""
    n = len(top)
    new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        count = np.minimum(last, mid - 1) - first + 1
        at = np.concatenate([[0], np.cumsum(count)[:-1]])
        row = np.repeat(np.arange(len(mid)), count)
        i = np.arange(count.sum()) - at[row] + first[row]
        value = before[i] + (c[mid][row] - c[i]) * top[mid - 1][row] - (s[mid][row] - s[i])
        new[mid] = np.minimum.reduceat(value, at)
        hit = np.flatnonzero(value == new[mid][row])
        arg[mid] = i[hit[np.unique(row[hit], return_index=True)[1]]]
        left, right = lo < mid, mid < hi
        lo, hi, first, last = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (first[left], arg[mid][right]), (arg[mid][left], last[right])))
    return new, arg


def optimal_boundaries(counts: list[int], sums: list[int], tops: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets over the bins (in order) with the least total padding.

    counts, sums, tops: rows, sum of lengths and largest length of each bin. A row is padded to the top of
    its bucket, which is the top of the bucket's last bin. O(buckets * bins * log(bins)), vectorised."""
    n = len(tops)
    if not n:
        return []
    c, s = (np.concatenate([[0.0], np.cumsum(np.array(x, float))]) for x in (counts, sums))
    top = np.array(tops, float)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = []
    value = math.inf
    for _ in range(min(buckets, n)):
        new, arg = _layer(best, c, s, top)
        if new[n] >= value:
            break
        value, best = new[n], new
        back.append(arg)
    out, end = [], n
    for arg in reversed(back):
        out.append(int(tops[end - 1]))
        end = int(arg[end])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, label: str = "packing") -> DataFrame:
    """Deal documents into length buckets of least padding, and form batches of padded tokens inside each.

    docs: doc_id, text. Returns doc_id, n_tokens (words), bucket (from 0, by length), bucket_len (its padded
    length), batch (from 0 in each bucket), position (from 0 in each batch), padding (bucket_len - n_tokens).

    A batch holds token_budget // bucket_len rows; all batches of a bucket but its last are full. Rows go
    to batches by a hash, so a batch mixes sources. Empty and null texts have length 0 and lie in the first
    bucket. A text longer than the budget is a batch of its own, and is never cut. Rows that repeat a doc_id
    are rows of their own. An empty table gives an empty result."""
    rows = materialize(docs.select("doc_id", words_of(F.col("text")).alias("n_tokens")), f"{label}-lengths")
    bins = rows.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()  # a number for each length that occurs: it grows with the longest text
    tops, n = bins["n_tokens"].to_numpy(), bins["count"].to_numpy()
    ends = optimal_boundaries(n, n * tops, tops, buckets)
    return fill_batches(rows, ends, token_budget, largest=_largest(tops, n, ends))


def _largest(tops: np.ndarray, counts: np.ndarray, ends: list[int]) -> int:
    return int(np.bincount(np.searchsorted(ends, tops), counts, minlength=1).max())


def fill_batches(rows: DataFrame, ends: list[int], token_budget: int, largest: int) -> DataFrame:
    """Batches inside the buckets that end at `ends`; largest: rows of the largest bucket."""
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    length = F.element_at(F.array(*[F.lit(int(e)).cast("long") for e in ends or [0]]), F.col("bucket") + 1)
    d = rows.withColumn("bucket", bucket).withColumn("bucket_len", length)
    d = d.withColumn("_h", F.xxhash64("doc_id", "n_tokens"))
    d = sliced_rank(d, ["bucket"], [F.col("_h"), F.col("doc_id")], max(64, -(-largest // 50_000)), F.struct("_h"), "_rank")
    room = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(1, bucket_len)"))
    return d.withColumn("_room", room).select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("_rank div _room").alias("batch"), F.expr("_rank % _room").alias("position"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
