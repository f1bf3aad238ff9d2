"""Sightings of objects: chains, best choices and greedy suppression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChainConfig:
    max_gap: float = 0.45
    rate: float = 0.9
    max_step: float = 0.18
    max_height_ratio: float = 1.6
    min_samples: int = 2
    min_duration: float = 0.15


def chain_tracks(sightings: DataFrame, keys: Sequence[str], config: ChainConfig = ChainConfig(), t: str = "t") -> DataFrame:
    """Number the tracks (track_id, from 1 by first time) of sightings (t, label, x1, y1, x2, y2), and rows in each (seq).

    A sighting begins a track if the label changes, too much time passes, the centre moves too far for that
    time, or the height changes too much. Tracks with too few sightings or too short go."""
    c = config
    w = Window.partitionBy(*keys).orderBy(t, "x1", "y1", "x2", "y2", "label")
    centre, height = (F.col("x1") + F.col("x2")) / 2, F.col("y2") - F.col("y1")
    d = sightings.withColumns({"_c": centre, "_h": height})
    gap = F.col(t) - F.lag(t).over(w)
    move = F.abs(F.col("_c") - F.lag("_c").over(w))
    ratio = F.try_divide(F.greatest(F.col("_h"), F.lag("_h").over(w)), F.least(F.col("_h"), F.lag("_h").over(w)))
    new = (F.col("label") != F.lag("label").over(w)) | (gap > c.max_gap) | (move > F.least(c.rate * gap, F.lit(c.max_step))) | F.coalesce(ratio > c.max_height_ratio, F.lit(True))
    d = d.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_raw", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*keys, "_raw")
    d = d.withColumns({"_n": F.count("*").over(one), "_span": F.max(t).over(one) - F.min(t).over(one)}).filter((F.col("_n") >= c.min_samples) & (F.col("_span") >= c.min_duration))
    rank = Window.partitionBy(*keys).orderBy("_raw")
    return d.withColumns({"track_id": F.dense_rank().over(rank), "seq": F.row_number().over(Window.partitionBy(*keys, "_raw").orderBy(t, "x1", "y1", "x2", "y2")) - 1}).drop("_c", "_h", "_new", "_raw", "_n", "_span")


def top_k(df: DataFrame, group: Sequence[str], by: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col("rank") <= k)


def first_by(df: DataFrame, group: Sequence[str], *by: Column) -> DataFrame:
    """The least row of each group by the given columns; one aggregate, no sort."""
    rest = [c for c in df.columns if c not in group]
    out = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*[b.alias(f"_{i}") for i, b in enumerate(by)])).alias("_row"))
    return out.select(*group, "_row.*")


def nms(boxes: DataFrame, keys: Sequence[str], iou_threshold: float = 0.45, score: str = "score", tie: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Greedy suppression of boxes (x1, y1, x2, y2, score) inside each group of keys (an image's class): by falling
    score, a box goes if it overlaps a kept one by iou_threshold or more.

    A group is the boxes of one class in one frame, filtered by score before, so it fits one array."""
    rest = [c for c in boxes.columns if c not in keys]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("_by"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], F.struct(*rest).alias("box"))))
    sides = [f"{{}}.box.{c}" for c in ("x1", "y1", "x2", "y2")]
    k, b = ([s.format(n) for s in sides] for n in ("k", "b"))
    common = f"greatest(0D, least({k[2]}, {b[2]}) - greatest({k[0]}, {b[0]})) * greatest(0D, least({k[3]}, {b[3]}) - greatest({k[1]}, {b[1]}))"
    area = " + ".join(f"greatest(0D, {s[2]} - {s[0]}) * greatest(0D, {s[3]} - {s[1]})" for s in (k, b))
    clash = f"exists(kept, k -> {area} - {common} > 0 AND {common} >= {float(iou_threshold)!r}D * ({area} - {common}))"
    kept = F.expr(f"aggregate(ranked, slice(ranked, 1, 0), (kept, b) -> if({clash}, kept, concat(kept, array(b))))")
    return boxes.groupBy(*keys).agg(ranked.alias("ranked")).select(*keys, F.explode(kept).alias("_kept")).select(*keys, "_kept.box.*").select(*boxes.columns)


def follow_marker(candidates: DataFrame, keys: Sequence[str], max_jump: float = 0.25, pull: float = 6.0) -> DataFrame:
    """One candidate (t, x, y, score) a frame: the best score, discounted by its distance from the last accepted one.

    A choice that jumps further than max_jump is refused; after a refusal the next frame chooses freely."""
    schema = candidates.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "x", "y"], kind="stable").reset_index(drop=True)
        out, last = [], None
        for _, frame in pdf.groupby("t", sort=True):
            far = np.zeros(len(frame)) if last is None else np.hypot(frame["x"] - last[0], frame["y"] - last[1])
            i = int(np.argmax(frame["score"].to_numpy() / (1 + pull * np.asarray(far))))
            if last is not None and np.asarray(far)[i] > max_jump:
                last = None
                continue
            out.append(frame.index[i])
            last = (frame["x"].iloc[i], frame["y"].iloc[i])
        return pdf.loc[out]

    return candidates.groupBy(*keys).applyInPandas(run, schema)


def match_boxes(pairs: DataFrame, keys: Sequence[str], max_distance: float = 0.14) -> DataFrame:
    """The one-to-one matches among candidate pairs (keys, left, right, distance, ...): nearest first, each left and each
    right once, none at max_distance or beyond; ties by left, then right.

    keys name a frame pair, whose candidates are few; all of its rows are taken together."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, out = set(), set(), []
        for row in pdf.sort_values(["distance", "left", "right"], kind="stable").itertuples():
            if row.left not in left and row.right not in right:
                left.add(row.left)
                right.add(row.right)
                out.append(row.Index)
        return pdf.loc[out]

    return pairs.filter(F.col("distance") < max_distance).groupBy(*keys).applyInPandas(run, pairs.schema)


def nearest_sighting(sightings: DataFrame, track: Sequence[str], distance: str, *tie: str) -> DataFrame:
    """The sighting of each track that is nearest; of equal ones the first by tie."""
    return first_by(sightings, track, F.col(distance), *(F.col(t) for t in tie))


def worst(found: DataFrame, by: str, n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """The n rows with the largest `by`, for a report."""
    return found.orderBy(F.col(by).desc_nulls_last(), *tie).limit(n)


def track_stats(strips: DataFrame, keys: Sequence[str], track: str, silhouette: Column) -> DataFrame:
    """(keys, tracks, samples, silhouettes): how many tracks and samples, and how many samples have a silhouette."""
    return strips.groupBy(*keys).agg(F.count_distinct(track).alias("tracks"), F.count("*").alias("samples"), F.count_if(silhouette).alias("silhouettes"))


def labels_to_classes(df: DataFrame, label: str, mapping: Sequence[tuple[str, str]], out: str = "classes") -> DataFrame:
    """df with the sorted classes whose keywords its label contains, lower-cased; null where no keyword fits.

    mapping: (keyword, class) pairs, a fixed short list."""
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(c)) for k, c in mapping)))
    return df.withColumn(out, F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))))
