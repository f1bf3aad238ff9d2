"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors very near to each other first become one bundle around a leader (equal signs on random planes, then a checked
angle), so that a group of copies is one node. Leaders are dealt to shards; each shard builds its graph; every
shard is asked for every leader, in blocks. In each block a sample is compared with all nodes of the shard, and the
beams are widened until the audit passes. Pairs found are verified in double precision, and components are unions of them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tramline.llm._common import materialize, mix, small_batches
from tramline.llm.components import connected_components

#: Links of a node: on the ground layer and above; candidates looked at when a node is linked; first width of a beam.
GROUND, UPPER, BUILD, BEAM = 32, 16, 64, 32
#: Nodes expanded together in a step, nodes linked together, queries searched together.
WIDE, INSERT, ASK = 4, 512, 512
#: Sampled queries of a block's audit, and as many probes, and the recall it must reach.
AUDIT, RECALL = 128, 0.98
#: Shards at least, leaders of a shard, queries of a block.
SHARDS, SHARD_ROWS, BLOCK_ROWS = 6, 100_000, 65_536
#: Numbers of a table that a step of a search holds at once (queries times nodes, or times the beam), and partitions of the search: few
#: enough that a shuffle writes graphs as they come, without sorting them in memory.
AT_ONCE, PARTS = 1 << 24, 200
#: Planes whose signs make a bundle's key, and the least cosine of a member to its leader.
PLANES, TIGHT = 32, 0.99


# ---------------------------------------------------------------- the graph of one shard


class Graph:
    """Nodes stand in order of their layers: layer k holds the first len(links[k]) nodes. links: ids, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.v, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray, heights: np.ndarray) -> Graph:
        """vectors: float32 of length 1, by descending height (layers above the ground)."""
        g = cls(vectors, [])
        for layer in range(int(heights[0]) if len(heights) else 0, -1, -1):
            n = int((heights >= layer).sum())
            g.links.insert(0, np.full((n, UPPER if layer else GROUND), -1, np.int32))
            for lo in range(0, n, INSERT):
                g._insert(np.arange(lo, min(n, lo + INSERT)))
        return g

    def _insert(self, new: np.ndarray) -> None:
        """Link new nodes on the lowest layer there is: to what a search finds among the older ones, and among themselves."""
        links, v = self.links[0], self.v
        width = links.shape[1]
        own = v[new] @ v[new].T
        np.fill_diagonal(own, -2)
        ids, sims = np.broadcast_to(new, own.shape), own
        if new[0]:
            old, old_sims = self.search(v[new], BUILD, older=int(new[0]))
            ids, sims = np.concatenate([old, ids], 1), np.concatenate([old_sims, sims], 1)
        picked = self._choose(ids, sims, width // 2)
        links[new, : width // 2] = picked
        a, b = np.repeat(new, width // 2), picked.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        to, first, n = np.unique(b, return_index=True, return_counts=True)
        most = int(n.max()) if len(n) else 0
        back = np.full((len(to), most), -1, np.int64)
        back[np.repeat(np.arange(len(to)), n), np.arange(len(b)) - np.repeat(first, n)] = a
        for lo in range(0, len(to), 2048):
            part = to[lo : lo + 2048]
            ids = np.concatenate([links[part], back[lo : lo + 2048]], 1)
            ids = np.sort(ids, 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("bed,bd->be", v[ids], v[part]), -2)
            full = (ids >= 0).sum(1) > width
            kept = np.sort(ids, 1)[:, ::-1][:, :width].astype(np.int32)
            if full.any():
                kept[full] = self._choose(ids[full], sims[full], width)
            links[part] = kept

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the node than to any chosen before; then the nearest of the rest."""
        take = min(ids.shape[1], BUILD)
        best = np.argsort(-sims, 1, kind="stable")[:, :take]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        real = sims > -2
        v = self.v[np.where(real, ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        chosen, nearest = np.zeros(ids.shape, bool), np.full(ids.shape, -2.0, np.float32)
        for j in range(take):
            now = real[:, j] & (sims[:, j] > nearest[:, j]) & (chosen.sum(1) < most)
            chosen[:, j] = now
            nearest = np.where(now[:, None], np.maximum(nearest, among[:, :, j]), nearest)
        rank = np.argsort(np.where(real, ~chosen, 2), 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def search(self, q: np.ndarray, width: int, older: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids (-1: none) and cosines of the nearest nodes that a beam of the given width finds on the lowest layer."""
        at = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            at = self._beam(q, layer, at, 8)[0]
        return self._beam(q, 0, at, width, older)

    def _beam(self, q: np.ndarray, layer: int, entry: np.ndarray, width: int, older: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        links, v = self.links[layer], self.v
        seen = np.zeros((len(q), len(links)), bool)
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -2.0, np.float32)
        k = min(width, entry.shape[1])
        ids[:, :k] = entry[:, :k]
        if older is not None:
            ids[ids >= older] = -1
        r, c = np.nonzero(ids >= 0)
        sims[r, c] = np.einsum("ij,ij->i", q[r], v[ids[r, c]])
        seen[r, ids[r, c]] = True
        closed = ids < 0
        live = np.arange(len(q))
        while len(live):
            rank = np.argpartition(np.where(closed[live], 3.0, -sims[live]), min(WIDE, width - 1), 1)[:, :WIDE]
            rows = live[:, None]
            going = ~closed[rows, rank]
            some = going.any(1)
            live, rank, going = live[some], rank[some], going[some]
            if not len(live):
                break
            rows = live[:, None]
            near = np.where(going[:, :, None], links[np.maximum(ids[rows, rank], 0)], -1).reshape(len(live), -1)
            closed[rows, rank] = True
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = near >= 0
            fresh[fresh] = ~seen[np.broadcast_to(rows, near.shape)[fresh], near[fresh]]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            more = np.full(near.shape, -2.0, np.float32)
            more[r, c] = np.einsum("ij,ij->i", q[live[r]], v[near[r, c]])
            all_sims = np.concatenate([sims[live], more], 1)
            best = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), best, 1)
            closed[live] = np.take_along_axis(np.concatenate([closed[live], ~fresh], 1), best, 1)
        return ids, sims


def hits(graph: Graph, q: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of cosine `least` or more by single precision; a beam half full of them is widened for its query."""
    out, todo, n = [], np.arange(len(q)), len(graph.v)
    while len(todo):
        again = []
        step = max(8, min(ASK, AT_ONCE // max(n, 64 * width)))
        for lo in range(0, len(todo), step):
            part = todo[lo : lo + step]
            if width >= n:
                r, c = np.nonzero(q[part] @ graph.v.T >= least[part, None])
                out.append((part[r], c))
                continue
            ids, sims = graph.search(q[part], width)
            near = (ids >= 0) & (sims >= least[part, None])
            more = near.sum(1) * 2 > width
            r, c = np.nonzero(near & ~more[:, None])
            out.append((part[r], ids[r, c]))
            again.append(part[more])
        todo, width = np.concatenate(again) if again else todo[:0], width * 4
    return np.concatenate([x[0] for x in out] or [todo]), np.concatenate([x[1] for x in out] or [todo])


def audited(graph: Graph, q: np.ndarray, least: np.ndarray, sample: np.ndarray, width: int = BEAM) -> int:
    """The width of the beam that finds enough of the nodes within `least`: of those of the sampled queries, and of probes
    laid at just that cosine from nodes of the graph, since most queries have none. Truth is a comparison with all nodes."""
    n, low = len(graph.v), least[sample]
    noise = np.random.default_rng(n)
    of = graph.v[noise.integers(0, n, len(sample))]
    aside = noise.standard_normal(of.shape).astype(np.float32)
    aside -= np.einsum("ij,ij->i", aside, of)[:, None] * of
    probes = low[:, None] * of + np.sqrt(1 - low**2)[:, None] * aside / np.maximum(np.linalg.norm(aside, axis=1), 1e-9)[:, None]
    asked, low = np.concatenate([q[sample], probes.astype(np.float32)]), np.concatenate([low, low]) - np.float32(1e-5)
    truth, step = set(), max(8, AT_ONCE // (4 * n))
    for lo in range(0, len(asked), step):
        i, j = np.nonzero(asked[lo : lo + step] @ graph.v.T >= low[lo : lo + step, None])
        truth |= set(zip(i + lo, j))
    while width < n:
        i, j = hits(graph, asked, low, width)
        if len(truth & set(zip(i, j))) >= RECALL * len(truth):
            break
        width *= 2
    return width


# ---------------------------------------------------------------- Spark


def _heights(nodes: np.ndarray) -> np.ndarray:
    u = (mix(nodes.astype(np.uint64) + np.uint64(0x51ED2701)) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(UPPER)).astype(np.int64)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector at length 1 in double precision and its key; null where nothing can be near it."""
    for batch in batches:
        units, keys, dims = [], [], []
        for x in batch.column("embedding").to_pylist():
            v = np.array([np.nan if y is None else y for y in x], np.float64) if x else np.zeros(0)
            top = np.abs(v).max() if len(v) else 0.0
            if not np.isfinite(top) or top == 0:
                units.append(None), keys.append(None), dims.append(None)
                continue
            v = v / top  # neither overflow nor underflow in the square
            v = v / np.sqrt(v @ v)
            planes = np.random.default_rng(len(v)).standard_normal((PLANES, len(v)))
            units.append(v.tobytes()), keys.append(int(np.packbits(planes @ v > 0).view(">u4")[0])), dims.append(len(v))
        yield pa.record_batch([batch.column("node"), batch.column("vec_id"), pa.array(units, pa.binary()), pa.array(keys, pa.int64()), pa.array(dims, pa.int32())], ["node", "vec_id", "unit", "key", "dim"])


@F.pandas_udf(DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a, b)], dtype="float64")


def _vectors(units: pa.ChunkedArray) -> np.ndarray:
    """A row for each vector of one length, without a copy of the column."""
    units = units.combine_chunks()
    _, offsets, data = units.buffers()
    at = np.frombuffer(offsets, np.int32)[units.offset : units.offset + len(units) + 1]
    return np.frombuffer(data, np.float64, (at[-1] - at[0]) // 8, at[0]).reshape(len(units), -1)


def _built(rows: pa.Table) -> pa.Table:
    leader, r = rows["leader"].to_numpy(), rows["r"].to_numpy()
    high = _heights(leader)
    order = np.lexsort((leader, -high))
    v = _vectors(rows["unit"])[order]
    head = rows.select(["dim", "shard"]).slice(0, 1)
    del rows
    g = Graph.build(v.astype(np.float32), high[order])
    blob = io.BytesIO()
    np.savez(blob, v=v, leader=leader[order], r=r[order], **{f"links{k}": x for k, x in enumerate(g.links)})
    whole = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, blob.tell()], np.int32)), pa.py_buffer(blob.getbuffer())])
    return head.append_column("graph", whole)


def _asked(least: float):
    def run(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        """Pairs of leaders that may be linked: `full` if all members are, by the bundles' angles."""
        kind = pa.schema({"a": pa.int64(), "b": pa.int64(), "full": pa.bool_(), "width": pa.int32()})
        if not len(asked) or not len(graphs):
            return kind.empty_table()
        z = np.load(pa.BufferReader(graphs["graph"][0].as_buffer()))
        v, node, r = z["v"], z["leader"], z["r"]
        graph = Graph(v.astype(np.float32), [z[f"links{k}"] for k in range(sum(x.startswith("links") for x in z.files))])
        del graphs
        order = np.argsort(asked["leader"].to_numpy(), kind="stable")
        q, me, mine = _vectors(asked["unit"])[order], asked["leader"].to_numpy()[order], asked["r"].to_numpy()[order]
        del asked
        angle = np.arccos(least)
        low = np.cos(np.minimum(np.pi, angle + mine + r.max())).astype(np.float32) - np.float32(1e-5)
        q32 = q.astype(np.float32)
        sample = np.argsort(mix(me.astype(np.uint64)))[:AUDIT]
        width = audited(graph, q32, low, sample)
        i, j = hits(graph, q32, low, width)
        i, j = i[me[i] != node[j]], j[me[i] != node[j]]
        cos = np.concatenate([np.einsum("ij,ij->i", q[i[lo : lo + 65536]], v[j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)] or [np.zeros(0)])
        slack, between = mine[i] + r[j], np.arccos(np.clip(cos, -1, 1))
        full = np.where(slack == 0, cos >= least, between + slack <= angle - 1e-9)
        maybe = full | (slack > 0) & (between - slack <= angle + 1e-9)
        a, b = me[i][maybe], node[j][maybe]
        return pa.table([np.minimum(a, b), np.maximum(a, b), full[maybe], np.full(len(a), width, np.int32)], schema=kind)

    return run


def near_vectors(rows: DataFrame, least: float = 0.9, label: str = "hnsw", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links are pairs of cosine `least` or more.

    Null or empty vectors, zeros, and those that hold null or a non-finite number link with nothing, nor do vectors of different
    lengths. Rows that share a vec_id are vectors of their own. component_id is the smallest vec_id (nulls aside) that
    links reach; a row without vec_id is kept if that is null too. An empty table gives an empty result.

    Bounds: a shard's graph holds about SHARD_ROWS leaders (some 800 bytes each at 64 numbers), a task asks BLOCK_ROWS
    queries of one graph, AT_ONCE numbers at a time. Members of two bundles are compared one by one only where the leaders' angle leaves it open.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema[vec_id].dataType.simpleString()
    given = rows.select(F.monotonically_increasing_id().alias("node"), F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    d = materialize(given.mapInArrow(_unit, f"node long, vec_id {kind}, unit binary, key long, dim int"), f"{label}-rows")
    valid = d.filter("unit IS NOT NULL")

    keys = valid.groupBy("dim", "key").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n > 1").select("dim", "key", F.col("node").alias("leader"))
    heads = keys.join(valid.select(F.col("node").alias("leader"), F.col("unit").alias("head")), "leader")
    met = valid.join(heads, ["dim", "key"], "left")
    cos = F.when(F.col("leader") == F.col("node"), 1.0).when(F.col("head").isNotNull(), F.col("cos"))
    met = met.withColumn("cos", _cosine(F.coalesce("head", "unit"), "unit")).withColumn("cos", cos)
    inside = F.col("cos") >= TIGHT
    angle = F.when(F.col("leader") == F.col("node"), 0.0).otherwise(F.acos(F.least("cos", F.lit(1.0))) + 1e-7)
    members = materialize(met.select("node", "vec_id", "unit", "dim", F.when(inside, F.col("leader")).otherwise(F.col("node")).alias("leader"), F.when(inside, angle).otherwise(0.0).alias("angle")), f"{label}-members")
    sizes = members.groupBy("leader").agg(F.count("*").alias("size"), F.max("angle").alias("r"), F.min("vec_id").alias("first"))
    leaders = materialize(members.filter("leader = node").select("leader", "unit", "dim").join(sizes, "leader"), f"{label}-leaders")

    n = leaders.count()
    shards, blocks = max(SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // BLOCK_ROWS))
    dealt = leaders.select("leader", "unit", "r", "dim", F.pmod(F.xxhash64("leader"), F.lit(shards)).cast("int").alias("shard"))
    graphs = materialize(dealt.groupBy("dim", "shard").applyInArrow(_built, "dim int, shard int, graph binary"), f"{label}-graphs")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = leaders.select("leader", "unit", "r", "dim", F.pmod(F.xxhash64("leader", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    key, parts = ["dim", "shard", "block"], min(PARTS, shards * blocks)
    graphs = graphs.withColumn("block", every(blocks)).repartition(parts, *key)
    pairs = asked.repartition(parts, *key).groupBy(*key).cogroup(graphs.groupBy(*key)).applyInArrow(_asked(least), "a long, b long, full boolean, width int")
    pairs = materialize(pairs.select("a", "b", "full").distinct(), f"{label}-pairs")

    whole = pairs.filter("full").select("a", "b")
    side = lambda name: members.select(F.col("leader").alias(name), F.col("node").alias(f"{name}_node"), F.col("unit").alias(f"{name}_unit"))
    open_ = pairs.filter("NOT full").join(side("a"), "a").join(side("b"), "b").filter(_cosine("a_unit", "b_unit") >= least)
    open_ = materialize(open_.select("a", "b", "a_node", "b_node"), f"{label}-verified")
    single = open_.select(F.col("a_node").alias("node")).union(open_.select("b_node")).groupBy("node").agg(F.count("*").alias("singles"))
    edges = whole.union(open_.select("a", "b").distinct())
    both = whole.union(whole.select("b", "a"))
    wide = both.join(sizes.select(F.col("leader").alias("b"), "size"), "b").groupBy(F.col("a").alias("leader")).agg(F.sum("size").alias("linked"))
    found = connected_components(edges, f"{label}-components")
    placed = leaders.select("leader", "size", "first").join(wide, "leader", "left").join(found.withColumnRenamed("node", "leader"), "leader", "left").withColumn("component", F.coalesce("component", "leader"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(lowest, "component").select("leader", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "component_id")
    out = members.select("node", "vec_id", "leader").join(placed, "leader").join(single, "node", "left").select("vec_id", (F.col("links") + F.coalesce("singles", F.lit(0))).cast("long").alias("n_links"), "component_id")
    alone = d.filter("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
