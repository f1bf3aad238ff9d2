"""N-gram Jaccard join by PartEnum signatures.

Each text becomes the set of its hashed word shingles. Sets of the same band of sizes that are similar
enough differ in a bounded number of elements. The domain of features is cut into groups of n2 partitions;
the differences leave at least one group with one difference at most, so at least one of its subsets of
n2 - 1 partitions agrees exactly. Every set therefore emits these subsets of its groups as signatures, and
similar sets share one. A set whose size lies near the end of its band also emits signatures of the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm._common import LOWER, chunks, materialize, mix, small_batches, utf8, word_hashes, word_spans
from tramline.llm.components import connected_components

_U = np.uint64
_SUBSETS = ((0, 1), (0, 2), (1, 2))
#: A list of ids below this many is sent to all tasks as a filter (8 bytes each); a longer one is joined by shuffle.
BROADCAST_IDS = 2_000_000


class Bands:
    """Size bands for a threshold num/den, and how many groups the sets of a band are cut into and emit."""

    def __init__(self, num: int, den: int, n2: int = 3):
        self.num, self.den, self.n2 = num, den, n2
        self.ratio = (den / num) ** 2
        self.last = [0]
        self._groups: dict[int, int] = {}

    def of(self, n: int) -> int:
        while self.last[-1] < n:
            low = self.last[-1] + 1
            self.last.append(max(low, int(low * self.ratio)))
        return int(np.searchsorted(self.last, n))

    def levels(self, n: int) -> list[int]:
        """Bands whose signatures a set of n elements emits: its own, and the next if a partner can lie there."""
        b = self.of(n)
        return [b, b + 1] if n * self.den // self.num > self.last[b] else [b]

    def differences(self, band: int, n: int) -> int:
        """Elements in which a set of n elements and a linked one, at this band, may differ."""
        while len(self.last) <= band:
            self.of(self.last[-1] + 1)
        return (n + min(self.last[band], n * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    def need(self, band: int, n: int) -> int:
        """Groups of which one has a single difference at most, since two differences spoil one group."""
        return self.differences(band, n) // 2 + 1

    def filled(self, band: int) -> float:
        """About the share of groups all of whose signatures are of some feature, in the smallest sets of a band."""
        low = (self.last[band - 1] + 1) * self.num / self.den
        gone = math.exp(-low / (self.n2 * self.need(band, self.last[band])))
        return max(0.05, (1 - gone) ** 2 if self.n2 == 2 else (1 - gone) ** 3 + 3 * gone * (1 - gone) ** 2)

    def emitted(self, band: int, need: int) -> int:
        """Groups whose signatures are emitted: so many that, but for chance, `need` of them are filled."""
        p = self.filled(band)
        return math.ceil(need / p + 3 * math.sqrt(need * (1 - p)) / p) + 1

    def groups(self, band: int) -> int:
        """Groups that the sets of a band are cut into: as many as its largest set emits."""
        self.differences(band, 1)
        if band not in self._groups:
            self._groups[band] = self.emitted(band, self.need(band, self.last[band]))
        return self._groups[band]


@lru_cache(maxsize=512)
def _bounds(parts: int) -> np.ndarray:
    return (np.array([-(-(p << 32) // parts) for p in range(1, parts)], _U)) << _U(32)


@lru_cache(maxsize=512)
def _salts(level: int, groups: int) -> np.ndarray:
    g = np.arange(groups * 3, dtype=_U).reshape(groups, 3)
    return mix(g * _U(0xA24BAED4963EE407) + _U((level + 1) * 0x9FB21C651E98DF25 % 2**64))


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of one sorted array of distinct shingle hashes. Where only equal sets can link, there are none."""
    out = []
    n, n2 = len(s), bands.n2
    run = np.zeros(n + 1, _U)
    np.cumsum(mix(s + _U(0x632BE59BD9B4E019)), out=run[1:])
    for level in bands.levels(n):
        if not bands.differences(level, n):
            continue
        groups, need = bands.groups(level), bands.need(level, n)
        own = bands.emitted(level, need)
        at = np.zeros(n2 * groups + 1, np.int64)
        at[1:-1] = np.searchsorted(s, _bounds(n2 * groups))
        at[-1] = n
        part = (run[at[1:]] - run[at[:-1]]).reshape(groups, n2)[:own]
        full = np.diff(at).reshape(groups, n2)[:own] > 0
        salts = _salts(level, groups)[:own]
        if n2 == 2:
            sig, some = mix(part * _U(0xC2B2AE3D27D4EB4F) + salts[:, :2]), full
        else:
            sig, some = np.empty((own, 3), _U), np.empty((own, 3), bool)
            for j, (x, y) in enumerate(_SUBSETS):
                sig[:, j] = part[:, x] * _U(0xC2B2AE3D27D4EB4F) + part[:, y] * _U(0x165667B19E3779F9)
                some[:, j] = full[:, x] | full[:, y]
            sig = mix(sig + salts)
        # Empty subsets agree by chance. They are needed only if, for a partner of some size, too few of the
        # groups that both emit have all subsets filled. It is enough that one of two partners has enough.
        least = bands.need(level, -(-n * bands.num // bands.den))
        wants = np.arange(min(least, need), need + 1)
        filled = np.cumsum(some.all(1))
        enough = (filled[np.array([bands.emitted(level, int(w)) for w in wants]) - 1] >= wants).all()
        out.append(sig[some] if enough else sig.ravel())
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_sets(column: pa.Array, q: int) -> Iterator[np.ndarray]:
    """For each text, in order: sorted distinct hashes of its word q-grams; a shorter text is one gram; no words, none."""
    odd = [_U(2 * (i + 1) * 0x1D8E4E27C47D124F % 2**64 | 1) for i in range(q)]
    data, offsets = utf8(column)
    for lo, hi, part, off in chunks(data, offsets):
        low = LOWER[part]
        starts, ends, first = word_spans(low, off)
        words = word_hashes(low, starts, ends)
        n = max(0, len(words) - q + 1)
        grams = np.zeros(n, _U)
        for i in range(q):
            grams += words[i : i + n] * odd[i]
        grams = mix(grams)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= q:
                yield np.unique(grams[a : b - q + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    h = _U(b - a)
                    for j in range(a, b):
                        h = h * _U(0xFF51AFD7ED558CCD) + words[j]
                yield mix(np.array([h], _U))
            else:
                yield np.zeros(0, _U)


def _key(s: np.ndarray) -> int:
    """Id of a set: equal sets, equal ids."""
    return int(mix(np.add.reduce(mix(s ^ _U(0x8CB92BA72F3D8DD7)), keepdims=True) + _U(len(s)))[0].view(np.int64)) if len(s) else 0


#: Parities that tell sets apart before they are compared: bits, in words of 64.
PARITY_WORDS = 16


#: The same for sets of many features, whose parities would fill the shorter sketch.
WIDE_WORDS, WIDE_FROM = 256, 1000


def _parity(s: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """For each of the cells that features fall into, whether it holds an odd number of them. Every feature
    that only one of two sets has flips one bit, so at least as many features differ as bits do."""
    odd = np.bincount((s >> _U(58 - words.bit_length() + 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd).view(_U)


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*values, np.zeros(0, _U)]).view(np.int64)))


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(T.LongType())) for n in names]


def sketch(docs: DataFrame, q: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, parity, wide): the sketches only at the first row of each set in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            n, keys, odd, wide = [], [], [], []
            for s in shingle_sets(batch.column(1), q):
                n.append(len(s))
                keys.append(k := _key(s))
                fresh = len(s) and k not in seen
                if fresh:
                    seen.add(k)
                odd.append(_parity(s) if fresh else s[:0])
                wide.append(_parity(s, WIDE_WORDS) if fresh and len(s) >= WIDE_FROM else s[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), _lists(odd), _lists(wide)], names=["doc_id", "n_shingles", "set_id", "parity", "wide"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()), *_longs("parity", "wide")])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def signed(docs: DataFrame, q: int, num: int, den: int, n2: int) -> DataFrame:
    """(signature, set_id) of the first row of each set in a task. Signatures go straight into the shuffle: they are many,
    and made again they cost less than kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den, n2), set()
        keys, sigs, held = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sigs, np.zeros(0, _U)]).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), [len(v) for v in sigs]))], names=["signature", "set_id"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), q):
                if len(s) and (k := _key(s)) not in seen:
                    seen.add(k)
                    keys.append(k)
                    sigs.append(signatures(s, bands))
                    held += len(sigs[-1])
                if held > 200_000:
                    yield full()
                    keys, sigs, held = [], [], 0
        yield full()

    return docs.select("text").mapInArrow(run, "signature long, set_id long")


def _sets(docs: DataFrame, wanted: DataFrame, q: int) -> DataFrame:
    """(set_id, features) of the wanted sets, once for each task that meets one. wanted: (doc_id, set_id)."""
    n = wanted.count()
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = {}
            for s in shingle_sets(batch.column(1), q):
                if (k := _key(s)) not in seen:
                    fresh[k] = s
            seen |= fresh.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), _lists(list(fresh.values()))], names=["set_id", "features"])

    return some.mapInArrow(run, "set_id long, features array<long>")


def _close(na: str, nb: str, wa: str, wb: str, num: int, den: int) -> Column:
    """Whether two sets may link, from their sizes and parities: no more parities differ than features may."""
    apart = sum((F.bit_count(F.get(wa, F.lit(i)).bitwiseXOR(F.get(wb, F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (apart * (den + num) <= (F.col(na) + F.col(nb)) * (den - num))


def _likely(pairs: DataFrame, owners: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by size and parities."""
    x = owners.select(F.col("set_id").alias("a"), F.col("size").alias("na"), F.col("parity").alias("wa"), F.col("wide").alias("va"))
    y = owners.select(F.col("set_id").alias("b"), F.col("size").alias("nb"), F.col("parity").alias("wb"), F.col("wide").alias("vb"))
    near = pairs.join(x.drop("va"), "a").join(y.drop("vb"), "b").filter(_close("na", "nb", "wa", "wb", num, den)).select("a", "b", "na", "nb")
    both = near.filter(F.least("na", "nb") >= WIDE_FROM).join(x.select("a", "va"), "a").join(y.select("b", "vb"), "b")
    apart = F.aggregate(F.zip_with("va", "vb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    both = both.filter(apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    return near.filter(F.least("na", "nb") < WIDE_FROM).select("a", "b").union(both.select("a", "b"))


def _linked(docs: DataFrame, pairs: DataFrame, owners: DataFrame, q: int, num: int, den: int, label: str) -> DataFrame:
    """The pairs (a, b; distinct) whose sets reach the threshold exactly. Only the sets they name are made again."""
    named = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    wanted = materialize(named.join(owners, "set_id").select("doc_id", "set_id"), f"{label}-wanted")
    sets = materialize(_sets(docs, wanted, q).join(F.broadcast(wanted.select("set_id")) if wanted.count() <= BROADCAST_IDS else wanted.select("set_id"), "set_id", "left_semi"), f"{label}-sets")
    left = sets.select(F.col("set_id").alias("a"), F.col("features").alias("fa"))
    right = sets.select(F.col("set_id").alias("b"), F.col("features").alias("fb"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("fa", "fb")).cast("long")
    both = F.size("fa") + F.size("fb")
    return joined.withColumn("common", common).filter(den * F.col("common") >= num * (both - F.col("common"))).select("a", "b").distinct()


#: A block of sets of one component: about so many sets, and so many features, are compared in one step.
BLOCK_SETS, BLOCK_FEATURES = 512, 1 << 18


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of common features of each set of left with each of right, by products of incidence matrices.

    Only features that both sides have are columns, `width` of them at a time: memory is bounded by the sets and width."""
    sizes = [len(v) for v in left + right]
    _, column = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    mine = row < len(left)
    both = np.bincount(column[mine], minlength=column.max() + 1).astype(bool) & np.bincount(column[~mine], minlength=column.max() + 1).astype(bool)
    rank = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(both.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sizes), min(width, int(both.sum()) - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += (part[: len(left)] @ part[len(left) :].T).astype(np.int64)
    return out


def _block_links(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """For the one or two blocks of a step: (set_id, links), each link counted as often as the other text occurs."""
    def run(blocks: pa.Table) -> pa.Table:
        sides = []
        for block in range(blocks.num_rows):
            ids, copies, features = (blocks.column(c)[block].values for c in ("ids", "copies", "features"))
            # A set that several tasks have made is there more than once.
            ids, first = np.unique(ids.to_numpy(), return_index=True)
            sides.append((ids, copies.to_numpy()[first], [features[int(i)].values.to_numpy().view(_U) for i in first]))
        (ia, ca, fa), (ib, cb, fb) = sides[0], sides[-1]
        na, nb = np.array([len(v) for v in fa], np.int64), np.array([len(v) for v in fb], np.int64)
        common = _common(fa, fb)
        linked = den * common >= num * (na[:, None] + nb[None, :] - common)
        if len(sides) == 1:
            np.fill_diagonal(linked, False)
            return pa.table({"set_id": ia, "links": linked @ ca})
        return pa.table({"set_id": np.concatenate([ia, ib]), "links": np.concatenate([linked @ cb, linked.T @ ca])})

    return run


def set_links(docs: DataFrame, owners: DataFrame, parts: DataFrame, q: int, num: int, den: int, label: str = "jaccard") -> DataFrame:
    """(set_id, links): rows of docs with another set that links directly with this one; sets without a link may be left out.

    owners: (set_id, doc_id, size, copies), once for each set. parts: (node, component) of sets in components of two or
    more. All links lie inside a component. Its sets are dealt to bands of sizes, of which only neighbours can link, and
    bands by hash to blocks of about BLOCK_SETS sets and BLOCK_FEATURES features; each block meets the others of its own
    and the next band in a step of its own, so a group of any size is spread over tasks, and no pair leaves a step. The
    steps of a component grow with the square of its blocks: exact counts of links compare all of its pairs."""
    # A little wider than the ratio of sizes, so that rounding cannot put two linked sets two bands apart.
    band = F.floor(F.log(F.col("size").cast("double")) / (math.log(den / num) * 1.0001)) if num < den else F.col("size")
    placed = owners.join(parts, F.col("set_id") == F.col("node")).select("set_id", "doc_id", "copies", "size", F.col("component").alias("part"), band.cast("long").alias("band"))
    placed = materialize(placed, f"{label}-placed")
    cuts = placed.groupBy("part", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_FEATURES)).cast("int").alias("blocks"))
    near = cuts.select("part", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")).unionByName(cuts.select("part", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), allowMissingColumns=True)
    near = near.groupBy("part", "band").agg(F.coalesce(F.max("above"), F.lit(0)).alias("above"), F.coalesce(F.max("below"), F.lit(0)).alias("below"))
    cuts = materialize(cuts.join(near, ["part", "band"], "left").na.fill(0, ["above", "below"]), f"{label}-cuts")
    dealt = placed.join(cuts, ["part", "band"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    wanted = materialize(dealt.drop("size"), f"{label}-dealt")
    named = wanted.drop("doc_id")
    sets = _sets(docs, wanted.select("doc_id", "set_id"), q).join(F.broadcast(named) if wanted.count() * 6 <= BROADCAST_IDS else named, "set_id")
    packed = sets.groupBy("part", "band", "block", "blocks", "above", "below").agg(F.collect_list(F.struct("set_id", "copies", "features")).alias("rows"))
    packed = packed.select("part", "band", "block", "blocks", "above", "below", F.col("rows.set_id").alias("ids"), F.col("rows.copies").alias("copies"), F.col("rows.features").alias("features"))
    packed = materialize(packed, f"{label}-packed")
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("band").alias("b1"), F.least("block", b).alias("k1"), F.col("band").alias("b2"), F.greatest("block", b).alias("k2")))
    up = F.transform(F.when(F.col("above") > 0, F.sequence(F.lit(0), F.col("above") - 1)).otherwise(F.array()), lambda b: F.struct(F.col("band").alias("b1"), F.col("block").alias("k1"), (F.col("band") + 1).alias("b2"), b.alias("k2")))
    down = F.transform(F.when(F.col("below") > 0, F.sequence(F.lit(0), F.col("below") - 1)).otherwise(F.array()), lambda b: F.struct((F.col("band") - 1).alias("b1"), b.alias("k1"), F.col("band").alias("b2"), F.col("block").alias("k2")))
    steps = packed.select("part", "ids", "copies", "features", F.explode(F.concat(own, up, down)).alias("step"))
    steps = steps.filter((F.size("ids") > 1) | (F.col("step.b1") != F.col("step.b2")) | (F.col("step.k1") != F.col("step.k2")))
    found = steps.groupBy("part", "step").applyInArrow(_block_links(num, den), "set_id long, links long")
    return materialize(found.filter("links > 0").groupBy("set_id").agg(F.sum("links").alias("links")), f"{label}-links")


def jaccard_components(docs: DataFrame, q: int = 5, num: int = 8, den: int = 10, n2: int = 3, label: str = "jaccard", links: bool = False) -> DataFrame:
    """Link texts whose sets of word q-grams have Jaccard similarity of num/den or more, and name components.

    docs: doc_id (an integer), text; other columns are ignored. n2: partitions of a group, 2 or 3; with 3 there
    are more signatures, each of more features. Returns one row for each row of docs: doc_id, n_shingles, set_id
    (0 for texts without words), component_id: the smallest doc_id reachable by links, itself included; with `links`
    also n_links: the other rows whose texts link directly with this one's, rows that repeat it included (see set_links).

    Texts without words, empty and null ones link with nothing and keep their own doc_id. Rows that
    repeat a text share a component. Rows of one doc_id with different texts are texts of their own.
    A null doc_id takes part; it is the component_id only where all ids of a component are null.

    First each set is compared with one set of every signature it carries, the one that meets the most
    others; the links found join most of a group of near copies without listing its pairs. Then only pairs
    of sets that share a signature and still lie in different components are compared. Before features are
    compared, sizes and parities must leave room for a link. No link that could join two components is
    left out.
    """
    small_batches(docs.sparkSession)
    table = materialize(sketch(docs, q), f"{label}-sketch")
    owners = table.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.count("*").alias("copies"), F.max("parity").alias("parity"), F.max("wide").alias("wide"))
    owners = materialize(owners, f"{label}-owners")
    rows = signed(docs, q, num, den, n2)
    same = Window.partitionBy("signature")
    shared = rows.withColumns({"lo": F.min("set_id").over(same), "hi": F.max("set_id").over(same), "others": F.count("*").over(same) - 1}).filter("lo <> hi").drop("lo", "hi")
    shared = materialize(shared, f"{label}-shared")
    met = shared.groupBy("set_id").agg(F.sum("others").alias("met"))
    central = shared.join(met, "set_id").withColumn("hub", F.max(F.struct("met", "set_id")).over(same)["set_id"])
    near = central.filter("hub <> set_id").select(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b")).distinct()
    near = materialize(_likely(near, owners, num, den), f"{label}-near")
    edges = materialize(_linked(docs, near, owners, q, num, den, label), f"{label}-edges")
    parts = connected_components(edges, f"{label}-cc")

    left = shared.select("signature", "set_id").distinct().join(parts, F.col("set_id") == F.col("node"), "left").select("signature", "set_id", F.coalesce("component", "set_id").alias("part"))
    open_ = left.withColumns({"lo": F.min("part").over(same), "hi": F.max("part").over(same)}).filter("lo <> hi").drop("lo", "hi")
    open_ = open_.join(owners.select("set_id", "size", "parity"), "set_id")
    open_ = materialize(open_, f"{label}-open")
    x = open_.select("signature", F.col("set_id").alias("a"), F.col("part").alias("pa"), F.col("size").alias("na"), F.col("parity").alias("wa"))
    y = open_.select("signature", F.col("set_id").alias("b"), F.col("part").alias("pb"), F.col("size").alias("nb"), F.col("parity").alias("wb"))
    fits = (F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & _close("na", "nb", "wa", "wb", num, den)
    more = x.join(y, "signature").filter(fits).select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    more = materialize(_likely(more, owners, num, den), f"{label}-more")
    if more.limit(1).count():
        found = materialize(_linked(docs, more, owners, q, num, den, label), f"{label}-found")
        parts = connected_components(edges.union(found), f"{label}-cc")

    named = owners.join(parts, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "set_id").alias("part"), "doc_id")
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "part").select(F.col("set_id").alias("_set"), "component_id")
    out = table.select("doc_id", "n_shingles", "set_id").join(names, F.col("set_id") == F.col("_set"), "left")
    out = out.select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    if not links:
        return out
    counted = set_links(docs, owners.select("set_id", "doc_id", "size", "copies"), parts, q, num, den, label)
    counted = owners.join(counted, "set_id", "left").select("set_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return out.join(counted, "set_id", "left").select("doc_id", "n_shingles", "set_id", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
