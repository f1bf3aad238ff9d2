"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Training counts, for every context of up to ORDER bytes, which byte follows; a text ends with the symbol
0xFF, which UTF-8 never uses, and begins after ORDER of them. Scoring takes the deepest context the trie
holds. A symbol seen there has its count over count and kinds (method C); else the context's escape is
paid and the next shorter context answers, without the symbols that the longer one has excluded. All
probabilities of a context are worked out once, so scoring a text is a walk along the trie.

Tasks hold a hot part of the trie, its contexts with all their symbols. Symbols after other contexts are
answered from the tables of all counts, by joins over the distinct grams that the texts have of them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm._common import LOWER, chunks, held_out, materialize, small_batches, utf8, word_hashes, word_spans

ORDER = 4
END = 0xFF
#: Size of the part of the trie that goes to all tasks: (context, symbol) pairs and contexts of each order.
#: What follows rarer contexts is joined with the counts of all of them.
MAX_PAIRS, MAX_CONTEXTS = 1 << 19, 1 << 16
#: Rows of a join side that is sent to all tasks rather than shuffled.
BROADCAST_ROWS = 1 << 19
#: Words whose counts go to all tasks; rarer words are joined with their counts by shuffle.
MAX_WORDS = 1 << 18

_I = np.int64


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a chunk with ORDER end symbols before and one after each; and the first place of each."""
    n = len(offsets) - 1
    out = np.full(len(data) + (ORDER + 1) * n, END, np.uint8)
    shift = np.repeat(np.arange(n) * (ORDER + 1) + ORDER, np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, offsets[:-1] + np.arange(n) * (ORDER + 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One code for each symbol of the texts: ORDER bytes of context, then the symbol in the lowest byte."""
    s, first = stream(data, offsets)
    wide = s.astype(_I)
    code = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code |= wide[ORDER - k : len(wide) - k] << (8 * k)
    return code[inside(first, len(code))]


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the n places of a stream hold a symbol of a text, its end included."""
    keep = np.ones(n, bool)
    for k in range(ORDER):  # places before a text's first symbol, as seen from the end of the one before
        at = first[1:] - ORDER + k
        keep[at] = False
    return keep


class _Tally:
    """Counts of 64-bit codes, merged now and then; gives batches of at most `limit` codes when full or at the end."""

    def __init__(self, kind: int, limit: int = 1_500_000):
        self.kind, self.limit, self.codes, self.counts, self.held = kind, limit, [], [], 0

    def add(self, codes: np.ndarray) -> None:
        u, n = np.unique(codes, return_counts=True)
        self.codes.append(u)
        self.counts.append(n)
        self.held += len(u)
        if self.held > self.limit:
            self._merge()

    def _merge(self) -> None:
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.codes, self.counts = [codes[at]], [np.add.reduceat(counts, at)]
        self.held = len(at)

    def flush(self, only_full: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.held or only_full and self.held <= self.limit // 2:
            return
        self._merge()
        codes, counts = self.codes[0], self.counts[0]
        for i in range(0, len(codes), 100_000):
            c = codes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), self.kind, np.int32)), pa.array(c), pa.array(counts[i : i + 100_000])], names=["kind", "code", "n"])
        self.codes, self.counts, self.held = [], [], 0


def _words(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[part]
    starts, ends, first = word_spans(low, off)
    return word_hashes(low, starts, ends).view(_I), first


def count(docs: DataFrame) -> DataFrame:
    """(kind, code, n) of all rows of docs (text): kind 0 words, 1 grams, 2 the number of texts (code 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbols, texts = _Tally(0), _Tally(1), 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            texts += len(offsets) - 1
            for _, _, part, off in chunks(data, offsets):
                words.add(_words(part, off)[0])
                symbols.add(grams(part, off))
                yield from words.flush(only_full=True)
                yield from symbols.flush(only_full=True)
        yield from words.flush()
        yield from symbols.flush()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "code", "n"])

    return docs.select("text").mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has been counted and is short; df must be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _least(df: DataFrame, n: str, most: int, size: str = "1") -> int:
    """The smallest power of two such that the rows of df with a count n of that or more have at most `most` in sizes."""
    steps = sorted(df.groupBy(F.floor(F.log2(n) + 1e-12).cast("int").alias("k")).agg(F.sum(F.expr(size))).collect(), reverse=True)
    total, least = 0, 1 << (steps[0][0] + 1 if steps else 0)
    for k, c in steps:
        total += c
        if total > most:
            break
        least = 1 << k
    return least


class Trie:
    """Probabilities of all contexts. pairs: for each order from 0 the (codes, counts) kept of it, with every
    pair's shorter twin among those of the order below."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]):
        seen = np.unique(pairs[0][0] & 0xFF) if len(pairs[0][0]) else np.zeros(0, _I)
        self.width = width = len(seen) + 1  # the last column stands for every symbol never seen
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        tables, self.next = [], []
        above: np.ndarray | None = None
        for order, (codes, counts) in enumerate(pairs):
            contexts, row = np.unique(codes >> 8, return_inverse=True)
            if not order and not len(contexts):
                contexts = np.zeros(1, _I)
            here = np.zeros((len(contexts), width), np.float64)
            here[row, self.symbol[codes & 0xFF]] = counts
            if order:
                mask = (1 << (8 * (order - 1))) - 1
                parent = np.searchsorted(parents, contexts & mask)
                oldest = self.symbol[contexts >> (8 * (order - 1))]
                step = np.full((len(parents) + 1, width), len(contexts), np.int32)
                step[parent, oldest] = np.arange(len(contexts))
                step[:, width - 1] = len(contexts)
                self.next.append(step)
                rest = np.empty_like(here)
                for lo in range(0, len(contexts), 4096):  # what follows an escape, a slice of contexts at a time
                    p = parent[lo : lo + 4096]
                    c = np.where(here[lo : lo + 4096] > 0, 0.0, counts_above[p])
                    t, q = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                    rest[lo : lo + 4096] = np.where(c > 0, c / np.maximum(t + q, 1), np.where(q > 0, q / np.maximum(t + q, 1), 1.0) * above[p])
            else:
                rest = np.full_like(here, 1.0 / max(1, 256 - len(seen)))
            t, q = here.sum(1, keepdims=True), (here > 0).sum(1, keepdims=True)
            p = np.where(here > 0, here / np.maximum(t + q, 1), np.where(t > 0, q / np.maximum(t + q, 1), 1.0) * rest)
            tables.append(np.log10(p).astype(np.float32))
            above, counts_above, parents = rest, here, contexts
        self.sizes = [len(t) for t in tables]
        self.log = np.concatenate(tables)

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of a chunk's stream the log10 probability, and whether the trie holds the whole context
        before it; and the first place of each text."""
        s, first = stream(data, offsets)
        sym = self.symbol[s]
        n = len(sym) - ORDER
        node = np.zeros(n, np.int32)
        alive = np.zeros(n, np.int32)
        base = 0
        for depth in range(1, len(self.sizes)):
            alive = self.next[depth - 1].ravel()[alive * np.int32(self.width) + sym[ORDER - depth : len(sym) - depth]]
            base += self.sizes[depth - 1]
            held = alive < self.sizes[depth]
            node = np.where(held, alive + np.int32(base), node)
        return self.log.ravel()[node.astype(_I) * self.width + sym[ORDER:]].astype(np.float64), held, first

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a chunk, its end included."""
        value, _, first = self.walk(data, offsets)
        return _totals(value, first)


def _totals(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the places of each text."""
    run = np.concatenate([[0.0], np.cumsum(value)])
    return run[np.append(first[1:] - ORDER, len(value))] - run[first]


def _context(code: str, order: int) -> Column:
    """The `order` bytes before the symbol of a code."""
    return F.shiftright(code, 8).bitwiseAND((1 << (8 * order)) - 1)


def _contexts(tables: list[DataFrame], label: str) -> list[DataFrame]:
    """For each order (context, t, q): how many symbols follow a context, and of how many kinds."""
    return [materialize(t.groupBy(_context("code", k).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("q")), f"{label}-contexts{k}") for k, t in enumerate(tables)]


def chances(codes: DataFrame, tables: list[DataFrame], contexts: list[DataFrame], label: str) -> DataFrame:
    """(code, value): log10 probability of each of the codes (distinct) by the counts of all contexts.

    A context's symbols are all known to the next shorter one. So what is left there after an escape are its own
    totals less what these symbols have in it; the longer context's table gets that sum as `e`."""
    out = codes
    for k in range(ORDER, -1, -1):
        here = contexts[k]
        if k:
            below = tables[k - 1].select(F.col("code").alias("short"), F.col("n").alias("m"))
            pairs = tables[k].select(_context("code", k).alias("context"), F.col("code").bitwiseAND((1 << (8 * k)) - 1).alias("short"))
            here = here.join(pairs.join(_small(below), "short").groupBy("context").agg(F.sum("m").alias("e")), "context")
        else:
            here = here.withColumn("e", F.lit(0).cast("long"))
        here = materialize(here.select(F.col("context").alias(f"c{k}"), F.col("t").alias(f"t{k}"), F.col("q").alias(f"q{k}"), F.col("e").alias(f"e{k}")), f"{label}-left{k}")
        pair = tables[k].select(F.col("code").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
        out = out.withColumns({f"s{k}": F.col("code").bitwiseAND((1 << (8 * (k + 1))) - 1), f"c{k}": _context("code", k)})
        out = out.join(_small(pair), f"s{k}", "left").join(_small(here), f"c{k}", "left")
    value = F.lit(-math.log10(max(1, 256 - tables[0].count())))
    for k in range(ORDER + 1):
        t, q = F.col(f"t{k}"), F.col(f"q{k}")
        if k < ORDER:
            t, q = t - F.coalesce(f"e{k + 1}", F.lit(0)), q - F.coalesce(f"q{k + 1}", F.lit(0))
        escape = F.when(q > 0, F.log10(q / (t + q))).otherwise(F.lit(0.0))
        value = F.when(F.col(f"n{k}").isNotNull(), F.log10(F.col(f"n{k}") / (t + q))).otherwise(escape + value)
    return out.select("code", value.alias("value"))


def train(docs: DataFrame, label: str = "ppm") -> tuple[DataFrame, list[DataFrame], list[DataFrame], dict]:
    """Count the rows of docs (text): the table of word counts (code, n), those of the pairs and contexts of each
    order, and the hot part of bounded size; whole: whether it is all there is."""
    counts = materialize(count(docs), f"{label}-counts")
    words = counts.filter("kind = 0").select("code", "n")
    texts = counts.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    kinds, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = words.filter(F.col("n") >= _least(words, "n", MAX_WORDS)).toArrow()
    codes = hot["code"].to_numpy()
    order = np.argsort(codes)
    tables = [counts.filter("kind = 1").select("code", "n")]
    for k in range(ORDER - 1, -1, -1):
        table = tables[0].groupBy(F.col("code").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("code")).agg(F.sum("n").alias("n"))
        tables.insert(0, materialize(table, f"{label}-pairs{k}"))
    contexts = _contexts(tables, label)
    pairs, least, whole = [], 1, True
    for k, table in enumerate(tables):
        if k > 1:
            least = max(least, _least(contexts[k], "t", MAX_PAIRS, "q"), _least(contexts[k], "t", MAX_CONTEXTS))
            rare = contexts[k].filter(F.col("t") < least).limit(1).count()
            whole = whole and not rare
            if rare:
                hotter = contexts[k].filter(F.col("t") >= least).select("context")
                table = table.withColumn("context", _context("code", k)).join(F.broadcast(hotter), "context", "left_semi").select("code", "n")
        kept = table.toArrow()
        pairs.append((kept["code"].to_numpy().astype(_I), kept["n"].to_numpy().astype(np.float64)))
    return words, tables, contexts, {"name": uuid.uuid4().hex, "whole": whole, "pairs": pairs, "words": codes[order], "counts": hot["n"].to_numpy()[order], "texts": texts, "total": total + texts, "kinds": kinds + 1}


_TRIES: dict[str, Trie] = {}  # the one of the model last used, by the model's name


class _Rare:
    """Distinct codes of each text that are left to a join, with how often the text has them."""

    def __init__(self):
        self.codes, self.repeats, self.lengths = [], [], []

    def add(self, text: np.ndarray, code: np.ndarray, texts: int) -> None:
        order = np.lexsort((code, text))
        text, code = text[order], code[order]
        start = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (code[1:] != code[:-1])])[: len(code)])
        self.codes.append(code[start])
        self.repeats.append(np.diff(np.append(start, len(code))))
        self.lengths.append(np.bincount(text[start], minlength=texts))

    def lists(self) -> list[pa.Array]:
        at = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([*self.lengths, np.zeros(0, _I)]))]).astype(np.int32))
        codes, repeats = np.concatenate([*self.codes, np.zeros(0, _I)]), np.concatenate([*self.repeats, np.zeros(0, _I)]).astype(np.int32)
        return [pa.ListArray.from_arrays(at, pa.array(codes)), pa.ListArray.from_arrays(at, pa.array(repeats))]


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, label: str = "ppm") -> DataFrame:
    """Train on the rows of docs (doc_id, text) outside the fold, and score all rows.

    Returns doc_id, held_out, n_tokens (lower-cased words and one end), n_known (tokens seen in training),
    train_tokens, base_score (smoothed counts of single tokens), score (PPM) in log10 units, and n_symbols
    (bytes and one end), by which a code length can be compared.

    Null and empty texts are an end alone. Bytes never seen in training share what the last escape leaves.
    Repeated rows are scored alike; an empty table gives an empty result. Words are told apart by a 64-bit hash."""
    spark = docs.sparkSession
    small_batches(spark)
    out = held_out("doc_id", folds, fold)
    words, tables, contexts, model = train(docs.filter(~out).select("text"), label)
    shared = spark.sparkContext.broadcast(model)
    scale = model["total"] + 0.5 * (model["kinds"] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m["name"] not in _TRIES:
            _TRIES.clear()
            _TRIES[m["name"]] = Trie(m["pairs"])
        trie = _TRIES[m["name"]]
        known, logs = m["words"], np.log10((m["counts"] + 0.5) / scale)
        end = np.log10((m["texts"] + 0.5) / scale)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = len(offsets) - 1
            tokens, hits, base, score = np.zeros(n, _I), np.zeros(n, _I), np.zeros(n), np.zeros(n)
            rare, far = _Rare(), _Rare()
            for lo, hi, part, off in chunks(data, offsets):
                value, held, begin = trie.walk(part, off)
                if m["whole"]:
                    far.add(np.zeros(0, _I), np.zeros(0, _I), hi - lo)
                else:
                    cold = ~held[inside(begin, len(held))]
                    far.add(np.repeat(np.arange(hi - lo), np.diff(off) + 1)[cold], grams(part, off)[cold], hi - lo)
                    value[~held] = 0.0
                score[lo:hi] = _totals(value, begin)
                h, first = _words(part, off)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                found = known[at] == h if len(known) else np.zeros(len(h), bool)
                run_hits = np.concatenate([[0], np.cumsum(found)])
                run_base = np.concatenate([[0.0], np.cumsum(np.where(found, logs[at], 0.0) if len(known) else np.zeros(len(h)))])
                tokens[lo:hi] = np.diff(first) + 1
                hits[lo:hi] = run_hits[first[1:]] - run_hits[first[:-1]] + (m["texts"] > 0)
                base[lo:hi] = run_base[first[1:]] - run_base[first[:-1]] + end
                unknown = np.flatnonzero(~found)
                rare.add(np.searchsorted(first, unknown, "right") - 1, h[unknown], hi - lo)
            columns = [batch.column(0), pa.array(tokens), pa.array(hits), pa.array(base), pa.array(score), pa.array(np.diff(offsets) + 1), *rare.lists(), *far.lists()]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "n_known", "base", "score", "n_symbols", "codes", "repeats", "grams", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    ids = numbered.select(F.struct("row", "doc_id").alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = materialize(ids.mapInArrow(run, f"row struct<row: bigint, doc_id: {kind}>, n_tokens long, n_known long, base double, score double, n_symbols long, codes array<long>, repeats array<int>, grams array<long>, times array<int>"), f"{label}-scored")
    table = table.select("row.row", "row.doc_id", "n_tokens", "n_known", "base", "score", "n_symbols", "codes", "repeats", "grams", "times")
    rare = table.select("row", F.explode(F.arrays_zip("codes", "repeats")).alias("w")).select("row", F.col("w.codes").alias("code"), F.col("w.repeats").cast("long").alias("k"))
    seen = rare.join(words, "code", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(scale)))).alias("rest"))
    done = table.drop("codes", "repeats", "grams", "times").join(seen, "row", "left").withColumn("far", F.lit(0.0))
    if not model["whole"]:
        far = table.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("code"), F.col("g.times").alias("k"))
        codes = materialize(table.select(F.explode("grams").alias("code")).distinct(), f"{label}-far")
        known = materialize(chances(codes, tables, contexts, label), f"{label}-chances")
        sums = far.join(_small(known), "code").groupBy("row").agg(F.sum(F.col("k") * F.col("value")).alias("far"))
        done = done.drop("far").join(sums, "row", "left")
    return done.select("doc_id", out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(model["total"])).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"), "n_symbols")
