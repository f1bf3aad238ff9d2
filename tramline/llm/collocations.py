"""Phrase collocations by marginalising the longest word windows.

Every word occurrence gives one window: the word and the words after it in its piece, as lead columns, padded
to the longest phrase. Windows are all that is counted. Spark's ROLLUP then sums over ever shorter prefixes:
the count of a phrase is the sum of the windows that begin with it, and the sum of all windows is the number
of words. No table of shorter n-grams is made.

A window is also padded from where its phrase cannot reach the least count. Sketches of saturating
counters, summed over the whole corpus, tell this: they never undercount, so no phrase of the least count
is lost, and a collision only keeps a window that could have been shorter. The first counts words and pairs; the
second counts longer windows, and only those whose pairs all may be frequent. Their size grows with the corpus, up to a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm._common import LOWER, chunks, materialize, mix, small_batches, utf8, word_hashes, word_spans

_U = np.uint64
LONGEST = 4
#: Counters of a sketch at least and at most (a bit each in what all tasks get: 8 to 64 MB a sketch), and those of a block.
SLOTS, MOST, BLOCK = 1 << 26, 1 << 29, 1 << 16
#: Bytes of text for each counter, and counted slots that a task holds before it sends them on.
TEXT, HELD = 20, 1 << 22
#: Bytes of text whose equal windows are counted together before they leave a task.
BUFFER = 4 << 20
#: Phrases of one language are ranked first inside so many parts of them.
PARTS = 64

PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEPARATOR = PIECE_END.copy()
SEPARATOR[[0x20, 0x09]] = True

_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Words:
    """All words of one chunk of texts: where they are, how many of their piece follow, and hashes of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, first = word_spans(self.data, offsets, SEPARATOR)
        n = len(self.starts)
        self.lang = np.repeat(langs, np.diff(first))
        piece = np.cumsum(PIECE_END[self.data])[self.starts] if n else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        joined = np.zeros(n, bool)
        if n:
            joined[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        self.have = _follow(joined)
        self.h = word_hashes(self.data, self.starts, self.ends)
        self.grams = [mix(self.h + lang_hash[self.lang])]
        for k in range(1, LONGEST):
            longer = self.grams[-1].copy()
            if n > k:
                longer[:-k] = mix(longer[:-k] * _STEP[k] + self.h[k:])
            self.grams.append(longer)

    def of(self, k: int) -> np.ndarray:
        """Hashes of the windows of k words that lie in a piece."""
        return self.grams[k - 1][self.have >= k]


def _follow(joined: np.ndarray) -> np.ndarray:
    """Words that the piece has from each word on, LONGEST at most. joined: whether the next word is of the same piece."""
    have, run = np.ones(len(joined), np.int64), joined.copy()
    for _ in range(LONGEST - 1):
        have += run
        run = joined & np.append(run[1:], False)
    return have


def _lang_hash(names: list[str]) -> np.ndarray:
    """A hash of each language's name that is the same in all tasks."""
    data, offsets = utf8(pa.array(names, pa.string()))
    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(offsets[:-1], offsets[1:])], _U)


def _read(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[Words, list[str]]]:
    coded = batch.column("lang").dictionary_encode()
    names, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    hashes = _lang_hash(names)
    for lo, hi, data, offsets in chunks(*utf8(batch.column("text")), limit=limit):
        yield Words(data, offsets, langs[lo:hi], hashes), names


def _slots(grams: np.ndarray, slots: int) -> np.ndarray:
    return (grams & _U(slots - 1)).astype(np.uint32)


def _lit(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether the counter of each hash reached the least count."""
    slot = _slots(grams, len(bits) * 8)
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def _later(x: np.ndarray, k: int) -> np.ndarray:
    """x of the window k words on; false beyond the last."""
    return np.append(x[k:], np.zeros(min(k, len(x)), bool))


def _pairs(words: Words, short: np.ndarray) -> np.ndarray:
    """Whether the window of two words from each word on may reach the least count."""
    return (words.have >= 2) & _lit(short, words.grams[1])


def _packed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counted slots (slot * 256 + count, 255 at most) summed and cut into blocks: gaps between slots, then counts, byte by byte."""
    key = np.sort(np.concatenate(found))
    slot = key >> _U(8)
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    n = np.minimum(255, np.add.reduceat((key & _U(255)).astype(np.int64), first)).astype(np.uint8)
    block, low = (slot[first] // _U(BLOCK)).astype(np.int32), (slot[first] % _U(BLOCK)).astype(np.int64)
    edges = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)]
    pack = zstandard.ZstdCompressor(level=1)
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        gaps = np.diff(low[lo:hi], prepend=0).astype("<u2").view(np.uint8)
        rows.append((int(block[lo]), pack.compress(gaps[0::2].tobytes() + gaps[1::2].tobytes() + n[lo:hi].tobytes())))
    for lo in range(0, len(rows), 256):
        yield pa.record_batch([pa.array([r[0] for r in rows[lo : lo + 256]], pa.int32()), pa.array([r[1] for r in rows[lo : lo + 256]], pa.binary())], ["block", "counters"])


def _sketch(slots: int, short):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counters of the windows of one and two words; with the bits of those, of the longer windows whose pairs all may be frequent."""
        bits = np.frombuffer(short.value, np.uint8) if short is not None else None
        found, held = [], 0
        for batch in batches:
            for words, _ in _read(batch, BUFFER):
                if bits is None:
                    grams = [words.of(1), words.of(2)]
                else:
                    two = _pairs(words, bits)
                    three = two & _later(two, 1)
                    grams = [words.grams[2][three & (words.have >= 3)], words.grams[3][three & _later(two, 2) & (words.have >= 4)]]
                slot, n = np.unique(_slots(np.concatenate(grams), slots), return_counts=True)
                if len(slot):
                    found.append((slot.astype(_U) << _U(8)) | np.minimum(n, 255).astype(_U))
                    held += len(slot)
                if held > HELD:
                    yield from _packed(found)
                    found, held = [], 0
        if found:
            yield from _packed(found)

    return run


def _frequent_bits(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the blocks of a partition as they come in; a bit for each counter of at least `least`."""
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(unpack.decompress(raw), np.uint8)
                n = len(raw) // 3
                at = np.cumsum(raw[:n].astype(np.int64) + (raw[n : 2 * n].astype(np.int64) << 8))
                sums = total.setdefault(block, np.zeros(BLOCK, np.uint8))
                sums[at] = np.minimum(255, sums[at].astype(np.uint16) + raw[2 * n :])
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.packbits(t >= min(least, 255), bitorder="little").tobytes() for t in total.values()], pa.binary())], ["block", "bits"])

    return run


def _frequent(slim: DataFrame, least: int, slots: int, label: str, short=None):
    """The bits of one sketch of `slots` counters, sent to all tasks."""
    sketch = slim.mapInArrow(_sketch(slots, short), "block int, counters binary").repartition("block")
    found = materialize(sketch.mapInArrow(_frequent_bits(least), "block int, bits binary"), label)
    bits = np.zeros(slots // 8, np.uint8)
    for row in found.toLocalIterator():  # slots / BLOCK rows of BLOCK / 8 bytes at most
        bits[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
    return slim.sparkSession.sparkContext.broadcast(bits.tobytes())


def _take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given spans of bytes as a string column."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes()))


def _windows(short, long):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct padded windows of each buffer and how often they occur in it."""
        few, many = np.frombuffer(short.value, np.uint8), np.frombuffer(long.value, np.uint8)
        for batch in batches:
            for words, names in _read(batch, BUFFER):
                n = len(words.h)
                if not n:
                    continue
                one, two = _lit(few, words.grams[0]), _pairs(words, few)
                three = two & _later(two, 1) & (words.have >= 3)
                three[three] = _lit(many, words.grams[2][three])
                four = three & _later(three, 1) & (words.have >= 4)
                four[four] = _lit(many, words.grams[3][four])
                lead = np.zeros(n, np.int64)
                for going in (one, one & two, one & three, one & four):
                    lead += going
                key = np.where(lead > 0, np.stack(words.grams)[np.maximum(lead, 1) - 1, np.arange(n)], words.lang.astype(_U))
                _, at, count = np.unique(mix(key + lead.astype(_U) * _STEP[0]), return_index=True, return_counts=True)
                columns = [pa.DictionaryArray.from_arrays(pa.array(words.lang[at].astype(np.int32)), pa.array(names, pa.string())).dictionary_decode()]
                for k in range(LONGEST):
                    there, word = lead[at] > k, np.minimum(at + k, n - 1)
                    columns.append(_take(words.data, words.starts[word], np.where(there, words.ends[word], words.starts[word])))
                yield pa.record_batch([*columns, pa.array(count.astype(np.int64))], ["lang", *(f"w{k}" for k in range(1, LONGEST + 1)), "n"])

    return run


def count_phrases(docs: DataFrame, least: int, label: str = "collocations", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words (array), f: the count of every phrase of 1 to 4 words with f >= least, and for each language a row
    without words whose f is the number of all its words.

    Words are what is left of lower-cased (A-Z) pieces between blanks; pieces end at .,;:!? and line ends. Null
    and empty texts have no words; a null language is `und`. Windows are told apart by hashes of 64 bits inside a buffer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = SLOTS
    while slots < MOST and slots * TEXT < size:
        slots *= 2
    short = _frequent(slim, least, slots, f"{label}-sketch")
    long = _frequent(slim, least, slots, f"{label}-sketch", short)
    leads = [f"w{k}" for k in range(1, LONGEST + 1)]
    windows = slim.mapInArrow(_windows(short, long), "lang string, " + ", ".join(f"{w} string" for w in leads) + ", n long")
    windows = windows.groupBy("lang", *leads).agg(F.sum("n").alias("n"))
    sums = windows.rollup("lang", *leads).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    kept = F.lit(False)
    for k in range(1, LONGEST + 1):  # k words are left where the others are rolled up; a padded place is no word
        kept |= (F.col("rolled") == 2 ** (LONGEST - k) - 1) & (F.col(f"w{k}") != "") & (F.col("f") >= least)
    kept |= F.col("rolled") == 2**LONGEST - 1
    return materialize(sums.filter(kept).select("lang", F.array_compact(F.array(*leads)).alias("words"), "f"), f"{label}-counts")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, part_of: tuple[int, int] = (80, 100), label: str = "collocations", text: str = "text", lang: str = "lang") -> DataFrame:
    """The best phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's count, at least `least`. Each cut into a first part (count l) and the rest (r) scores
    floor(scale * a / (l + r)); the lowest cut counts, the smallest of ties. A phrase whose words lie in a longer one
    that occurs at least part_of as often is dropped. n: all words of the language. Ranked by score, count and
    phrase (bytes); `top` of each language come back. No text, no row: an empty table gives an empty result.
    """
    f = count_phrases(docs, least, label, text, lang)
    counts = f.filter(F.size("words") > 0).withColumn("phrase", F.array_join("words", " "))
    cands = counts.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = cands.select("lang", "phrase", "a", cut.alias("k"), "words")
    first, rest = F.slice("words", 1, F.col("k")), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.array_join(first, " ").alias("part")), F.struct(F.lit(False).alias("left"), F.array_join(rest, " ").alias("part")))).alias("p"))
    met = parts.select("lang", "phrase", "a", "k", "p.left", "p.part").join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = met.groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("k") == k) & (F.col("left") == side), F.col("f"))).alias(f"{name}{k}") for k in range(1, LONGEST) for name, side in (("l", True), ("r", False))))
    scored = F.array_compact(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"CAST({scale} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l{k} AS DECIMAL(19, 0)) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST))))
    best = sides.select("lang", "phrase", "a", F.array_min(scored).alias("cut"))

    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inside = cands.filter(size > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    num, den = part_of
    left = best.join(inside, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR CAST({den} AS DECIMAL(18, 0)) * longer < CAST({num} AS DECIMAL(18, 0)) * a"))
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    some = rows.withColumn("near", F.row_number().over(part)).filter(F.col("near") <= top).drop("near")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    words = f.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
