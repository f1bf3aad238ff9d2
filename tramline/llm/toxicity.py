"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to letters, drops invisible characters and
turns everything else that is no letter into one space. Terms are whole words or word beginnings. Each has
a weight; phrases of the exception list cover the terms inside them. The summed weight, normalised by
length, goes through a calibration curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm._common import held_out, small_batches

# Terms that are insults wherever they stand, with their weights before anything is learned.
PRIOR = {
    "idiot": 5.0, "idiots": 5.0, "moron": 5.0, "morons": 5.0, "scum": 5.0, "trash": 3.0, "loser": 4.0, "losers": 4.0, "pathetic": 4.0,
    "worthless": 4.0, "disgusting": 3.0, "stupid": 4.0, "clown": 3.0, "dumb": 3.0, "imbecile": 5.0, "vermin": 4.0, "filth": 4.0,
    "garbage": 2.5, "retard": 6.0, "bastard": 5.0, "bitch": 5.0, "asshole": 6.0, "fuck": 5.0, "shit": 4.0, "cunt": 6.0, "subhuman": 6.0,
    "degenerate": 3.0, "lowlife": 4.0, "parasite": 2.5, "coward": 2.5,
}

# Harmless phrases around terms.
EXCEPTIONS = [
    "trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "garbage collection", "garbage collector", "garbage truck",
    "garbage can", "clown fish", "circus clown", "sore loser", "loser bracket", "host and parasite", "parasite host", "shit happens",
]

# Letters of other scripts, and digits and signs, that are written for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_INVISIBLE = "​‌‍⁠﻿­"

_ASCII = bytes(ord(DIGITS.get(chr(b).lower(), chr(b).lower())) if b < 128 and (chr(b).isalpha() or chr(b) in DIGITS) else b if b >= 128 else 32 for b in range(256))
_WIDE = str.maketrans({**HOMOGLYPHS, **{k.upper(): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}, **{chr(0xFF21 + i): chr(97 + i) for i in range(26)}, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **dict.fromkeys(map(ord, _INVISIBLE))})
#: Lead bytes of scripts with homoglyphs or invisible characters; other texts skip the slower mapping.
_LEADS = re.compile(rb"[\xc2\xcd-\xd4\xe2\xef]|\xc4\xb1|\xc9\xa1")
_SPACES = re.compile(r"[\s -⁯　-〿¡«·»¿]+")

#: Learned terms: shortest and longest word beginning, least documents, least likelihood ratio, least purity.
STEM, LONGEST, LEAST, RATIO, PURE = 4, 8, 4, 22.0, 0.9


def fold(text: str) -> str:
    """The folded text, with one space before and after every word."""
    raw = text.encode("utf-8", "surrogatepass")
    if _LEADS.search(raw):
        raw = text.translate(_WIDE).encode("utf-8", "surrogatepass")
    return f" {_SPACES.sub(' ', raw.translate(_ASCII).decode('utf-8', 'replace').lower()).strip()} "


@dataclass
class Model:
    """terms: ' word ' or ' stem' -> weight; curve: intercept, slope of weight per length, slope of weight."""

    terms: dict[str, float] = field(default_factory=lambda: {f" {w} ": v for w, v in PRIOR.items()})
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.5)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, None))
        a.make_automaton()
        return a


def matches(text: str, automaton) -> tuple[float, int, int]:
    """(summed weight of term matches outside exception phrases, their number, number of words) of a text.

    A term counts in full the first time and less each further time, so that repetition alone adds little."""
    folded = fold(text)
    hits, covered = [], []
    for end, (n, weight, term) in automaton.iter(folded):
        (covered if term is None else hits).append((end - n + 1, end, weight, term))
    if covered and hits:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _, _ in covered)]
    at: dict[int, tuple[float, str]] = {}
    for start, _, weight, term in hits:  # of several terms that begin one word the heaviest counts
        if start not in at or weight > at[start][0]:
            at[start] = (weight, term)
    total, seen = 0.0, Counter()
    for weight, term in at.values():
        seen[term] += 1
        total += weight / seen[term]
    return total, len(at), folded.count(" ") - 1


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Inputs of the curve: 1, weight by the square root of length in tens of words, damped weight."""
    return np.stack([np.ones_like(total), np.log1p(total / np.sqrt(np.maximum(words, 10) / 10)), np.log1p(total)], 1)


def _probability(total: np.ndarray, words: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(total, words) @ np.array(curve), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, toxic) of at most about `bound` labelled training rows, chosen by a hash of the id and, where one id has many
    texts, by a hash of both. Rows that repeat an id and a text count once."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out("doc_id", 5, 0))
    n = known.count()
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (1 << 40) * bound // n)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark")).join(F.broadcast(known), "doc_id")
    every, n = rows.agg(F.count("*"), F.count_distinct("mark")).first()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("mark"), F.lit(1 << 40)) < (1 << 40) * bound // n)
    if every > n:
        rows = rows.dropDuplicates(["mark"])
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[1 if toxic else 0].update(set(fold(text).split()))
        words = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "bad", "good"])


def _learn_terms(sample: DataFrame, n_bad: int, n_good: int, size: int) -> dict[str, float]:
    """Terms whose documents are toxic far more often than chance, at most `size` of them by likelihood ratio."""
    if not n_bad or not n_good:
        return {}
    words = sample.mapInArrow(_count_words, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = F.char_length("word")
    lengths = F.when(n >= STEM, F.sequence(F.lit(STEM), F.least(n, F.lit(LONGEST)))).otherwise(F.array())
    terms = words.withColumn("term", F.explode(F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.transform(lengths, lambda k: F.concat(F.lit(" "), F.substring("word", 1, k))))))
    terms = terms.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= LEAST)
    share = n_bad / (n_bad + n_good)
    every = F.col("bad") + F.col("good")
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (every * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (every * (1 - share)))).otherwise(0.0))
    balanced = (F.col("bad") / n_bad) / (F.col("bad") / n_bad + F.col("good") / n_good)
    rows = terms.withColumns({"ratio": ratio, "pure": balanced}).filter((F.col("ratio") >= RATIO) & (F.col("pure") >= PURE)).orderBy(F.desc("ratio"), "term").limit(size).collect()
    weight = {r["term"]: math.log((r["bad"] + 0.5) / (n_bad + 1)) - math.log((r["good"] + 0.5) / (n_good + 1)) for r in rows}
    kept: dict[str, float] = {}
    for term in sorted(weight, key=lambda t: (len(t.strip()), t)):  # a longer term that a shorter one covers adds nothing
        if not any(term[:k] in kept for k in range(STEM + 1, len(term))):
            kept[term] = weight[term]
    return kept


def _fit_curve(x: np.ndarray, y: np.ndarray, start: tuple[float, float, float]) -> tuple[float, float, float]:
    """Logistic regression with a light pull towards the start values, by Newton's method."""
    b0 = np.array(start)
    b = b0.copy()
    pull = np.eye(3) * 0.05
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ (b - b0))
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, lexicon: int = 5_000) -> Model:
    """Learn terms, weights and the curve from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    bound: rows of the training sample, about; lexicon: learned terms, at most. Only the texts and the
    column toxic are used. Without labels of both kinds the prior terms and curve stay as they are."""
    small_batches(docs.sparkSession)
    model = Model()
    sample = _sample(docs, labels, bound)
    totals = {r["toxic"]: r["count"] for r in sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).groupBy("toxic").count().collect()}
    learned = _learn_terms(sample, totals.get(1, 0), totals.get(0, 0), lexicon)
    if not learned:
        return model
    model.terms = {**model.terms, **learned}
    scored = sample.mapInArrow(_totals(model, "toxic"), "total double, n_words long, toxic int").collect()
    x = _inputs(np.array([r["total"] for r in scored]), np.array([r["n_words"] for r in scored], float))
    model.curve = _fit_curve(x, np.array([r["toxic"] > 0 for r in scored], float), model.curve)
    return model


def _totals(model: Model, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = [matches(t, automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), batch.column(1)], names=["total", "n_words", keep])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1), n_terms (term matches) and predicted (1 from a score of 0.5) to each row of docs.

    docs: text and any further columns, which are kept. The score depends on the text alone. Null and empty
    texts match nothing and get the curve's value for no matches. Repeated rows get equal scores."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = [matches(t or "", automaton) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            p = _probability(np.array([f[0] for f in found]), np.array([f[2] for f in found], float), model.curve)
            extra = [pa.array(p, pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "score", "n_terms", "predicted"])

    added = [("score", T.DoubleType()), ("n_terms", T.LongType()), ("predicted", T.IntegerType())]
    base = docs.drop(*(n for n, _ in added))
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in added)]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of docs, then score all rows: doc_id, held_out, score, predicted, n_terms."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_terms")
