"""License scans by ordered signature rules.

A rule is a regular expression over lower-cased bytes with a keyword, a priority, a confidence and a label.
Keywords are looked for first, in runs of whole texts at once; only texts that hold a rule's keyword meet
its expression. Detections are taken by priority, then length; one that lies inside a taken one is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tramline.llm._common import chunks, small_batches, utf8, word_spans
from tramline.llm.license_wording import CLAUSES, SURE, WEAK

#: What separates words: everything below 0x80 that is neither a letter nor a digit.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_WORD = rb"[0-9a-z\x80-\xff]"

# Phrases whose every place counts, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, names as they are written, and known versions of common licenses.
FAMILIES = [
    ("agpl", ["gnu affero general public license", "affero general public license", "agpl"], ["3", "3.0"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "lgpl"], ["2", "2.1", "3", "3.0"]),
    ("gpl", ["gnu general public license", "gnu gpl", "general public license", "gpl"], ["1", "2", "2.0", "3", "3.0"]),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1.1", "1.2", "1.3"]),
    ("apache", ["apache software license", "apache license", "apache public license"], ["1.0", "1.1", "2", "2.0"]),
    ("mit", ["mit license", "expat license", "x11 license", "the mit licence"], []),
    ("bsd", ["bsd license", "bsd 2 clause license", "bsd 3 clause license", "new bsd license", "simplified bsd license", "modified bsd license"], []),
    ("isc", ["isc license", "internet systems consortium license"], []),
    ("mpl", ["mozilla public license", "mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license", "epl"], ["1.0", "2.0"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1.0", "1.1"]),
    ("cpl", ["common public license"], ["1.0"]),
    ("eupl", ["european union public licence", "european union public license", "eupl"], ["1.1", "1.2"]),
    ("artistic", ["artistic license", "perl artistic license"], ["1.0", "2.0"]),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("boost", ["boost software license"], ["1.0"]),
    ("unlicense", ["the unlicense", "unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["2"]),
    ("cc0", ["creative commons zero", "cc0"], ["1.0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"], ["2.0", "3.0", "4.0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"], ["2.0", "3.0", "4.0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], ["2.0", "3.0", "4.0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"], ["2.0", "3.0", "4.0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["2.0", "3.0", "4.0"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("odbl", ["open database license", "odbl"], ["1.0"]),
    ("ofl", ["sil open font license", "open font license"], ["1.1"]),
    ("postgresql", ["postgresql license"], []),
    ("python", ["python software foundation license", "psf license"], ["2"]),
    ("ruby", ["ruby license"], []),
    ("php", ["php license"], ["3.0", "3.01"]),
    ("openssl", ["openssl license"], []),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa license"], []),
    ("sspl", ["server side public license", "sspl"], ["1"]),
    ("bsl", ["business source license"], ["1.1"]),
    ("elastic", ["elastic license"], ["2.0"]),
    ("mspl", ["microsoft public license", "ms pl"], []),
    ("proprietary", ["proprietary license", "commercial license"], []),
]

# How a grant is worded before a license's name, and how sure each form is.
GRANTS = [
    ("licensed under", 95), ("licenced under", 95), ("released under", 92), ("distributed under", 92), ("available under", 90),
    ("published under", 90), ("provided under", 90), ("covered by", 80), ("subject to", 75), ("governed by", 75), ("under the terms of", 90),
]

@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: bytes
    priority: int
    confidence: int
    base: bool = False


def _words(phrase: str) -> list[str]:
    return re.findall(r"\([^)]*\)|[^\s.()]+", phrase)


def _phrase(words: str) -> bytes:
    """Expression of a phrase. (a|b) is one of several words or runs of words; a word with ? may be left out."""
    out, sep = b"", _SEP + b"+"
    for w in _words(words):
        if w[0] == "(":
            one = b"(?:" + b"|".join(_phrase(x) for x in w[1:-1].split("|")) + b")"
            out += (sep if out else b"") + one
        elif w[-1] == "?":
            out += b"(?:" + sep + re.escape(w[:-1].encode()) + b")?"
        else:
            out += (sep if out else b"") + re.escape(w.encode())
    return out


def _edges(body: bytes) -> bytes:
    return b"(?<!" + _WORD + b")" + body + b"(?!" + _WORD + b")"


def _keyword(words: str) -> bytes:
    """The longest word that a phrase always has: what its rules wait for."""
    return max((w for w in _words(words) if w[0] != "(" and w[-1] != "?"), key=len).encode()


def build_rules() -> list[Rule]:
    """All rules, by falling priority: license wording, identifiers, grants, names with a version, names, base phrases."""
    rules = [Rule(label, _keyword(text), _edges(_phrase(text)), 100, WEAK.get(label, SURE)) for label, texts in CLAUSES.items() for text in texts]
    seen: set[tuple[str, bytes]] = set()
    sep = _SEP + b"+"
    grants = b"(?:" + b"|".join(_phrase(g) for g, _ in sorted(GRANTS, key=lambda g: -len(g[0]))) + b")"
    for label, names, versions in FAMILIES:
        ident = label if label not in ("proprietary", "bsl") else label + "-license"
        rules.append(Rule(label, b"spdx", _edges(_phrase("spdx license identifier") + sep + _phrase(ident.replace("-", " "))), 95, 99))
        for name in names:
            body, key = _phrase(name), _keyword(name)
            rules.append(Rule(label, key, _edges(grants + sep + b"(?:(?:the|a|an)" + sep + b")?" + body), 90, 95))
            rules.append(Rule(label, key, _edges(body + sep + b"(?:version" + sep + b"|v)?[0-9]+(?:[.][0-9]+)*"), 80, 90))
            for version in versions:
                rules.append(Rule(f"{label}-{version}", key, _edges(body + sep + b"(?:version" + sep + b"|v)?" + re.escape(version.encode()) + rb"(?![.][0-9])"), 85, 95))
            rules.append(Rule(label, key, _edges(body), 60 + len(name.split()), 80))
    rules += [Rule(label, _keyword(text), _edges(_phrase(text)), 10, 80, base=True) for text, label in BASE_PHRASES.items()]
    rules = [r for r in rules if (r.label + str(r.base), r.pattern) not in seen and not seen.add((r.label + str(r.base), r.pattern))]
    return sorted(rules, key=lambda r: -r.priority)


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """found: (priority, start, end, rule). Take by priority, then length, then place; drop what lies inside a taken one."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []  # of taken intervals of which none lies in another: both lists rise
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        _, s, e, _ = d
        i = bisect_right(starts, s)
        if i and ends[i - 1] >= e:
            continue
        kept.append(d)
        lo, hi = bisect_left(starts, s), bisect_right(ends, e)
        if hi > lo:
            del starts[lo:hi], ends[lo:hi]
        insort(starts, s)
        insort(ends, e)
    return kept


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        self.by_key = defaultdict(list)
        for i, r in enumerate(rules):
            self.by_key[r.keyword].append(i)

    def keywords(self, low: bytes, offsets: np.ndarray) -> dict[int, set[bytes]]:
        """Text -> keywords that it holds, from one search of the whole run for each keyword."""
        held: dict[int, set[bytes]] = defaultdict(set)
        for key in self.by_key:
            at = low.find(key)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(key) <= offsets[i + 1]:
                    held[i].add(key)
                    at = low.find(key, int(offsets[i + 1]))
                else:
                    at = low.find(key, at + 1)
        return held

    def scan(self, text: bytes, keys: set[bytes]) -> list[tuple[int, int, int, int]]:
        """All detections (priority, start, end, rule) of the rules whose keyword the text holds."""
        found = []
        for key in keys:
            for i in self.by_key[key]:
                p = self.compiled.get(i) or self.compiled.setdefault(i, re.compile(self.rules[i].pattern))
                found += [(self.rules[i].priority, m.start(), m.end(), i) for m in p.finditer(text)]
        return found


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Detections of each whole text of docs (doc_id, text).

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and largest
    word index where one starts; null without any), base_labels, labels (base and detected ones; both sorted,
    comma-joined, '' for none), score (chance that the text holds a license notice: the complement of the
    product of the kept detections' doubts, one detection a label; 0 for none) and detections: the kept
    spans (label, first_byte, end_byte of the UTF-8 text, priority).

    Base phrases count wherever their words follow each other, also inside a longer detection. Null and
    empty texts have no words. Repeated rows give repeated results; an empty table an empty one."""
    small_batches(docs.sparkSession)
    rules = rules or build_rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, off in chunks(data, offsets):
                starts, _, first = word_spans(part, off, SEPARATOR)
                low = part.tobytes().lower()
                held = scanner.keywords(low, off)
                for i in range(hi - lo):
                    found = scanner.scan(low[off[i] : off[i + 1]], held[i]) if i in held else []
                    base = [d for d in found if rules[d[3]].base]
                    at = np.searchsorted(starts, [off[i] + d[1] for d in base]) - first[i]
                    kept = suppress(found)
                    base_labels = {rules[d[3]].label for d in base}
                    sure: dict[str, int] = {}
                    for d in kept:
                        r = rules[d[3]]
                        sure[r.label] = max(sure.get(r.label, 0), r.confidence)
                    doubt = 1.0
                    for label in sorted(sure):
                        doubt *= 1 - sure[label] / 100
                    out["n_words"].append(int(first[i + 1] - first[i]))
                    out["n_base"].append(len(base))
                    out["first_word"].append(int(at.min()) if base else None)
                    out["last_word"].append(int(at.max()) if base else None)
                    out["base_labels"].append(",".join(sorted(base_labels)))
                    out["labels"].append(",".join(sorted(base_labels | set(sure))))
                    out["score"].append(1 - doubt if sure else 0.0)
                    out["detections"].append([{"label": rules[k].label, "first_byte": s, "end_byte": e, "priority": p} for p, s, e, k in sorted(kept, key=lambda d: d[1:])])
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": pa.list_(pa.struct([("label", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("priority", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])

    span = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("priority", T.IntegerType())]))
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("detections", span)]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in fields)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
