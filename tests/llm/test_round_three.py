"""Collocations, conversation repair and near vectors against brute force, and on null, empty, long, tied and absent rows."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

# ---------------------------------------------------------------- collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, least, top):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    longer = collections.Counter()
    for (lang, w), a in f.items():
        if a >= least:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least or 100 * longer[lang, w] >= 80 * a:
            continue
        s, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-s, -a, " ".join(w).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def collocation_rows():
    r = random.Random(5)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 3))) for _ in range(14)] + ["ÜBER", "A"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", "\t", ", ", ".", "\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", "und", None])) for _ in range(150)]
    return [*rows, *[("New York is here. new york", "en")] * 40, *[("one two three four five", "xx")] * 35, (None, "en"), ("", None), ("  \n", "en"), ("one two " * 30_000, "en"), ("lonely", "fr")]


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations_equal_counting_all_phrases(spark, top):
    from tramline.llm.collocations import collocations

    rows = collocation_rows()
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n long, words string").repartition(3)
    assert {tuple(x) for x in collocations(docs, least=30, top=top).collect()} == brute_collocations(rows, 30, top)


def test_collocations_pad_where_the_sketch_is_crowded(spark, monkeypatch):
    """With few counters nearly all windows collide; counts stay exact. (Tasks fork from a worker, so the sizes travel by closure of a helper.)"""
    from tramline.llm import collocations as c

    rows = collocation_rows()
    r = c.Words(np.frombuffer("ab cd. ef gh ij kl mn".encode(), np.uint8), np.array([0, 21]), np.array([0]), c._lang_hash(["en"]))
    assert r.have.tolist() == [2, 1, 4, 4, 3, 2, 1]
    docs = spark.createDataFrame(rows, "text string, lang string")
    exact = {(x["lang"], tuple(x["words"])): x["f"] for x in c.count_phrases(docs, 1).collect()}
    few = {(x["lang"], tuple(x["words"])): x["f"] for x in c.count_phrases(docs, 30).collect()}
    assert few == {k: v for k, v in exact.items() if v >= 30 or not k[1]}


def test_collocations_of_nothing(spark):
    from tramline.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


# ---------------------------------------------------------------- mixing


def test_mixing_keeps_rows_of_a_null_domain(spark):
    from tramline.llm.mixing import mix

    docs = spark.createDataFrame([(i, "a b c d e f g h i j", "en", "s1", None if i % 2 else "web") for i in range(10)], "doc_id long, text string, lang string, source string, kind string")
    out = mix(docs, budget=(5, 10), max_epochs=1, weights={"domain": {"web": 3}}, domain=F.col("kind")).collect()
    assert sorted((x.doc_id, x.domain) for x in out) == [(i, "" if i % 2 else "web") for i in range(10)]
    assert sum(x.taken_tokens for x in out) == 49 and sum(x.taken_tokens for x in out if x.domain == "web") == 37  # 37.5 to 12.5, and no halves


# ---------------------------------------------------------------- conversations


def brute_repair(rows):
    """rows: (role, text, fault) in order -> (cost, audit, lines), by shortest paths over (row, state) with the audit as tie-breaker."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        to, name = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{name}:{text}")))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept, (*lines, f"{role}:{text}")))


def brute_conversations(rows):
    out, by = [], collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv]
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            by[conv] += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    for conv, all_rows in by.items():
        all_rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in all_rows:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, lines = brute_repair([(r, t, f) for (_, r, t), f in zip(all_rows, faults)])
        turns = {t for t, _, _ in all_rows if t is not None}
        initials = [r[:1] for _, r, _ in all_rows]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows():
    r = random.Random(11)
    texts = ["Yes.", "No!", "Why", "", "  \n", "Well?  ", None, "Go on.\t", "é."]
    rows = [(c, t if r.random() < 0.9 else r.choice([None, t + 3, 1]), r.choice(["user", "assistant", "system", "tool", "u", "", None, "Assistant"]), r.choice(texts)) for c in range(220) for t in range(r.randint(0, 9))]
    return [*rows, *[(None, t, "user", "A null conversation.") for t in range(4)], *[(900, 1, "user", "The same row.")] * 30, *[(901, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(3000)], (902, 0, "user", "x" * 100_000 + ".")]


def test_repair_equals_shortest_paths(spark):
    from tramline.llm.conversations import damaged, repair_conversations

    rows = conversation_rows()
    df = spark.createDataFrame([(*x, 5, 1.5) for x in rows], "conv_id long, turn long, role string, text string, cost long, pos double").repartition(7)
    found = sorted((tuple(x) for x in repair_conversations(damaged(df)).collect()), key=repr)
    assert found == brute_conversations(rows)


def test_repair_of_strings():
    from tramline.llm.conversations import FAULTS, INITIALS, LETTERS, repair

    r = random.Random(2)
    for n in [*range(9), *range(9), 40, 300]:
        rows = [(r.choice("suax"), "t", r.choice(FAULTS)) for _ in range(n)]
        cost, edits = repair("".join(LETTERS[INITIALS.index(i) * 4 + FAULTS.index(f)] for i, _, f in rows))
        want = brute_repair(rows)
        assert (cost, re.sub("[ua]", "", "".join(edits))) == want[:2] and len(edits) == n


def test_repair_of_nothing(spark):
    from tramline.llm.conversations import damaged, repair_conversations

    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(damaged(none)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = repair_conversations(damaged(spark.createDataFrame([(7, gone, "user", "Hi.")], none.schema))).collect()
    assert [tuple(x) for x in one] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# ---------------------------------------------------------------- near vectors


def vector_rows():
    g = np.random.default_rng(4)
    base = g.standard_normal((160, 24))
    rows = [[float(x) for x in v] for v in base]
    rows += [[float(x) for x in base[i % 8] + g.standard_normal(24) * 0.02] for i in range(60)]  # tight groups
    rows += [[float(x) for x in base[20 + i % 5] + g.standard_normal(24) * 0.38] for i in range(60)]  # near the threshold
    rows += [[float(x) for x in base[9] * (i + 1)] for i in range(25)]  # the same direction
    rows += [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1e300] * 24, [1e-300] * 24, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(rows))]
    ids[3], ids[170], ids[5] = None, 4, 4
    return list(zip(ids, rows))


def brute_vectors(rows, least):
    unit = []
    for _, x in rows:
        ok = bool(x) and all(y is not None and np.isfinite(y) for y in x) and any(x)
        v = np.array(x, float) / np.abs(x).max() if ok else None
        unit.append(v / np.sqrt(v @ v) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


def test_near_vectors_equal_all_pairs(spark):
    from tramline.llm.hnsw import near_vectors

    rows = vector_rows()
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    assert sorted((tuple(x) for x in near_vectors(df, 0.9).collect()), key=repr) == brute_vectors(rows, 0.9)


def test_near_vectors_of_nothing(spark):
    from tramline.llm.hnsw import near_vectors

    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(x) for x in near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_graph_finds_what_a_scan_finds():
    from tramline.llm import hnsw

    g = np.random.default_rng(1)
    v = g.standard_normal((3000, 48)).astype(np.float32)
    v[1500:1900] = v[7] + 0.05 * g.standard_normal((400, 48))  # a group larger than any beam
    v /= np.linalg.norm(v, axis=1)[:, None]
    high = hnsw._heights(np.arange(len(v)))
    order = np.lexsort((np.arange(len(v)), -high))
    graph = hnsw.Graph.build(v[order], high[order])
    low = np.full(len(v), 0.9, np.float32)
    width = hnsw.audited(graph, v, low, np.arange(128))
    i, j = hnsw.hits(graph, v, low, width)
    truth, found = set(zip(*np.nonzero(v @ graph.v.T >= 0.9))), set(zip(i, j))
    assert found <= truth and len(found) >= 0.99 * len(truth)
