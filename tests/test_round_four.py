import collections
import types

import numpy as np
import pyarrow as pa
import pytest

from tramline.plans import function_queries


def test_smoothed_columns_equal_sql_to_the_sign_of_zero(spark, tmp_path):
    """Text tells -0.0 from 0.0. Short vectors, gaps and no vector at all give what SQL gives."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1e-6, 64)]) for i in range(20)]
    rows += [(20, None), (21, []), (22, [0.5, -0.25]), (23, [None if i % 3 else i / 7 for i in range(64)]), (24, [-0.0] * 64), (25, [float("nan"), *[1.5] * 63])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = f"{tmp_path}/out"
    function_queries.smoothed_columns(spark, str(tmp_path)).write.parquet(out)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT vec_id, line::VARCHAR FROM ({function_queries.ORACLES['smoothed_columns']}) ORDER BY 1").fetchall()
    assert "-0.0," in want[0][1]
    assert con.sql(f"SELECT vec_id, line::VARCHAR FROM '{out}/*.parquet' ORDER BY 1").fetchall() == want


# ---------------------------------------------------------------- collocations


def test_collocations_sketch_of_pairs_holds_where_counters_are_few():
    """Random words: each is frequent, hardly a pair is, and no longer window. With twelve windows of a length for each counter
    all windows once kept their four words; now what is longer than a pair is counted only where its pairs may be frequent."""
    from tramline.llm import collocations as c

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 2500, 4000)) for _ in range(200)] + ["new york is big"] * 40
    batch = pa.record_batch([pa.array(texts), pa.array(["en"] * len(texts))], ["text", "lang"])
    slots, box = 1 << 16, types.SimpleNamespace

    def bits(short=None):
        made = np.zeros(slots // 8, np.uint8)
        for found in c._frequent_bits(30)(c._sketch(slots, short)([batch])):
            for block, raw in zip(found["block"].to_pylist(), found["bits"].to_pylist()):
                made[block * c.BLOCK // 8 : (block + 1) * c.BLOCK // 8] = np.frombuffer(raw, np.uint8)
        return box(value=made.tobytes())

    short = bits()
    out = pa.Table.from_batches(c._windows(short, bits(short))([batch])).to_pylist()
    four = collections.Counter((x["w1"], x["w2"], x["w3"], x["w4"]) for x in out if x["w4"])
    assert ("new", "york", "is", "big") in four and len(four) < 100_000
    assert sum(x["n"] for x in out) == 200 * 4000 + 160


def test_collocations_of_a_least_count_beyond_a_counter(spark, monkeypatch):
    from tramline.llm import collocations as c

    monkeypatch.setattr(c, "SLOTS", 1 << 16)
    monkeypatch.setattr(c, "MOST", 1 << 16)
    docs = spark.createDataFrame([("one two one two", "en")] * 200 + [("one three", "en")] * 20, "text string, lang string")
    found = {tuple(x["words"]): x["f"] for x in c.count_phrases(docs, 300).collect()}
    assert found == {(): 840, ("one",): 420, ("two",): 400, ("one", "two"): 400}


# ---------------------------------------------------------------- jump windows


def test_cues_of_many_clips_are_solved_together():
    """A call for thousands of clips, in batches that cut clips anywhere, does what a call for each clip does, in seconds."""
    import time

    from tramline.plans import jumps

    rng = np.random.default_rng(4)
    rows, cue = [], {"type": "jump", "label": "x", "height": 0.3, "airTime": None, "window": 0.5}
    for clip in range(3000):
        for i in range(12):
            t = i * 0.15
            rows.append((clip, 0, t, 0.5 + 0.01 * (i % 7), 0.4, None, None, None))
            rows.append((clip, 1, t, None, None, None, None, None))
            if rng.random() < 0.5:
                rows.append((clip, 2, t, x := rng.random(), y := rng.random() / 2, x + 0.1, y + 0.3, None))
        rows += [(clip, 3, None, 0.17 if clip % 9 else None, None, None, None, {"clip_id": clip, "time": 0.3 + k, **cue}) for k in range(2)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
    kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 5, pa.struct([("clip_id", pa.int64()), ("time", pa.float64()), ("type", pa.string()), ("label", pa.string()), ("height", pa.float64()), ("airTime", pa.float64()), ("window", pa.float64())])]
    names = ["_clip", "kind", "t", *"abcd", "_cue"]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    began = time.monotonic()
    together = pa.Table.from_batches(jumps._solve(iter(table.to_batches(max_chunksize=977)))).to_pylist()
    assert time.monotonic() - began < 20 and len(together) == 6000
    few = 40
    ends = np.flatnonzero(np.diff([r[0] for r in rows], append=-1)) + 1
    alone = [x for lo, hi in zip([0, *ends[:few]], ends[:few]) for x in jumps._solved(table.slice(lo, hi - lo)).to_pylist()]
    assert together[: 2 * few] == alone
    assert sum(x["window"] != 0.5 for x in together) > 1000 and all(x["window"] == 0.5 for x in together if x["clip_id"] % 9 == 0)


# ---------------------------------------------------------------- silhouettes


def test_disc_hits_equal_a_decoded_mask(spark):
    """All silhouettes of a batch are probed at once, with the pixels of the decoded mask and null where a needed value is null."""
    from pyspark.sql import functions as F

    from tramline.functions import masks

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for i in range(300):
        w, h = int(rng.integers(1, 25)), int(rng.integers(1, 15))
        runs = [int(x) for x in rng.integers(0, 30, rng.integers(0, 12))]
        cx, cy, rx, ry = (float(x) for x in rng.uniform([-0.2, -0.2, 0, 0], [1.2, 1.2, 0.3, 0.3]))
        rows.append((i, runs, w, h, cx, cy, rx, ry))
        lit = np.repeat(np.arange(len(runs)) % 2 == 1, runs) if runs else np.zeros(0, bool)
        at = [(int((cx + x * rx) * w), int((cy + y * ry) * h)) for x, y in masks.POINTS]
        want[i] = any(0 <= px < w and 0 <= py < h and py * w + px < len(lit) and bool(lit[py * w + px]) for px, py in at)
    rows += [(300, None, 20, 10, 0.5, 0.5, 0.1, 0.1), (301, [0, 200], 20, 10, None, 0.5, 0.1, 0.1), (302, [0, 200], 20, 10, None, 9.0, 0.1, 0.1), (303, None, 20, 10, 9.0, 0.5, 0.1, 0.1), (304, [2**40, 5], 20, 10, 0.5, 0.5, 0.1, 0.1)]
    want |= {300: None, 301: None, 302: False, 303: False, 304: False}
    d = spark.createDataFrame(rows, "i int, runs array<bigint>, w int, h int, cx double, cy double, rx double, ry double")
    df = d.select("i", masks.disc_hits(masks.run_ends(F.col("runs")), "w", "h", "cx", "cy", "rx", "ry").alias("hit"))
    assert "aggregate" not in str(masks.disc_hits(F.col("runs"), "w", "h", "cx", "cy", "rx", "ry"))
    assert {r.i: r.hit for r in df.collect()} == want
    assert 30 < sum(bool(x) for x in want.values()) < 270


# ---------------------------------------------------------------- occlusion


def test_a_chain_of_lookups_deals_rows_out_once(spark):
    """What a lookup gives lies by clip already; the next one used to deal all of it out again."""
    from tramline.operators.asof import interp_join

    rows = lambda names: spark.createDataFrame([("c", 0.0, 0.0), ("c", 10.0, 5.0)], f"clip_id string, {names}").repartition("clip_id")
    at = rows("t double, n double")
    for x, y in (("t", "d"), ("d", "y")):
        at = interp_join(at, rows(f"{x} double, {y} double"), ["clip_id"], x, [y])
    assert [(r.t, r.d, r.y) for r in at.orderBy("t").collect()] == [(0.0, 0.0, 0.0), (10.0, 5.0, 2.5)]
    assert at._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3


def test_cut_leaves_no_shuffle_files(spark, tmp_path):
    """The shuffle files of a table that is written go with the write; settings come back as they were."""
    from tramline.operators.lineage import ALL_KEYS, CLEANUP, cut

    before = [spark.conf.get(name, None) for name in (CLEANUP, ALL_KEYS)]
    d = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").agg({"id": "sum"})
    plain = {tuple(r) for r in d.collect()}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return sum("shuffle_" in found.apply(i).getName() for i in range(found.size()))

    had = files()
    out = cut(d, grouped=True)
    assert files() <= had
    assert {tuple(r) for r in out.collect()} == plain
    assert [spark.conf.get(name, None) for name in (CLEANUP, ALL_KEYS)] == before


# ---------------------------------------------------------------- near vectors


def test_searches_hold_a_bounded_part_of_a_crowded_graph(monkeypatch):
    """Wide beams and comparisons with all nodes go by few queries at a time: what is found stays, what is held does not grow with it."""
    import tracemalloc

    from tramline.llm import hnsw

    rng = np.random.default_rng(8)
    v = rng.standard_normal((1000, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = hnsw.Graph.build(v, np.sort(hnsw._heights(np.arange(len(v))))[::-1])
    q, low = v[:256], np.full(256, 0.6, np.float32)

    def found():
        tracemalloc.start()
        i, j = hnsw.hits(graph, q, low, 32)
        held = tracemalloc.get_traced_memory()[1] - 4 * i.nbytes
        tracemalloc.stop()
        return set(zip(i.tolist(), j.tolist())), held

    whole, much = found()
    monkeypatch.setattr(hnsw, "AT_ONCE", 1 << 16)
    some, little = found()
    assert some == whole and little < much / 2
    assert hnsw.audited(graph, q, low, np.arange(32)) >= 32
