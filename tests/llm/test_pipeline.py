"""The corpus pipeline stage by stage, on planted cases and odd rows."""

import random

import pytest


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(11)
    calm = ["".join(r.choice("aeiou") + r.choice("lmnrt") for _ in range(r.randint(1, 4))) for _ in range(2000)]

    def text(lines=4):
        return "\n".join(" ".join(r.choice(calm) for _ in range(20)) + "." for _ in range(lines))

    rows = [(i, text()) for i in range(200)]
    passage = " ".join(r.choice(calm) for _ in range(60))
    rows += [(200 + i, text() + "\n" + passage) for i in range(10)]
    rows += [(300 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(400 + i, rows[i + 20][1].replace(rows[i + 20][1].split(" ")[3], "changed", 1)) for i in range(10)]  # near copies
    rows += [(500 + i, text() + " you idiot moron scum") for i in range(10)]
    rows += [(600, None), (601, ""), (602, "few"), (602, "few"), (None, "without an id but with words of its own here")]
    path = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", f"src{k % 8}", len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, passage


def test_stages(spark, made):
    import corpus_pipeline as p

    path, passage = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "length_packing"]
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, path)
        if k < 4:
            assert sorted(docs.columns) == sorted(columns)
            out = f"{path}/{name}"
            docs.write.parquet(out)
            docs = spark.read.parquet(out)
            seen[name] = {(x.doc_id, x.text) for x in docs.collect()}
    ids = {n: {i for i, _ in s} for n, s in seen.items()}
    assert not ids["toxicity"] & set(range(500, 510)) and ids["toxicity"] >= {*range(200), 600, 601, 602, None}
    assert ids["line_dedup"] >= {*range(200), *range(200, 210), 600, 601, 602} and not ids["line_dedup"] & set(range(300, 310)) and not ids["line_dedup"] & set(range(400, 410))
    assert [i for i, t in seen["line_dedup"] if t and passage in t] == [200]
    assert ids["ngram_jaccard_join"] >= set(range(210))
    assert ids["source_mixing"] <= ids["ngram_jaccard_join"] and len(ids["source_mixing"]) > 100
    packed = docs.collect()
    assert {x.doc_id for x in packed} == ids["source_mixing"] and all(x.padding >= 0 for x in packed)


def test_near_copies_keep_one(spark, made):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    out = p.keep_one_of_near_copies(spark, docs, made[0]).collect()
    ids = [x.doc_id for x in out]
    assert not set(ids) & {*range(300, 310), *range(400, 410)} and ids.count(602) == 1 and {*range(200), 600, 601, None} <= set(ids)


def test_short_lines_go(spark):
    import corpus_pipeline as p

    rows = [(1, "Home page\nthe first of these texts has words of its own"), (2, "home Page\nanother one has quite different things to tell us"), (3, "home page")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {x.doc_id: x.text for x in p.drop_repeated_lines(spark, docs, "").collect()}
    assert out == {1: rows[0][1], 2: rows[1][1].split("\n")[1]}


def test_near_copies_are_rows(spark):
    """Different texts of one doc_id stay or go by themselves, and rows without doc_id are copies like any others."""
    import corpus_pipeline as p

    def text(k, last=""):
        return " ".join(f"{k}w{i}" for i in range(40)) + last

    rows = [(1, text("a")), (2, text("a", " more")), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (None, text("c", " more"))]
    rows += [(None, text("e")), (None, text("e", " more")), (None, text("e")), (None, text("f")), (4, "\n"), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = sorted(((x.doc_id, x.text) for x in p.keep_one_of_near_copies(spark, docs, "").collect()), key=repr)
    rest = [x for x in out if x not in [(None, text("e")), (None, text("e", " more"))]]
    assert len(out) - len(rest) == 1
    assert rest == sorted([(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("f")), (4, "\n"), (5, None), (None, None)], key=repr)


def test_empty_tables_pass(spark, made):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{made[0]}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, docs, made[0])
        assert out.count() == 0
        if "text" in out.columns:
            docs = out


def test_run(spark, made):
    import corpus_pipeline as p

    assert p.ORACLE_SQL is None and p.run(spark, made[0]).count() > 100
