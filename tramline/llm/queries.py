"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.jaccard_join import jaccard_components

    return jaccard_components(_docs(spark, sf_dir), q=3, num=90, den=100, n2=3, label="op2", links=True).drop("set_id")


#: Target weights of the mixing query and stage.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tramline.llm._common import materialize
    from tramline.llm.mixing import mix
    from tramline.llm.packing import words_of

    columns = ["doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "epochs", "prefix_tokens", "taken_tokens"]
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source", words_of(F.col("text")).alias("n"))  # no text is needed beyond its count
    return mix(materialize(docs, "op1-counted"), budget=(8, 10), max_epochs=2, weights=WEIGHTS, seed=7, tokens=F.col("n")).select(*columns)


def op3_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.packing import pack

    return pack(_docs(spark, sf_dir), buckets=16, token_budget=65_536, label="op3")


def op4_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir), shards=40, label="op4")


def op5_ibf_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.fingerprint import fingerprints

    return fingerprints(_docs(spark, sf_dir))


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.ppm import score_documents

    return score_documents(_docs(spark, sf_dir), folds=5, fold=1, label="op6")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tramline.llm.line_dedup import dedup_lines

    out = dedup_lines(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.licenses import scan_licenses

    return scan_licenses(_docs(spark, sf_dir)).drop("detections")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.toxicity import toxicity

    return toxicity(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.media import store_and_describe

    return store_and_describe(_docs(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.collocations import collocations

    return collocations(_docs(spark, sf_dir), least=30, top=2000, label="op11")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.conversations import damaged, repair_conversations

    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), label="op12")


def op13_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.hnsw import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9, label="op13")


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_length_packing": op3_length_packing,
    "op4_kk_sharding": op4_kk_sharding,
    "op5_ibf_fingerprints": op5_ibf_fingerprints,
    "op6_ppm_scoring": op6_ppm_scoring,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_media_columns": op10_media_columns,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hnsw_near_dedup": op13_hnsw_near_dedup,
}

ORACLES: dict[str, str] = {}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
e AS (SELECT doc_id, hash(unnest(g)) AS s FROM g),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id)::BIGINT AS n_links
FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


def _fill(level: str, parent: str, children: str, given: str) -> str:
    """One level of the tree in SQL: children (parent, name, cap, w, b) -> the same with their share."""
    over = f"PARTITION BY {parent}" if parent else ""
    order = f"{over} ORDER BY cap / w, {level}"
    keep = f"{parent}, {level}" if parent else level
    return f"""{given}a AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
        sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM {children}),
    {given}b AS (SELECT *, cap * op <= (b - bef) * w AS fl FROM {given}a),
    {given}c AS (SELECT *, coalesce(sum(CASE WHEN fl THEN cap END) OVER ({over}), 0) AS used, sum(CASE WHEN NOT fl THEN w END) OVER ({over}) AS rst FROM {given}b),
    {given} AS (SELECT {keep}, CASE WHEN fl THEN cap ELSE (b - used) * w // rst END AS share FROM {given}c)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


ORACLES["op1_source_mixing"] = rf"""
WITH d AS (SELECT doc_id, 'domain' || (ascii(right(coalesce(source, ''), 1)) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
lf AS (SELECT domain, lang, source, sum(n)::HUGEINT AS t, 2 * sum(n)::HUGEINT AS cap FROM d GROUP BY ALL),
x0 AS (SELECT domain, sum(cap) AS cap, {_case("domain", WEIGHTS["domain"])} AS w, (SELECT sum(t) * 8 // 10 FROM lf) AS b FROM lf GROUP BY domain),
{_fill("domain", "", "x0", "g0")},
x1 AS (SELECT domain, lang, sum(cap) AS cap, {_case("lang", WEIGHTS["lang"])} AS w, any_value(share) AS b FROM lf JOIN g0 USING (domain) GROUP BY domain, lang),
{_fill("lang", "domain", "x1", "g1")},
x2 AS (SELECT domain, lang, source, cap, 1 AS w, share AS b FROM lf JOIN g1 USING (domain, lang)),
{_fill("source", "domain, lang", "x2", "g2")},
pl AS (SELECT *, CASE WHEN t > 0 THEN share // t ELSE 0 END AS e FROM lf JOIN g2 USING (domain, lang, source)),
k AS (SELECT d.*, share, e, share - e * t AS rest, md5('7:' || e || ':' || doc_id) AS key FROM d JOIN pl USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM k),
f AS (SELECT *, e + CASE WHEN n > 0 AND bef + n < rest OR n = 0 AND bef < rest THEN 1 ELSE 0 END AS ep,
    CASE WHEN bef < rest AND bef + n >= rest THEN rest - bef ELSE 0 END AS pre FROM c)
SELECT doc_id, domain, lang, source, n AS n_tokens, share::BIGINT AS leaf_budget, ep::BIGINT AS epochs, pre::BIGINT AS prefix_tokens,
    (ep * n + pre)::BIGINT AS taken_tokens FROM f
"""

ORACLES["op7_line_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
w AS (SELECT doc_id, pos, doc_id * 1000000 + pos AS id, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
e AS (SELECT doc_id, pos, id, list_distinct(w) AS w FROM w WHERE len(w) >= 1),
k AS (SELECT id, len(w) AS n, unnest(w) AS w FROM e),
f AS (SELECT w, count(*) AS f FROM k GROUP BY w),
o AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS r FROM k JOIN f USING (w)),
p AS (SELECT id, n, w FROM o WHERE r <= n - ceil(n * 8 / 10) + 1),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.w = y.w AND x.id < y.id AND least(x.n, y.n) * 10 >= greatest(x.n, y.n) * 8),
g AS (SELECT DISTINCT b AS id FROM c JOIN e x ON x.id = a JOIN e y ON y.id = b
    WHERE len(list_intersect(x.w, y.w)) * 18 >= 8 * (len(x.w) + len(y.w))),
r AS (SELECT l.doc_id, l.pos, l.line, g.id IS NOT NULL AS gone FROM l LEFT JOIN g ON g.id = l.doc_id * 1000000 + l.pos)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
    coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (gone), '') AS removed,
    md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5 FROM r GROUP BY doc_id
"""

ORACLES["op11_collocations"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
j AS (SELECT *, unnest(range(1, k)) AS i FROM c),
p2 AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(w[:i], ' ') AS one, array_to_string(w[i + 1:], ' ') AS two FROM j),
s AS (SELECT p2.lang, p2.phrase, a, i, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score FROM p2 JOIN f x ON x.lang = p2.lang AND x.phrase = one JOIN f y ON y.lang = p2.lang AND y.phrase = two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
m AS (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2),
x AS (SELECT *, unnest(range(1, k - m + 2)) AS i FROM m),
i AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM x GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def _repair_sql() -> str:
    """Forward over the rows: for each state the least (cost, audit) and its lines; equal costs never have one audit begin another."""

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def way(frm: str, cost: str, letter: str, line: str, when: str = "") -> str:
        made = f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{letter}', 't': {f'list_append({frm}.t, {line})' if line else f'{frm}.t'}}}"
        return f"CASE WHEN {when} THEN {made} ELSE {never} END" if when else made

    never = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    stays, own = "fault NOT IN (1, 2)", "role || ':' || text"
    kept = lambda s, i: way(f"s{s}", "cut", "K", own, f"{stays} AND ini = '{i}'")
    turned = lambda s, to: way(f"s{s}", "2 + cut", "R", f"'{to}:' || text", stays)
    gone = [way(f"s{s}", "3", "D", "") for s in range(4)]
    step = [gone[0], least(gone[1], kept(0, "s")), least(gone[2], *(f(s, x) for s in (0, 1, 3) for f, x in ((kept, "u"), (turned, "user")))), least(gone[3], kept(2, "a"), turned(2, "assistant"))]
    into_user = least("s2", *(way(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")))
    return rf"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(name) + 1), lambda i: ascii(name[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS what FROM x),
e AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE what WHEN 3 THEN [0, 1] WHEN 0 THEN [] ELSE [0] END) AS k FROM c),
o AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM e),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i, left(role, 1) AS ini, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
p AS (SELECT *, coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM f),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM p GROUP BY conv_id),
d AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {never} AS s1, {{'c': 2::BIGINT, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM n
    UNION ALL
    SELECT conv_id, i, s0, s1, s2, {least("s3", way("s2", "2", "I", "'assistant:'"))} FROM (
    SELECT conv_id, i, s0, s1, {into_user} AS s2, s3 FROM (
    SELECT d.conv_id, d.i + 1 AS i, {", ".join(f"{sql} AS s{k}" for k, sql in enumerate(step))} FROM d JOIN (SELECT *, (fault = 3)::BIGINT AS cut FROM f) f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1))),
b AS (SELECT n.*, list_sort([s0, s3])[1] AS b FROM n JOIN d ON d.conv_id IS NOT DISTINCT FROM n.conv_id AND d.i = n.rows)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(array_to_string(b.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM v.conv_id
"""


ORACLES["op12_conversation_repair"] = _repair_sql()

ORACLES["op13_hnsw_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
u AS MATERIALIZED (SELECT *, coalesce(len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_sum(list_transform(x, lambda y: y * y)) > 0, false) AS ok FROM v),
l AS MATERIALIZED (SELECT p.i AS a, q.i AS b FROM (FROM u WHERE ok) p JOIN (FROM u WHERE ok) q ON p.i <> q.i AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
r AS (SELECT i AS a, i AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS i, min(u.vec_id) AS component_id FROM r JOIN u ON u.i = r.b GROUP BY r.a),
n AS (SELECT a AS i, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM u JOIN c USING (i) LEFT JOIN n USING (i)
"""
