"""Corpus preparation: five stages over documents, each one operator of tramline.llm.

toxicity -> line dedup -> n-gram Jaccard join -> mixing to target weights -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. docs is what the stage before kept, with the
columns of documents (doc_id, text, lang, source, n_chars); all stages but the last return these columns.
An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm._common import materialize
from tramline.llm.jaccard_join import BROADCAST_IDS, jaccard_components
from tramline.llm.line_dedup import dedup_lines
from tramline.llm.mixing import mix
from tramline.llm.packing import pack
from tramline.llm.queries import WEIGHTS
from tramline.llm.toxicity import fit, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labelled ones among docs, does not call toxic. Null and empty texts stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier line; n_chars follows the text.

    A document that loses four fifths of its characters or more to earlier documents (or earlier lines of its
    own) is a copy of them and goes. A document that loses no line stays as it is, also if it is empty. Lines of
    any number of words are compared; lines without words stay."""
    out = dedup_lines(docs.select(*COLUMNS, F.col("text").alias("before")), least=1)
    left = F.char_length(F.trim("text"))
    kept = out.filter((F.col("n_removed") == 0) | ((left > 0) & (left * 5 > F.char_length("before"))))
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by word 5-grams of Jaccard similarity 0.8 or more: the one with the smallest doc_id,
    then the smallest hash of its text; a row without doc_id comes after those with one.

    Rows are told apart by doc_id and text, so different texts of one doc_id stay or go by themselves. Texts without
    words are no group and stay."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("mark")).alias("key")
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), q=5, num=8, den=10, label="near").filter("n_shingles > 0")
    found = materialize(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("first")), "near-found")
    gone = materialize(found.filter("key <> first").select("key").distinct(), "near-gone")
    stay = docs.select(*COLUMNS, key).join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "key", "left_anti")
    again = materialize(found.filter("key = first").groupBy("key").count().filter("count > 1").select("key"), "near-again")
    n = again.count()
    if not n:
        return stay.drop("key")
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    return stay.join(again, "key", "left_anti").unionByName(stay.join(again, "key", "left_semi").dropDuplicates(["key"])).drop("key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose leaf budgets reach them: nine tenths of all tokens, shared by the target weights.

    One epoch at most, since copies have just been removed; the document at which a leaf's budget ends stays whole."""
    mixed = mix(docs.select(*COLUMNS).withColumns({"_lang": F.col("lang"), "_source": F.col("source")}), budget=(9, 10), max_epochs=1, weights=WEIGHTS, seed=7)
    return mixed.filter("epochs > 0 or prefix_tokens > 0").select("doc_id", "text", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_chars")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches: doc_id, n_tokens, bucket, bucket_len, batch, position, padding."""
    return pack(docs, buckets=16, token_budget=65_536, label="pack")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("length_packing", pack_batches),
]

#: SQL can express neither the lexicon's fit nor the choice of bucket boundaries; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
