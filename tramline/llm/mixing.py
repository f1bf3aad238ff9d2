"""Mixing sources to target weights by hierarchical budgeting over a domain - language - source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm._common import materialize
from tramline.llm.packing import words_of

_LEVELS = ("domain", "lang", "source")
_ORDER = 4096  # slices of a leaf's epoch order: the first three hex digits of the order key


def default_domain() -> Column:
    """Four domains, by the last character of the source."""
    return F.concat(F.lit("domain"), (F.ascii(F.right(F.coalesce("source", F.lit("")), F.lit(1))) % 4).cast("string"))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's `_budget` among its children by `_weight`, none above its `_cap`; adds `_share`.

    What a full child leaves goes to its siblings by their weights; what all of them can't take was never
    given to this parent, because a parent's own cap is the sum of its children's. Children are visited by
    cap per weight, so two running sums tell who is full. Whole numbers throughout: at most one token a
    child is left over."""
    g = Window.partitionBy(*parent)
    w = g.orderBy(F.col("_cap") / F.col("_weight"), name)
    d = nodes.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("_weight").over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    d = d.withColumn("_full", F.col("_cap") * F.col("_open") <= (F.col("_budget") - F.col("_before")) * F.col("_weight"))
    d = d.withColumns({
        "_used": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(g), F.lit(0)),
        "_rest": F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(g),
    })
    share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_budget - _used) * _weight div _rest"))
    return d.withColumn("_share", share).drop("_before", "_open", "_full", "_used", "_rest")


def leaf_plan(rows: DataFrame, budget: tuple[int, int], max_epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int) -> DataFrame:
    """rows (doc_id, domain, lang, source, n_tokens, and mark, which tells rows of one doc_id apart) -> one row for each
    leaf: its budget, whole epochs, and the order key, mark and tokens at which its last epoch is cut. Rows equal in
    doc_id and mark share these tokens evenly."""
    if "mark" not in rows.columns:
        rows = rows.withColumn("mark", F.lit(0).cast("long"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = rows.groupBy(*_LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    given = leaves.select(F.lit(total * budget[0] // budget[1]).cast("long").alias("_share")).distinct()
    done: list[str] = []
    for level in _LEVELS:
        nodes = leaves.groupBy(*done, level).agg(F.sum("cap").alias("_cap")).withColumn("_weight", _weight(level, weights.get(level, {})))
        if done:
            nodes = nodes.join(given.withColumnRenamed("_share", "_budget"), done)
        else:
            nodes = nodes.withColumn("_budget", F.lit(total * budget[0] // budget[1]).cast("long"))
        given = water_fill(nodes, done or [F.lit(0)], level).select(*done, level, "_share")
        done.append(level)
    plan = leaves.join(given, list(_LEVELS)).select(*_LEVELS, "tokens", F.col("_share").alias("leaf_budget"))
    plan = plan.withColumn("full_epochs", F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("leaf_budget") - F.col("full_epochs") * F.col("tokens"))
    plan = materialize(plan, "mixing-leaves")

    keyed = rows.join(plan, list(_LEVELS)).filter("rest > 0").withColumn("key", order_key(seed))
    slices = keyed.groupBy(*_LEVELS, "rest", F.substring("key", 1, 3).alias("slice")).agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*_LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("n").over(w)).filter("upto >= rest and upto - n < rest").select(*_LEVELS, "slice", (F.col("upto") - F.col("n")).alias("base"))
    inside = keyed.withColumn("slice", F.substring("key", 1, 3)).join(slices, [*_LEVELS, "slice"])
    inside = inside.groupBy(*_LEVELS, "rest", "base", "key", "mark").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("copies"))
    w = Window.partitionBy(*_LEVELS).orderBy("key", "mark").rowsBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("upto", F.col("base") + F.sum("n").over(w)).filter("upto >= rest and upto - n < rest")
    cut = cut.select(*_LEVELS, F.col("key").alias("cut_key"), F.col("mark").alias("cut_mark"), F.expr("(rest - upto + n) div copies").alias("cut_tokens"))
    return plan.join(cut, list(_LEVELS), "left").select(*_LEVELS, "tokens", "leaf_budget", "full_epochs", "cut_key", "cut_mark", "cut_tokens")


def order_key(seed: int) -> Column:
    """Place of a row in the order of its leaf's last epoch; another seed or epoch gives another order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


#: Columns that mix adds; the caller's of these names are replaced.
ADDED = ["domain", "n_tokens", "leaf_budget", "epochs", "prefix_tokens", "taken_tokens"]


def mix(docs: DataFrame, budget: tuple[int, int] = (8, 10), max_epochs: int = 2, weights: Mapping[str, Mapping[str, int]] | None = None, seed: int = 7, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """How often, and how far, each document is read so that the mix meets the target weights.

    docs: doc_id, text (not needed with tokens, which counts a row's tokens), lang, source; further columns are kept
    whatever their names, but for those that are added. budget: tokens to give out, as a part of all
    tokens. weights: for each level (domain, lang, source) the weight of each name, 1 where none is given.
    A leaf gives at most max_epochs times its tokens. Adds domain (by default told from the source's last
    character), n_tokens (words), leaf_budget, epochs
    (whole passes over the document), prefix_tokens (tokens of one more, cut pass; only at the one document
    where its leaf's budget ends) and taken_tokens.

    Null names of a level are the name ''. Documents without words take nothing and are read as often as
    their place in the order says. Rows of one doc_id, or of none, follow each other by the hash of their text; rows that
    repeat both are taken alike and share the tokens of the cut evenly (less than a token a row is left over). Without
    a column text, rows of one doc_id are all alike. A leaf without tokens gets no budget. An empty table gives an
    empty result."""
    keep = [c for c in docs.columns if c not in ADDED]
    named = docs.select(
        F.struct(*keep).alias("row"), "doc_id", F.coalesce(domain if domain is not None else default_domain(), F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        (tokens if tokens is not None else words_of(F.col("text"))).cast("long").alias("n_tokens"), (F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")).alias("mark"),
    )
    rows = materialize(named.select("doc_id", *_LEVELS, "n_tokens", "mark"), "mixing-rows")
    plan = materialize(leaf_plan(rows, budget, max_epochs, weights or {}, seed), "mixing-plan")
    same = F.col("key") == F.col("cut_key")
    out = named.join(plan, list(_LEVELS)).withColumn("key", order_key(seed)).withColumns({
        "epochs": F.col("full_epochs") + F.coalesce(((F.col("key") < F.col("cut_key")) | (same & (F.col("mark") < F.col("cut_mark")))).cast("long"), F.lit(0)),
        "prefix_tokens": F.when(same & (F.col("mark") == F.col("cut_mark")), F.least("cut_tokens", "n_tokens")).otherwise(0).cast("long"),
    }).withColumn("taken_tokens", F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
    return out.select(*(F.col(c) if c in ("lang", "source") else F.col("row").getField(c).alias(c) for c in keep), *ADDED)
