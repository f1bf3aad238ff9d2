"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text is cut into pieces of a paragraph (up to three sentences of one line). Each distinct piece has a
64-bit digest whose lowest 20 bits check the others. The sketch is three tables of cells; a digest goes
into one cell of each, which keeps a count and the exclusive or of its digests. Two versions' cells
subtract; what is common cancels. A cell that holds one digest gives it away, which empties it from its
other cells, and so on (peeling). If cells stay full, the digests are dealt to groups by a hash and larger
sketches of each group are tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm._common import materialize

#: Cells in each of the three tables of the fingerprint; then those of the tries after it.
BASE, RETRIES = 4, (16, 64, 256)
#: Digests of a version in one group of a retry, about.
GROUP = 48
_CHECK = (1 << 20) - 1
_PIECE = r"(?:[^.!?\n]++[.!?]*+){1,3}+"
_ROUNDS = 40


def digests(text: Column) -> Column:
    """Distinct piece digests of a text; none for a text of separators only."""
    def seal(piece: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(piece), 20), 20)

    raw = F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), seal)
    return F.transform(F.array_distinct(raw), lambda u: u.bitwiseOR(F.xxhash64(F.shiftrightunsigned(u, 20)).bitwiseAND(_CHECK)))


def _slots(m: int) -> str:
    """SQL of the constant array of cells of three tables of m cells: shift of the table's bits, place in the table."""
    return "array(" + ", ".join(f"named_struct('s', {20 + 14 * t}, 'p', {p}L)" for t in range(3) for p in range(m)) + ")"


def _hits(array: str, name: str, cell: str, m: int) -> str:
    return f"filter({array}, {name} -> (shiftrightunsigned({name}, {cell}.s) & {m - 1}L) = {cell}.p)"


def cells_sql(a: str, m: int) -> str:
    """SQL of the sketch of digest array a: an array of (s, p, n, k)."""
    inner = f"transform({_slots(m)}, c -> named_struct('c', c, 'f', {_hits(a, 'u', 'c', m)}))"
    return f"transform({inner}, x -> named_struct('s', x.c.s, 'p', x.c.p, 'n', size(x.f), 'k', aggregate(x.f, 0L, (e, u) -> e ^ u)))"


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('s', x.s, 'p', x.p, 'n', x.n - y.n, 'k', x.k ^ y.k))"


def peel_sql(cells: str, m: int) -> str:
    """SQL of the number of digests that peeling recovers from subtracted cells; null if cells stay full."""
    def pure(sign: int) -> str:
        return f"array_distinct(transform(filter(st.c, x -> x.n = {sign} AND (xxhash64(shiftrightunsigned(x.k, 20)) & {_CHECK}L) = (x.k & {_CHECK}L)), x -> x.k))"

    less = f"transform(array(named_struct('f', {_hits('w.plus', 'u', 'x', m)}, 'g', {_hits('w.minus', 'u', 'x', m)})), h -> named_struct('s', x.s, 'p', x.p, 'n', x.n - size(h.f) + size(h.g), 'k', aggregate(h.f, aggregate(h.g, x.k, (e, u) -> e ^ u), (e, u) -> e ^ u)))[0]"
    update = f"transform(st.c, x -> if(x.n = 0 AND x.k = 0, x, {less}))"
    step = f"transform(array(named_struct('plus', {pure(1)}, 'minus', {pure(-1)})), w -> if(size(w.plus) + size(w.minus) = 0, named_struct('c', st.c, 'd', st.d, 'go', false), named_struct('c', {update}, 'd', st.d + size(w.plus) + size(w.minus), 'go', true)))[0]"
    return f"aggregate(sequence(1, {_ROUNDS}), named_struct('c', {cells}, 'd', 0, 'go', true), (st, i) -> if(st.go, {step}, st), st -> if(forall(st.c, x -> x.n = 0 AND x.k = 0), st.d, NULL))"


def difference_sql(a: str, b: str, base_a: str, base_b: str) -> str:
    """SQL of the number of digests that only one of a and b has, from their sketches.

    First the two fingerprints subtract. If they don't peel, the digests go to groups, and each group tries
    larger and larger sketches, none too small for the difference of its counts. For a group that
    the largest one fails too, the digests themselves are compared."""
    tries = ", ".join(f"if(abs(size(g.a) - size(g.b)) > {2 * m}, NULL, {peel_sql(subtract_sql(cells_sql('g.a', m), cells_sql('g.b', m)), m)})" for m in RETRIES)
    groups = f"greatest(1, cast(ceil(greatest(size({a}), size({b})) / {GROUP}) AS int))"
    part = "if({n} = 1, {v}, filter({v}, u -> pmod(xxhash64(u), {n}) = j))"
    split = f"transform(sequence(0, {groups} - 1), j -> named_struct('a', {part.format(n=groups, v=a)}, 'b', {part.format(n=groups, v=b)}))"
    retry = f"aggregate({split}, 0, (t, g) -> t + coalesce({tries}, size(array_except(g.a, g.b)) + size(array_except(g.b, g.a))))"
    return f"coalesce(if(abs(size({a}) - size({b})) > {2 * BASE}, NULL, {peel_sql(subtract_sql(base_a, base_b), BASE)}), {retry})"


def _likeness(d: str, a: str, b: str) -> Column:
    """Jaccard likeness of two sets from their sizes and difference; 1 for two empty ones."""
    both = f"(size({a}) + size({b}))"
    return F.expr(f"if({both} = 0, 1D, cast({both} - {d} AS double) / ({both} + {d}))")


def _string(cells: str, a: str) -> Column:
    return F.expr(f"concat(size({a}), ':', array_join(transform({cells}, c -> concat(c.n, '.', lower(hex(c.k)))), '-'))")


def with_next(rows: DataFrame, columns: list[str], per_bucket: int = 1024) -> DataFrame:
    """rows (id, tie, ...) with next_<column> of the row that follows in order of id (null first), tie; the last is followed by the first.

    Rows go to ranges of ids of about `per_bucket` rows, and each range also gets the first row of the next
    one, so no task sees more than a range. Ranges are of one width first; one with many more rows, as where ids
    lie in far clusters, is cut again between its own least and largest id."""
    lo, hi, n = rows.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if lo is None:
        lo, hi, n = 0, 0, 1
    width = max(1.0, (hi - lo + 1) * per_bucket / n)
    bucket = F.coalesce(((F.col("id").cast("double") - float(lo)) / width).cast("long"), F.lit(-1))
    crowds = rows.select("id", bucket.alias("wide")).groupBy("wide").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    crowds = materialize(crowds.filter(f"n > {4 * per_bucket} AND lo < hi"), "next-crowds")
    rows = rows.withColumn("wide", bucket).join(F.broadcast(crowds) if crowds.count() <= 500_000 else crowds, "wide", "left")
    fine = F.floor((F.col("id").cast("double") - F.col("lo")) / F.greatest(F.lit(1.0), (F.col("hi").cast("double") - F.col("lo") + 1) * per_bucket / F.col("n")))
    rows = rows.withColumn("bucket", F.struct("wide", F.coalesce(fine, F.lit(0)).alias("fine"))).drop("wide", "lo", "hi", "n")
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("first")).withColumn("above", F.expr(f"bucket.wide div {per_bucket}"))
    firsts = materialize(firsts, "next-firsts")
    inside = Window.partitionBy("above").orderBy("bucket")
    tops = firsts.groupBy("above").agg(F.max("bucket").alias("last"))
    every = Window.orderBy("above")  # one row for per_bucket ranges
    tops = tops.withColumn("before_top", F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("above", "before_top")
    # Each range's first row is copied to the range before it, the first range's to the last.
    copies = firsts.withColumn("back", F.lag("bucket").over(inside)).join(tops, "above").select(F.col("first.id").alias("fid"), F.col("first.tie").alias("ftie"), F.coalesce("back", "before_top").alias("to"))
    copies = materialize(copies, "next-copies")
    guests = rows.join(F.broadcast(copies) if copies.count() <= 500_000 else copies, F.col("id").eqNullSafe(F.col("fid")) & (F.col("tie") == F.col("ftie")))
    guests = guests.dropDuplicates(["fid", "ftie"]).withColumn("bucket", F.col("to")).withColumn("guest", F.lit(True)).drop("fid", "ftie", "to")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").asc_nulls_first(), "tie")
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col("guest")).drop("guest", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of docs (doc_id, text) and its edited twin, and compare.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next row's text, by ascending doc_id; the first row follows the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (Jaccard likeness of the piece
    sets, as recovered from the sketches), n_pieces. The strings hold the smallest sketch; where two of them differ
    in more pieces than it can tell, likeness comes from larger sketches of the same texts, which are not returned.

    Null texts count as empty. Rows that repeat a doc_id follow each other by a hash of the text. A null
    doc_id comes first. Equal texts have equal fingerprints. A single row follows itself; an empty table
    gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("doc_id").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"), digests(text).alias("a"))
    rows = rows.withColumn("ca", F.expr(cells_sql("a", BASE)))
    d = with_next(rows, ["text", "a", "ca"])
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 AS int)), substring(next_text, 1, cast(n_chars div 2 AS int)))"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "ca", digests(F.col("edited")).alias("e"), F.col("next_a").alias("b"), F.col("next_ca").alias("cb"))
    d = d.withColumn("ce", F.expr(cells_sql("e", BASE)))
    d = d.withColumns({"de": F.expr(difference_sql("a", "e", "ca", "ce")), "dn": F.expr(difference_sql("a", "b", "ca", "cb"))})
    return d.select("doc_id", "n_chars", "edited_sha256", _string("ca", "a").alias("fingerprint"), _string("ce", "e").alias("edited_fingerprint"), _likeness("de", "a", "e").alias("near_edited"), _likeness("dn", "a", "b").alias("near_next"), F.size("a").cast("long").alias("n_pieces"))
