"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words. Words are ordered by rarity, from a histogram of all words of
the corpus; two lines with Jaccard similarity of num/den or more share a word among the first few of each
(prefix filter; fewer of the shorter line), at places that leave room for enough common words (positional filter), and are of similar
size (length filter). Parities of the words leave few of these pairs, which are compared exactly; of a pair
the later line goes.

Lines of one word set are one line from the start. Before all pairs of a prefix word meet, each line meets
the earliest line that shares one of a few of its prefix words: most members of a large group of similar
lines go there, and only lines that are still open are looked up among all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm._common import materialize

#: Slots of the word histogram, a power of two. Words that share a slot count together, which can only make a rare
#: word look commoner: the order stays one order for all lines, so no pair is lost.
SLOTS = 1 << 18
#: Rows, or entries of lists, of a join side that is sent to all tasks rather than shuffled.
BROADCAST_VALUES = 1_000_000
#: Lines of fewer words are not compared: by default every line that has words is.
MIN_WORDS = 1
#: Prefix words, least by hash, by which a line first meets one earlier line.
FIRST_WORDS = 4
#: Passes over the prefix words of all lines, each over the words of one remainder: only one pass's rows are on disk.
PASSES = 2
#: Lines of so many words carry two numbers of parities, shorter ones one; more words would fill a single one.
LONG = 96
_ODD = ["odd0", "odd1"]
_UPPER, _LOWER, _SPACES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\t\x0b\f\r"


def _small(df: DataFrame, values: str = "1") -> DataFrame:
    """df, marked for broadcast if its values were counted and are few; df must be a written table."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(values))).first()[0] or 0) <= BROADCAST_VALUES else df


def _keyed() -> list[Column]:
    """What tells rows apart: id is doc_id, or the least number for null; mark is a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("mark")]


def _bit(word: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(63).cast("int"))


def _folded(text: Column) -> Column:
    """A-Z lower-cased, white space but line ends as spaces. Texts of ASCII alone without other white space, by far the most,
    go the shorter way, which gives the same."""
    plain = F.octet_length(text) == F.char_length(text)
    for c in _SPACES:
        plain = plain & ~F.contains(text, F.lit(c))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER + _SPACES, _LOWER + " " * len(_SPACES)))


def _spelt(text: Column) -> Column:
    """_folded for ASCII texts; others have a Latin-1 letter for each byte of UTF-8 before they are lower-cased and spaced alike.

    Words are the same so if they are the same folded. Beyond A-Z only the first bytes of two-byte characters change, to those
    of longer characters, and these are followed by more bytes. This takes less than looking up each character."""
    low = F.lower(F.decode(F.make_valid_utf8(text).cast("binary"), "ISO-8859-1"))
    spaced = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in _SPACES])
    other = F.when(spaced, F.translate(low, _SPACES, " " * len(_SPACES))).otherwise(low)
    return F.when(F.octet_length(text) == F.char_length(text), _folded(text)).otherwise(other)


def _parities(words: str) -> dict[str, Column]:
    """odd0: 64 parities of the words; odd1: the same of half of them, for long lines. Every word that only one of two
    lines has flips one bit of odd0, and one of 128 if odd1 is taken apart from it."""
    every = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(_bit(w)))
    half = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.when(w.bitwiseAND(64) == 0, a.bitwiseXOR(_bit(w))).otherwise(a))
    return {"odd0": every, "odd1": F.when(F.size(words) >= LONG, half)}


def line_sets(docs: DataFrame) -> DataFrame:
    """(id, mark, pos, n, words, key, odd0, odd1) of every line of docs (doc_id, text) that has words: n words, of which
    words are the distinct ones' hashes, in order; key stands for the set."""
    lines = docs.select(*_keyed(), F.posexplode(F.split(_spelt(F.col("text")), "\n")).alias("pos", "line"))
    hashes = F.array_remove(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    words = lines.select("id", "mark", "pos", hashes.alias("h"))
    words = words.select("id", "mark", "pos", F.size("h").alias("n"), F.sort_array(F.array_distinct("h")).alias("words"))
    return words.withColumns({"key": F.xxhash64("words"), **_parities("words")})


def rarity(lines: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row of classes: for each slot a class of its count over the words of all lines, rarer words first, in the upper
    12 bits. It has `slots` numbers whatever the corpus holds."""
    counts = lines.select(F.explode("words").alias("h")).groupBy(F.col("h").bitwiseAND(slots - 1).alias("slot")).count()
    classes = counts.select("slot", F.shiftleft(F.floor(F.log2("count") * 3 + 1).cast("long"), 52).alias("c"))
    every = lines.sparkSession.range(slots).select(F.col("id").alias("slot")).join(classes, "slot", "left").select("slot", F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "c"))), lambda e: e["c"]).alias("classes"))


def prefix(words: str, classes: str, num: int, den: int, slots: int = SLOTS) -> Column:
    """32 bits of each prefix word: the words are put in order, rarest first, by the class of their slot, then their hash."""
    code = F.transform(words, lambda x: F.coalesce(F.col(classes)[x.bitwiseAND(slots - 1)].bitwiseOR(F.shiftrightunsigned(x, 12)), F.lit(0).cast("long")))
    size = F.size(words)
    some = F.slice(F.sort_array(code), 1, size - F.ceil(size * F.lit(num) / den).cast("int") + 1)
    return F.transform(some, lambda w: w.bitwiseXOR(F.shiftrightunsigned(w, 21)).bitwiseAND(0x7FFFFFFF).cast("int"))


def _fits(num: int, den: int, places: bool) -> Column:
    """Whether line x<...> may be similar to line y<...>: length, positional (with places) and parity filter."""
    both = F.col("xsize") + F.col("ysize")
    ok = F.least("xsize", "ysize") * den >= F.greatest("xsize", "ysize") * num
    if places:
        ok = ok & (F.least(F.col("xsize") - F.col("xplace"), F.col("ysize") - F.col("yplace")) * (num + den) >= both * num)
    every, half = (F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}")) for c in _ODD)
    two = F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))
    return ok & (F.bit_count(every) * (num + den) <= both * (den - num)) & ((F.least("xsize", "ysize") < LONG) | (two * (num + den) <= both * (den - num)))


def _first_pairs(lines: DataFrame, num: int, den: int) -> DataFrame:
    """Each line and the earliest one with which it shares a word that is among the FIRST_WORDS least ones, by hash, of both
    prefixes; of these pairs those that may be similar: (x, y)."""
    line = ["id", "pos", "line", "size", *_ODD]
    rows = lines.select(F.explode(F.slice(F.sort_array("prefix"), 1, FIRST_WORDS)).alias("word"), *line)
    hubs = rows.groupBy("word").agg(F.min(F.struct(*line)).alias("x"), F.count("*").alias("n")).filter("n > 1")
    both = rows.select("word", *(F.col(c).alias(f"y{c}") for c in line)).join(hubs.select("word", *(F.col(f"x.{c}").alias(f"x{c}") for c in line)), "word")
    return both.filter("xline <> yline").filter(_fits(num, den, False)).select(F.col("xline").alias("x"), F.col("yline").alias("y"))


def _all_pairs(lines: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """Pairs (x, y) of lines, one of them open, that share a prefix word of this part and may be similar.

    x is the shorter line, or the one of smaller number. Two similar lines have num/(num+den) of their words in common, so
    their first common word, in the order of rarity, is found among fewer words of x than of y."""
    of_x = F.slice("prefix", 1, F.col("size") - F.ceil(F.col("size") * F.lit(2 * num) / (num + den)).cast("int") + 1)
    meta = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.shiftleft("place", 1)).bitwiseOR(F.col("open").cast("int"))  # fewer columns to shuffle

    def rows(words: Column, word: str, s: str) -> DataFrame:
        out = lines.select(F.posexplode(words).alias("place", word), "line", "size", "open", *_ODD).filter(F.col(word) % PASSES == part)
        return out.select(word, F.col("line").alias(s), meta.alias(f"{s}meta"), *(F.col(c).alias(s + c) for c in _ODD))

    both = rows(of_x, "word", "x").join(rows(F.col("prefix"), "same", "y"), F.col("word") == F.col("same"))
    both = both.filter(F.col("xmeta").bitwiseOR(F.col("ymeta")).bitwiseAND(1) == 1)
    for s in "xy":
        both = both.withColumns({f"{s}size": F.shiftright(f"{s}meta", 32), f"{s}place": F.shiftright(f"{s}meta", 1).bitwiseAND(0x7FFFFFFF)})
    both = both.filter((F.col("xsize") < F.col("ysize")) | ((F.col("xsize") == F.col("ysize")) & (F.col("x") < F.col("y"))))
    return both.filter(_fits(num, den, True)).select("x", "y")


def _later(pairs: DataFrame, lines: DataFrame, unique: DataFrame, num: int, den: int) -> DataFrame:
    """The later lines (line) of those pairs (x, y; distinct) whose word sets reach the threshold."""
    ends = pairs.select(F.col("x").alias("line")).union(pairs.select("y")).distinct()
    wanted = materialize(unique.select("line", "row", "id", "pos", "mark").join(_small(materialize(ends, "lines-ends")), "line"), "lines-wanted")
    held = lines.select("row", "words").join(_small(wanted), "row").select("line", "id", "pos", "mark", "words")
    sets = materialize(held, "lines-sets")  # row is one written line, also where a row of docs is repeated
    joined = pairs
    for s in "xy":
        joined = joined.join(sets.select(F.col("line").alias(s), F.struct("id", "pos", "mark").alias(f"{s}at"), F.col("words").alias(f"{s}words")), s)
    common = F.size(F.array_intersect("xwords", "ywords"))
    found = joined.filter(common * (num + den) >= (F.size("xwords") + F.size("ywords")) * num)
    return found.filter("xat <> yat").select(F.when(F.col("xat") < F.col("yat"), F.col("y")).otherwise(F.col("x")).alias("line")).distinct()


def later_lines(docs: DataFrame, num: int = 8, den: int = 10, least: int = MIN_WORDS) -> DataFrame:
    """(id, pos, mark) of every line with an earlier one of similarity num/den: id and mark tell the rows of docs, pos
    is the line's number."""
    numbered = line_sets(docs).withColumn("row", F.monotonically_increasing_id())
    lines = materialize(numbered, "lines-words", **{"parquet.dictionary.page.size": 16 << 20}).filter(F.col("n") >= max(1, least))
    classes = materialize(rarity(lines), "lines-classes")  # read by a subquery: as a constant, every description of the plan would spell it out
    sized = lines.select("key", "id", "pos", "mark", "row", "words", *_ODD, classes.scalar().alias("classes"))
    sized = sized.select("key", "id", "pos", "mark", "row", F.size("words").alias("size"), prefix("words", "classes", num, den).alias("prefix"), *_ODD)
    whole = [F.first(c).alias(c) for c in ("size", "prefix", *_ODD)]  # the same for all lines of a word set
    unique = sized.groupBy("key").agg(F.min(F.struct("id", "pos", "mark", "row")).alias("f"), F.count("*").alias("copies"), *whole)
    unique = materialize(unique.select(F.monotonically_increasing_id().alias("line"), "key", "f.*", "copies", "size", "prefix", *_ODD), "lines-unique")

    copied = materialize(unique.filter("copies > 1").select("key", F.struct("id", "pos", "mark").alias("first")), "lines-copied")
    again = lines.select("key", "id", "pos", "mark").join(_small(copied), "key").filter(F.struct("id", "pos", "mark") > F.col("first")).select("id", "pos", "mark")
    pairs = materialize(_first_pairs(unique, num, den).distinct(), "lines-first")
    near = materialize(_later(pairs, lines, unique, num, den), "lines-near")

    rest = unique.join(_small(near).withColumn("open", F.lit(False)), "line", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    parts = [materialize(_all_pairs(rest, num, den, part).distinct(), "lines-pairs") for part in range(PASSES)]
    pairs = materialize(reduce(DataFrame.union, parts).distinct(), "lines-pairs")
    near = materialize(near.union(_later(pairs, lines, unique, num, den)).distinct(), "lines-gone")
    return again.union(unique.join(_small(near), "line", "left_semi").select("id", "pos", "mark")).distinct()


def dedup_lines(docs: DataFrame, num: int = 8, den: int = 10, least: int = MIN_WORDS) -> DataFrame:
    """docs with the lines gone that are similar to an earlier line; adds n_lines, n_removed, removed (their numbers).

    docs: doc_id, text and any further columns, which are kept whatever their names (but for those three, which
    are replaced). Lines end at '\\n'. Two lines are similar if
    their sets of words (A-Z lower-cased, told apart by 64 bits of a hash) have Jaccard similarity num/den or
    more. Earlier means a smaller doc_id, then a smaller line number, then a smaller hash of the text; a null doc_id
    comes first. It does not matter whether the earlier line goes itself. Lines of fewer words than `least` (1 compares
    all that have words) and lines without words always stay. Null texts stay
    null with no lines; an empty text is one empty line. Rows that repeat both doc_id and text are one document
    and keep the same lines; different texts of one doc_id, or of none, are compared like any others. An empty table gives an empty result."""
    gone = later_lines(docs, num, den, least)
    lists = materialize(gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "lines-lists")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    rows = docs.select(F.struct(*names).alias("row"), *_keyed())
    out = rows.join(_small(lists, "size(gone)"), ["id", "mark"], "left")
    text, gone_ = F.col("row.text"), F.col("gone")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone_, i)), "\n")
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1, F.lit(0))
    new = F.struct(
        F.when(gone_.isNull(), text).otherwise(left).alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.array_size(gone_), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(gone_, F.array().cast("array<int>")).alias("removed"),
    )
    out = out.select("row", new.alias("new"))
    return out.select(*(F.col("new" if c == "text" else "row").getField(c).alias(c) for c in names), "new.n_lines", "new.n_removed", "new.removed")
