"""Repair of conversation structure at least cost, by dynamic programming with square-root checkpoints.

Rows get a position by one range sort over all conversations, so that a long conversation is dealt to many tasks.
Each row becomes one letter (its role's initial and its first fault); a conversation is a string of them, as long
as the audit it gets. The cheapest repair from each of four states to the end is computed backward; only every
square root of the rows is its vector of costs kept. Walking forward, one block's vectors at a time are computed again,
and of the edits that keep to the least cost the ASCII-least is taken.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm._common import materialize, small_batches

#: Rows of a run, the piece of a conversation that is one letter string before its runs are joined.
RUN = 1024
#: Costs: keep, new role, delete, insert; a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Role initials and faults, in the order of their digits in a letter.
INITIALS, FAULTS = "suax", ("none", "blank", "duplicate", "truncated")
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the state after an inserted or re-roled row, and after a kept one (-1: not allowed).
TURN = (USER, USER, ASSISTANT, USER)
AFTER_KEEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1), "x": (-1,) * 4}
FAR = 1 << 60
LETTERS = "ABCDEFGHIJKLMNOP"


def _relax(v: list[int]) -> list[int]:
    """Costs once rows may be inserted before whatever comes next."""
    for _ in range(3):
        v = [min(v[s], INSERT + v[TURN[s]]) for s in range(4)]
    return v


def _step(letter: int, after: list[int]) -> list[int]:
    """Costs from each state before a row, from those after it; insertions before the row included."""
    fault = letter % 4
    best = [DELETE + x for x in after]
    if fault not in (1, 2):
        more = TRUNCATED * (fault == 3)
        keep = AFTER_KEEP[INITIALS[letter // 4]]
        for s in range(4):
            best[s] = min(best[s], REROLE + more + after[TURN[s]])
            if keep[s] >= 0:
                best[s] = min(best[s], KEEP + more + after[keep[s]])
    return _relax(best)


END = _relax([0, FAR, FAR, 0])


def repair(letters: str) -> tuple[int, list[str]]:
    """Cost and, for each row, its edits: letters of the audit, an inserted row as I before the row's own; what is
    inserted after the last row goes with it. An edit that makes a row of the other role is marked by the role's initial.

    Memory: the letters, the edits and 2 sqrt(n) vectors of four costs."""
    n = len(letters)
    if not n:
        return 0, []
    codes = [LETTERS.index(c) for c in letters]
    block = max(1, math.isqrt(n))
    stops = list(range(block, n, block))
    marks, v = {n: END}, END
    for i in range(n - 1, -1, -1):
        v = _step(codes[i], v)
        if i % block == 0:
            marks[i] = v
    cost, state, out = v[START], START, []
    for lo, hi in zip([0, *stops], [*stops, n]):
        ahead = [marks[hi]]
        for i in range(hi - 1, lo, -1):
            ahead.append(_step(codes[i], ahead[-1]))
        ahead.append(marks[lo])
        ahead.reverse()  # ahead[j]: costs before row lo + j
        for i in range(lo, hi):
            now, after, code, edits = ahead[i - lo], ahead[i - lo + 1], codes[i], ""
            fault, keep = code % 4, AFTER_KEEP[INITIALS[code // 4]]
            more = TRUNCATED * (fault == 3)
            while True:
                at = now[state]
                if at == DELETE + after[state]:
                    edits += "D"
                    break
                if at == INSERT + now[TURN[state]]:
                    state = TURN[state]
                    edits += "I" + INITIALS[state - 1]
                    continue
                if keep[state] >= 0 and at == KEEP + more + after[keep[state]]:
                    state = keep[state]
                    edits += "K"
                else:
                    state = TURN[state]
                    edits += "R" + INITIALS[state - 1]
                break
            out.append(edits)
    while state not in (START, ASSISTANT):
        state = TURN[state]
        out[-1] += "I" + INITIALS[state - 1]
    return cost, out


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    for batch in batches:
        rows = []
        for letters in batch.column("letters").to_pylist():
            cost, edits = repair(letters)
            codes = np.frombuffer(letters.encode(), np.uint8) - ord("A")
            first = [INITIALS[c // 4] for c in codes]
            count = np.bincount(codes % 4, minlength=4)
            rows.append((int(count[1]), int(count[2]), int(count[3]), sum(p not in legal for p in zip(first, first[1:])), cost, edits))
        names = ["blank", "duplicate", "truncated", "illegal", "cost"]
        kept = [batch.column(c) for c in ("conv_id", "gaps", "runs")]
        yield pa.record_batch([*kept, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), pa.array([r[5] for r in rows], pa.list_(pa.string()))], ["conv_id", "gaps", "runs", *names, "edits"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of each conversation, in the order of a sorted partition; only its state is kept."""
    now, running, begun, rows = None, None, False, []
    for batch in batches:
        for conv, lines in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist()):
            if conv != now or running is None:
                if running is not None:
                    rows.append((now, running.hexdigest()))
                now, running, begun = conv, hashlib.sha256(), False
            for line in lines:
                running.update((b"\n" if begun else b"") + line.encode())
                begun = True
        if len(rows) > 1000:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["conv", "sha"])
            rows = []
    if running is not None:
        rows.append((now, running.hexdigest()))
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv", "sha"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` names: of 20 parts one loses the row (text and
    role null, `there` false), one the text, one its sentence ends, one repeats the row, one makes it the user's.
    Nulls of role and text are one space, nulls of the ids too where the number is made."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    there = F.col("what") != 0
    return d.select("conv_id", "turn", F.when(there, role).alias("role"), F.when(there, text).alias("text"), there.alias("there"), F.explode(copies).alias("_copy")).drop("_copy")


def _letter(role: Column, fault: Column) -> Column:
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return F.substring(F.lit(LETTERS), (initial * 4 + fault + 1).cast("int"), F.lit(1))


def repair_conversations(rows: DataFrame, label: str = "conversations") -> DataFrame:
    """rows: conv_id, turn, role, text (`there` false for a row that only names its conversation) -> a row for each conv_id.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows go by turn, nulls first; rows of
    one turn by role and text. Rows alike in all columns are interchangeable. A null conv_id is a conversation
    of its own; null role and text are one space. A conversation without rows has zeros, an empty audit and the hash of nothing.

    A conversation's audit is one value, so its letters and edits are held together in one task; texts are not: they
    pass by one at a time. SHA-256 runs over a conversation's lines in order, so that step reads each conversation in one task.
    """
    spark = rows.sparkSession
    small_batches(spark)
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), there.alias("there"))
    d = d.withColumn("digest", F.when(F.col("there"), F.md5(F.col("text").cast("binary"))))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    d = d.withColumn("again", F.row_number().over(seen) > 1)
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    blank = F.length(bare) == 0
    fault = F.when(blank, 1).when(F.col("again"), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    d = d.withColumn("letter", F.when(F.col("there"), _letter(F.col("role"), fault)))
    order = [F.asc_nulls_first("conv_id"), F.desc("there"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(width, *order, "again").sortWithinPartitions(*order, "again").withColumn("pos", F.monotonically_increasing_id())
    d = materialize(d.select("conv_id", "turn", "role", "text", "there", "letter", "pos"), f"{label}-rows")

    run = d.groupBy("conv_id", F.floor(F.col("pos") / RUN).alias("run"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", "letter")))), lambda x: x["letter"]), "")
    runs = run.agg(F.min(F.when(F.col("there"), F.col("pos"))).alias("first"), F.count(F.when(F.col("there"), 1)).alias("n"), letters.alias("letters"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("first", "n", "letters")))).alias("all"))
    turns = d.filter("there AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.sum("one")).alias("gaps"))
    asked = whole.alias("w").join(turns.alias("t"), F.expr("w.conv_id <=> t.conv_id"), "left").select("w.conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.transform("all", lambda x: F.struct(x["first"].alias("first"), x["n"].alias("n"))).alias("runs"), F.array_join(F.transform("all", lambda x: x["letters"]), "").alias("letters"))
    counts = "blank long, duplicate long, truncated long, illegal long, cost long"
    made = materialize(asked.mapInArrow(_repairs, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, runs array<struct<first: bigint, n: bigint>>, {counts}, edits array<string>"), f"{label}-repairs")
    made = made.withColumn("conv", F.get("runs", F.lit(0))["first"])

    at = F.flatten(F.transform("runs", lambda x: F.sequence(x["first"], x["first"] + x["n"] - 1)))
    edits = made.filter(F.size("edits") > 0).select("conv", F.explode(F.arrays_zip(at.alias("pos"), F.col("edits").alias("edit"))).alias("x")).select("conv", "x.pos", F.col("x.edit").alias("edit"))
    steps = F.transform(F.regexp_extract_all("edit", F.lit("[IR][ua]|[DK]"), 0), lambda m: F.when(m == "D", F.lit(None).cast("string"))
        .when(m == "K", F.concat_ws(":", "role", "text"))
        .otherwise(F.concat(F.when(F.substring(m, 2, 1) == "u", "user").otherwise("assistant"), F.lit(":"), F.when(F.substring(m, 1, 1) == "R", F.col("text")).otherwise(""))))
    lines = edits.join(d.select("pos", "role", "text"), "pos").select("conv", "pos", F.array_compact(steps).alias("lines")).filter(F.size("lines") > 0)
    sha = lines.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_digests, "conv long, sha string")
    audit = F.regexp_replace(F.array_join("edits", ""), "[ua]", "")
    return made.join(sha, "conv", "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
