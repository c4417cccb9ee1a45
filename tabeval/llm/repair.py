"""Conversations brought into a legal order of turns with the fewest edits, by checkpointed dynamic programming.

A repaired conversation's role initials read ``(s?(ua)+)?``: nothing at all, or a system turn if there is one and then
user and assistant in turn. Each row is kept (K, 0), gets the other role of the two (R, 3) or is deleted
(D, 4); turns with empty text are inserted (I, 3) anywhere. Rows that are blank or repeat role and text of an
earlier row must go; a truncated row that stays costs 3 more. Of the cheapest edits the
ASCII-least sequence of initials is taken.

1. The only state between rows is what was written last: nothing, s, u or a. The cost to go from each of the four
   is a vector, and a row maps the vector behind it to the one before it.
2. Backwards, vectors are kept only at checkpoints, every square root of the number of rows; walking forward,
   each block's vectors are computed again from the checkpoint behind it, and the first letter of D, I, K, R
   that is tight (its cost and the cost to go make up the cost here) is taken.
3. A conversation of more than ``BLOCK`` rows is cut into fragments by edges from a bounded sample, fragments are
   checkpoints as well. A fragment is a 4 x 4 matrix of least costs; the vectors at fragment ends come from
   multiplying these backwards, a handful of numbers a fragment on the driver, whose
   number is at most two for every ``BLOCK`` rows. A second pass tells where a fragment leads from each of its four
   states, which gives its first state. The walk then needs one fragment in memory at a time.

Order: turn, missing ones first, then role, then SHA-256 of the text; rows equal in all of that are copies. A missing
role or text counts as one space, an empty role has no initial; roles with other initials than s, u and a are
never legal. Rows without a conversation form one of their own. An empty table gives an
empty result. Further columns of any name are left aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabeval.llm.common import SMALL_ROWS, SPACE_CHARACTERS, written
from tabeval.operators.ordered import find_ranges

#: What edits cost, and the marks that end a text.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
MARKS = ".!?"

BLOCK = 20_000
NEVER = 1 << 50

#: States: nothing written, s, u, a. What an inserted or rerolled turn leads to, and what may follow when kept.
NEXT = (2, 2, 3, 2)
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {2: "user", 3: "assistant"}
#: Cost to go behind the last row: an open pair is closed, a system turn alone gets a pair.
FINAL = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=100_000)
def _behind(vector: tuple, initial: str, fault: str) -> tuple:
    """The cost vector before a row from the one behind it."""
    best = []
    for q in range(4):
        least = DELETE + vector[q]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            least = min(least, REROLE + more + vector[NEXT[q]])
            if initial in FOLLOWS[q]:
                least = min(least, more + vector[FOLLOWS[q][initial]])
        best.append(least)
    # Up to two turns inserted before the row; a third would repeat the first.
    return tuple(min(best[q], INSERT + best[NEXT[q]], 2 * INSERT + best[NEXT[NEXT[q]]]) for q in range(4))


def _before(vector: tuple, rows: list[tuple[str, str]]) -> tuple:
    """The vector before a run of rows. Costs are taken down to their least, so that few vectors occur."""
    total = 0
    for initial, fault in reversed(rows):
        vector = _behind(vector, initial, fault)
        low = min(vector)
        if low:
            total += low
            vector = tuple(min(v - low, NEVER) for v in vector)
    return tuple(min(v + total, NEVER) for v in vector)


def fragment_matrix(rows: list[tuple[str, str]]) -> list[tuple]:
    """Per state behind the rows, the least cost to it from each state before them."""
    return [_before(tuple(0 if q == e else NEVER for q in range(4)), rows) for e in range(4)]


def walk(rows: list[tuple[str, str]], state: int, end: tuple, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """(letter, row, state after) of the ASCII-least tight edits, and the last state.

    ``end`` is the cost vector behind the rows; behind the ``last`` rows open pairs are closed.
    """
    size = max(1, math.isqrt(len(rows)))
    checkpoints = {len(rows): end}
    for first in range((len(rows) - 1) // size * size, -1, -size):
        checkpoints[first] = _before(checkpoints[min(first + size, len(rows))], rows[first : first + size])
    out = []
    for first in range(0, len(rows), size):
        block = rows[first : first + size]
        vectors = [checkpoints[first + len(block)]]
        for initial, fault in reversed(block):
            vectors.append(tuple(min(v, NEVER) for v in _behind(vectors[-1], initial, fault)))
        vectors.reverse()
        for k, (initial, fault) in enumerate(block):
            here, behind = vectors[k], vectors[k + 1]
            stays = fault not in ("blank", "duplicate")
            more = TRUNCATED if fault == "truncated" else 0
            while True:
                if here[state] == DELETE + behind[state]:
                    out.append(("D", first + k, state))
                    break
                if here[state] == INSERT + here[NEXT[state]]:
                    state = NEXT[state]
                    out.append(("I", first + k, state))
                    continue
                kept = FOLLOWS[state].get(initial) if stays else None
                if kept is not None and here[state] == more + behind[kept]:
                    state = kept
                    out.append(("K", first + k, state))
                else:
                    state = NEXT[state]
                    out.append(("R", first + k, state))
                break
    while last and FINAL[state]:
        state = NEXT[state]
        out.append(("I", len(rows), state))
    return out, state


def _fault(text: str, again: str) -> Column:
    """The first fault of a row: blank, duplicate, truncated, or none as an empty text."""
    solid = F.rtrim(F.col(text), F.lit(SPACE_CHARACTERS))
    return (
        F.when(solid == "", "blank").when(F.col(again), "duplicate")
        .when(F.right(solid, F.lit(1)).isin(list(MARKS)), "").otherwise("truncated")
    )


COLUMNS = ["conv", "fragment", "dated", "turn", "role", "print", "tie"]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """((conversation, fragment), its rows) from rows sorted so that they follow one another."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["conv"], row["fragment"])
            if key is not None and own != key:
                yield key, held
                held = []
            key = own
            held.append(row)
    if key is not None:
        yield key, held


def _coded(rows: list[dict]) -> list[tuple[str, str]]:
    return [(r["role"][:1], r["fault"]) for r in rows if r["present"]]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, fragment), rows in _fragments(batches):
        told = [list(v) for v in fragment_matrix(_coded(rows))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[0]["whole"]]), pa.array([fragment], pa.int32()), pa.array([told], pa.list_(pa.list_(pa.int64())))],
            names=["whole", "fragment", "told"],
        )


def _leads(ends: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, fragment), rows in _fragments(batches):
            whole, coded = rows[0]["whole"], _coded(rows)
            end, last = ends[whole, fragment]
            told = [walk(coded, q, end, last)[1] for q in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([whole]), pa.array([fragment], pa.int32()), pa.array([told], pa.list_(pa.int64()))],
                names=["whole", "fragment", "told"],
            )

    return run


def _repaired(known: dict, conv: pa.DataType, turn: pa.DataType):
    """A row per edit, in order. ``known`` has (first state, cost vector behind, whether last) of fragments of long conversations."""
    names = ["conv", "fragment", "place", "turn", "edit", "fault", "initial", "role", "text"]
    kinds = [conv, pa.int32(), pa.int64(), turn, *[pa.string()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, fragment), rows in _fragments(batches):
            present = [r for r in rows if r["present"]]
            coded = _coded(present)
            state, end, last = known.get((rows[0]["whole"], fragment), (0, FINAL, True))
            edits, _ = walk(coded, state, end, last)
            out = []
            for letter, at, after in edits:
                if letter == "I":
                    out.append((None, "I", None, None, ROLES[after], ""))
                    continue
                row, (initial, fault) = present[at], coded[at]
                role = ROLES[after] if letter == "R" else row["role"]
                out.append((row["turn"], letter, fault, initial, role, row["text"]))
            if not present:  # so that the conversation is known
                out.append((None, None, None, None, None, None))
            head = [[rows[0]["conv"]] * len(out), [fragment] * len(out), list(range(len(out)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip([*head, *zip(*out)], kinds)], names=names
            )

    return run


def _told(repaired, conv: pa.DataType):
    """One row a conversation from its edits in order; only running numbers, a running hash and the letters are held."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def close():
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            counts = [now["faults"].get(f, 0) for f in ("blank", "duplicate", "truncated")]
            done.append((now["conv"], gaps, *counts, now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names=names)

        for part in repaired(batches):
            columns = {c: part.column(c).to_pylist() for c in part.schema.names}
            conv = columns["conv"][0]
            if now is None or conv != now["conv"]:
                if now is not None:
                    close()
                if len(done) >= 1_000:
                    yield batch()
                    done = []
                now = {"conv": conv, "first": None, "last": None, "turns": 0, "faults": {}, "illegal": 0, "cost": 0,
                       "audit": [], "hash": hashlib.sha256(), "initial": None, "written": False}
            letters = []
            for turn, edit, fault, initial, role, text in zip(*(columns[c] for c in ("turn", "edit", "fault", "initial", "role", "text"))):
                if edit is None:
                    continue
                letters.append(edit)
                if fault is not None:  # a row of the input
                    if turn is not None and (now["last"] is None or turn != now["last"]):
                        now["first"] = turn if now["first"] is None else now["first"]
                        now["last"] = turn
                        now["turns"] += 1
                    now["faults"][fault] = now["faults"].get(fault, 0) + 1
                    now["illegal"] += now["initial"] is not None and (now["initial"], initial) not in legal
                    now["initial"] = initial
                now["cost"] += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
                now["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
                if edit != "D":
                    now["hash"].update((("\n" if now["written"] else "") + role + ":" + text).encode())
                    now["written"] = True
            now["audit"].append("".join(letters))
        if now is not None:
            close()
        if done:
            yield batch()

    return run


def _prepared(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows with their order, whether they repeat an earlier one, and a number for each row."""
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(turn).isNotNull().cast("int").alias("dated"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(True)) if present else F.lit(True)).alias("present"),
        F.monotonically_increasing_id().alias("tie"),
    ).withColumn("print", F.sha2("text", 256))
    rows = written(rows, "turns")
    place = F.struct("dated", "turn", "tie")
    first = rows.filter("present").groupBy("conv", "role", "print").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"), "first")
    few = first.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    keys = [rows[k].eqNullSafe(first[k]) for k in ("conv", "role", "print")]
    joined = rows.join(F.broadcast(first) if few else first, keys, "left")
    own = F.struct(rows["dated"], rows["turn"], rows["tie"])
    told = joined.select(rows["*"], (F.col("first").isNotNull() & ~own.eqNullSafe(F.col("first"))).alias("again"))
    return told.withColumn("fault", _fault("text", "again")).drop("again")


def _cut(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with ``whole`` and ``fragment``, and those of conversations with more than one fragment, if there are any.

    ``whole`` numbers the long conversations and is missing in all others.
    """
    long = rows.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    long = written(long.select("conv", F.monotonically_increasing_id().alias("whole")), "long")
    n = long.limit(SMALL_ROWS + 1).count()
    none = F.lit(None).cast("long")
    if not n:
        return rows.withColumn("whole", none).withColumn("fragment", F.lit(0)), None
    same = rows["conv"].eqNullSafe(long["conv"])
    marked = rows.join(F.broadcast(long) if n <= SMALL_ROWS else long, same, "left").select(rows["*"], "whole")
    order = ["conv", "dated", "turn", "role", "print", "tie"]
    theirs = marked.filter("whole is not null").withColumn("turn", F.coalesce("turn", F.lit(0)))
    edges = find_ranges(theirs, order, ranges=math.ceil(2 * theirs.count() / block))
    numbered = edges.number(marked.withColumn("given", F.col("turn")).withColumn("turn", F.coalesce("turn", F.lit(0))))
    fragment = F.when(F.col("whole").isNull(), 0).otherwise(F.col("_range")).cast("int").alias("fragment")
    kept = [c for c in marked.columns if c != "turn"]
    out = numbered.select(*kept, F.col("given").alias("turn"), fragment)
    return out, out.filter("whole is not null")


def _known(long: DataFrame | None) -> dict:
    """(first state, cost vector behind, whether last) of every fragment of the long conversations."""
    if long is None:
        return {}
    small = long.select(*COLUMNS, "whole", "present", "fault")
    dealt = small.repartition("conv", "fragment").sortWithinPartitions(*COLUMNS)
    shape = "whole long, fragment int, told "
    matrices = {(r["whole"], r["fragment"]): r["told"] for r in dealt.mapInArrow(_matrices, shape + "array<array<long>>").collect()}
    ends, following = {}, {}
    for whole, fragment in sorted(matrices, reverse=True):
        last = whole not in following
        end = FINAL if last else following[whole]
        ends[whole, fragment] = (end, last)
        told = matrices[whole, fragment]
        following[whole] = tuple(min(min(told[e][q] + end[e] for e in range(4)), NEVER) for q in range(4))
    leads = {(r["whole"], r["fragment"]): r["told"] for r in dealt.mapInArrow(_leads(ends), shape + "array<long>").collect()}
    known, state = {}, {}
    for whole, fragment in sorted(leads):
        first = state.get(whole, 0)
        known[whole, fragment] = (first, *ends[whole, fragment])
        state[whole] = leads[whole, fragment][first]
    return known


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def _solved(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None, block: int):
    rows, long = _cut(_prepared(df, conv, turn, role, text, present), block)
    known = _known(long)
    rows = rows.select(*COLUMNS, "whole", "present", "fault", "text")
    return rows, _repaired(known, _arrow_type(rows, "conv"), _arrow_type(rows, "turn"))


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """The edits, a row each: conv_id, fragment, place, turn, edit, fault, initial, role, text.

    In the order of fragment and place, the rows whose edit is not D are the repaired conversation; turn, fault and
    initial tell of the input's row and are missing in inserted ones.
    """
    rows, repaired = _solved(df, conv, turn, role, text, present, block)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    shape = f"conv {kinds['conv']}, fragment int, place long, turn {kinds['turn']}, edit string, fault string, initial string, role string, text string"
    dealt = rows.repartition("conv", "fragment").sortWithinPartitions(*COLUMNS)
    return dealt.mapInArrow(repaired, shape).filter("edit is not null").withColumnRenamed("conv", conv)


def repair_report(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``present`` names a boolean column; rows where it is false only make sure that their conversation
    is listed. The hash of a whole conversation runs through it in order, so its fragments pass through one
    task, one fragment in memory at a time.
    """
    rows, repaired = _solved(df, conv, turn, role, text, present, block)
    dealt = rows.repartition("conv").sortWithinPartitions(*COLUMNS)
    shape = (
        f"conv {rows.schema['conv'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, repaired_sha256 string"
    )
    return dealt.mapInArrow(_told(repaired, _arrow_type(rows, "conv")), shape).withColumnRenamed("conv", conv)


def damaged(df: DataFrame) -> DataFrame:
    """Rows with the damage their key draws, and ``present``: false for dropped ones.

    CRC-32 of ``conv_id:turn`` modulo 20 (missing values as one space): 0 drops the row, 1 empties its text, 2
    takes out full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.encode(F.concat(plain("conv_id"), F.lit(":"), plain("turn")), "utf-8")) % 20
    rows = df.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("draw") != 0).alias("present"), F.explode(times).alias("copy"),
    ).drop("copy")
