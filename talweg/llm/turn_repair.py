"""Repair of the structure of conversations: cheapest edits to a legal sequence of turns.

A conversation's rows, by turn, are edited until their roles read ``(s?(ua)+)?``: an optional system turn, then pairs
of user and assistant, or nothing. Keep costs 0, a new role (user or assistant) 1, deletion 2 and the insertion of an
empty turn 5; a truncated row that is not deleted adds 5, blank and duplicate rows have to go. The cost still to pay
from a row on depends on the grammar's state alone, so it is computed backwards; then a walk forwards takes, of the
edits that keep to that cost, the one whose initial is least in ASCII (Delete, Insert, Keep, Rerole).

No conversation has to fit into a task. Rows are sorted into ranges by conversation and turn, and what a range holds
of a conversation is a piece. Backwards, a piece is its (min, +) matrix of costs between the four states; matrices of
a conversation's pieces, at most one a range, give the cost behind each piece. Forwards, a piece maps each state that
it may begin with to the audit and the state that it ends with, and these maps are chained. Only the hash of a
conversation's text reads all its turns in one task, one by one, since SHA-256 knows no other way.

Defined cases: a null conversation, turn, role or text counts as one space where text is made of it; rows whose
conv_id is null are one conversation; turns that are null come first; rows of one turn are ordered by role and text;
rows that repeat another entirely are one row with a count until edits are written; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.session import stored

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = STATES = range(4)  # what was read last; START and ASSISTANT may end
FAR = 1 << 60
#: The state that a user or assistant turn leads to from each state, which is the only one that fits there.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost and edits that are left when the rows are at their end.
END_COST, END_EDITS = (0, 10, 5, 0), ("", "II", "I", "")
FINE, TRUNCATED, FORCED = 0, 1, 2  # kinds of rows; FORCED ones are blank or duplicates
DELETE_COST, INSERT_COST, ROLE_COST, TRUNCATED_COST = 2, 5, 1, 5


# --- damage ------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): rows with faults by a hash of their place, nulls written as a space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault"))
    return rows.filter("fault <> 0").select(
        "conv",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


# --- rows in order -----------------------------------------------------------------------------------------------


def ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different rows (conv, turn, role, text, copies) with their range ``block`` and place ``seq``, and what they are.

    The second table has ``initial`` (of the role), ``kind``, and ``blank``, ``again`` (role and text seen in an earlier
    row) and ``cut`` (truncated), which are not exclusive, in place of role and text.
    """
    merged = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    keys = [F.col("conv"), F.col("turn"), F.col("role"), F.substring("text", 1, 64)]
    laid = merged.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    bare = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    laid = stored(
        laid.select(
            "*",
            F.spark_partition_id().alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.sha2("text", 256).alias("digest"),
            (bare == "").alias("blank"),
            (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        )
    )
    first = laid.groupBy("conv", "role", "digest").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(*[F.col(c).alias(f"f_{c}") for c in ("conv", "role", "digest")], "first")
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    again = F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    slim = laid.drop("text").join(first, same, "left").withColumn("again", again)
    kind = F.when(F.col("blank") | F.col("again"), FORCED).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    return laid, slim.select("conv", "block", "seq", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), "copies", "blank", "again", "cut")


# --- costs and edits ---------------------------------------------------------------------------------------------


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn of that role, or None where it doesn't fit."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def cost_before(after: list[int], initial: str, kind: int, copies: int) -> list[int]:
    """The cost still to pay before a row and its copies, by state, from the cost ``after`` them."""
    costs = []
    for state in STATES:
        # the copies but the first are duplicates, so is a forced row's first
        cost = DELETE_COST + after[state]
        if kind != FORCED:
            extra = TRUNCATED_COST if kind == TRUNCATED else 0
            if (to := kept_state(state, initial)) is not None:
                cost = min(cost, extra + after[to])
            cost = min(cost, ROLE_COST + extra + after[NEXT[state]])
        costs.append(cost)
    return [DELETE_COST * (copies - 1) + min(costs[s], INSERT_COST + min(costs[NEXT[s]], INSERT_COST + costs[NEXT[NEXT[s]]])) for s in STATES]


def matrix_of(rows: list[tuple[str, int, int]]) -> list[int]:
    """Costs from every state before the rows (initial, kind, copies) to every state behind them, row by row."""
    columns = []
    for end in STATES:
        costs = [0 if s == end else FAR for s in STATES]
        for row in reversed(rows):
            costs = cost_before(costs, *row)
        columns.append(costs)
    return [min(columns[end][s], FAR) for s in STATES for end in STATES]


def before_piece(matrix: list[int], after: list[int]) -> list[int]:
    return [min(FAR, *(matrix[4 * s + end] + after[end] for end in STATES)) for s in STATES]


def walks(rows: list[tuple[str, int, int]], after: list[int]) -> list[tuple[str, int]]:
    """(edits, last state) of the cheapest, least walk over the rows from each state; ``after`` is the cost behind."""
    costs = [list(after)]
    for row in reversed(rows):
        costs.append(cost_before(costs[-1], *row))
    costs.reverse()
    found = []
    for begin in STATES:
        state, edits = begin, []
        for i, (initial, kind, copies) in enumerate(rows):
            rest = DELETE_COST * (copies - 1)
            now, later = costs[i], costs[i + 1]
            while True:
                extra = TRUNCATED_COST if kind == TRUNCATED else 0
                if now[state] == DELETE_COST + rest + later[state]:
                    edits.append("D")
                elif now[state] == INSERT_COST + now[NEXT[state]]:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                elif (to := kept_state(state, initial)) is not None and now[state] == extra + rest + later[to]:
                    edits.append("K")
                    state = to
                else:
                    edits.append("R")
                    state = NEXT[state]
                break
            edits.append("D" * (copies - 1))
        found.append(("".join(edits), state))
    return found


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows whose first ``keys`` columns are equal; the rows without the key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


PIECE = "matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def pieces(rows: DataFrame) -> DataFrame:
    """One row for each conversation and range: the matrix of costs, counts, and what stands at the ends."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), own in _groups(batches, 2):
            counts, illegal, turns, last, low, high = [0, 0, 0], 0, 0, None, None, None
            for _, turn, initial, _, copies, blank, again, cut in own:
                if blank:
                    counts[0] += copies
                else:
                    counts[1] += copies - (not again)
                    counts[2] += cut and not again
                illegal += (copies - 1) + (last is not None and last + initial not in ("su", "ua", "au"))
                last = initial
                if turn is not None and turn != high:
                    turns, low, high = turns + 1, turn if low is None else low, turn
            matrix = matrix_of([(r[2], r[3], r[4]) for r in own])
            values = [conv, block, matrix, *counts, illegal, own[0][2], last, low, high, turns]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds, strict=True)], schema=kinds)

    conv = rows.schema["conv"].dataType.simpleString()
    kinds = _arrow(rows, f"conv {conv}, block int, {PIECE}")
    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "seq").mapInArrow(summed, f"conv {conv}, block int, {PIECE}")


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, blocks array<int>, after array<array<long>>"


def summaries(pieces_: DataFrame) -> DataFrame:
    """One row for each conversation: counts, least cost, and for each of its pieces the costs behind it."""
    names = ["matrix", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"]

    def combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                after, illegal, turns = [list(END_COST)], 0, 0
                for p in reversed(own):
                    after.append(before_piece(p["matrix"], after[-1]))
                for a, b in zip(own, own[1:], strict=False):
                    illegal += a["last"] + b["first"] not in ("su", "ua", "au")
                    turns -= a["high"] is not None and a["high"] == b["low"]
                turns += sum(p["turns"] for p in own)
                lows, highs = ([p[k] for p in own if p[k] is not None] for k in ("low", "high"))
                gaps = max(highs) - min(lows) + 1 - turns if lows else 0
                sums = [sum(p[k] for p in own) for k in ("blank", "duplicate", "truncated")]
                cost = after.pop()[START]
                out.append((conv, gaps, *sums, illegal + sum(p["illegal"] for p in own), cost, [p["block"] for p in own], after[::-1]))
            yield _batch(out, kinds)

    conv = pieces_.schema["conv"].dataType.simpleString()
    ddl = f"conv {conv}, {SUMMARY}"
    kinds = _arrow(pieces_, ddl)
    # a conversation has one piece a range at most, so a list is as long as there are ranges
    lists = pieces_.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", *names))).alias("own"))
    return lists.mapInArrow(combined, ddl)


def audits(rows: DataFrame, summaries_: DataFrame) -> DataFrame:
    """(conv, block, audit): the edits of each piece, in order."""

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), own in _groups(batches, 2):
            found = walks([r[1:4] for r in own[1:]], own[0][4])
            yield _batch([(conv, block, [e for e, _ in found], [s for _, s in found])], middle)

    def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = START
                for k, p in enumerate(own):
                    edits, state = p["edits"][state], p["states"][state]
                    out.append((conv, p["block"], edits + (END_EDITS[state] if k == len(own) - 1 else "")))
            yield _batch(out, last)

    conv = rows.schema["conv"].dataType.simpleString()
    middle_ddl, last_ddl = f"conv {conv}, block int, edits array<string>, states array<int>", f"conv {conv}, block int, audit string"
    middle, last = _arrow(rows, middle_ddl), _arrow(rows, last_ddl)
    behind = summaries_.select("conv", F.explode(F.arrays_zip("blocks", "after")).alias("p")).select("conv", F.col("p.blocks").alias("block"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("initial"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), F.col("p.after").alias("after"))
    slim = rows.select("conv", "block", "seq", "initial", "kind", "copies", F.lit(None).cast("array<long>").alias("after"))
    walks_ = slim.unionByName(behind).repartition("conv", "block").sortWithinPartitions("conv", "block", "seq").mapInArrow(walked, middle_ddl)
    return walks_.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "edits", "states"))).alias("own")).mapInArrow(chained, last_ddl)


def repaired_turns(rows: DataFrame, audits_: DataFrame) -> DataFrame:
    """(conv, seq, part, edit, role, text) of every turn left, in the order of ``seq`` and ``part``."""

    def rebuilt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, held = "", 0, []

        def inserted(seq: int) -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                held.append((conv, seq, at, "I", None, ""))
                at += 1

        conv, seq = None, -1
        for batch in batches:
            for conv_, _, seq_, role, text, copies, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    inserted(seq)  # what stands behind the last row of the conversation before
                    conv, edits, at, seq = conv_, audit, 0, seq_
                    continue
                seq = seq_
                inserted(seq)
                if edits[at] != "D":
                    held.append((conv, seq, at, edits[at], role if edits[at] == "K" else None, text))
                at += copies
            yield _batch(held, kinds)
            held.clear()
        inserted(seq)
        yield _batch(held, kinds)

    conv = rows.schema["conv"].dataType.simpleString()
    ddl = f"conv {conv}, seq long, part int, edit string, role string, text string"
    kinds = _arrow(rows, ddl)
    first = audits_.select("conv", "block", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    both = rows.select("conv", "block", "seq", "role", "text", "copies", F.lit(None).cast("string").alias("audit")).unionByName(first)
    return both.repartition("conv", "block").sortWithinPartitions("conv", "block", "seq").mapInArrow(rebuilt, ddl)


def text_hashes(turns: DataFrame) -> DataFrame:
    """(conv, sha): the hash of ``role:text`` of a conversation's turns, joined by newlines, read one by one.

    A turn without a role is a user's or an assistant's, whichever the turn before leaves open.
    """

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun, conv, sha = START, False, None, None
        for batch in batches:
            out = []
            for conv_, _, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_ != conv:
                    if begun:
                        out.append((conv, sha.hexdigest()))
                    state, begun, conv, sha = START, True, conv_, hashlib.sha256()
                    new = True
                if role is None:
                    role = "assistant" if state == USER else "user"
                state = SYSTEM if role[:1] == "s" else NEXT[state]
                sha.update(f"{'' if new else '\n'}{role}:{text}".encode())
                new = False
            yield _batch(out, kinds)
        if begun:
            yield _batch([(conv, sha.hexdigest())], kinds)

    ddl = f"conv {turns.schema['conv'].dataType.simpleString()}, sha string"
    kinds = _arrow(turns, ddl)
    return turns.select("conv", "seq", "part", "role", "text").repartition("conv").sortWithinPartitions("conv", "seq", "part").mapInArrow(hashed, ddl)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (conv, turn, role, text, copies) repaired: (summaries, audits, turns), as above."""
    texts, rows = ordered(conversations)
    found = stored(summaries(pieces(rows)))
    edits = stored(audits(rows, found))
    return found, edits, repaired_turns(texts, edits)


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of the table, damaged first: counts, cost, audit and the hash of the repaired text."""
    found, edits, turns = repair(damaged(conversations))
    whole = edits.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda p: p.audit), "").alias("audit"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = conversations.select("conv_id").distinct()
    for part, columns in ((found, numbers), (whole, ["audit"]), (text_hashes(turns), ["sha"])):
        own = part.select(F.col("conv").alias("p_conv"), *columns)
        out = out.join(own, F.col("conv_id").eqNullSafe(F.col("p_conv")), "left").drop("p_conv")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
