import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from talweg.llm import turn_repair as R
from talweg.llm.queries import op12_turn_repair

KINDS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired turns) by uniform-cost search over whole strings of edits, least string first."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        state = (i, roles[-2:] if len(roles) > 2 and roles[0] != "s" else roles[:1] + "|" + roles[-1:])
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, turns
        if (state, cost, audit) in done or len(roles) > len(rows) + 4:
            continue
        done.add((state, cost, audit))
        fits = lambda r: re.fullmatch("s?(ua)*u?", r) is not None
        for role in ("user", "assistant"):
            if fits(roles + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*turns, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, turns))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role and fits(roles + role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*turns, (role, text))))
                for new in ("user", "assistant"):
                    if fits(roles + new[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + new[0], (*turns, (new, text))))
    raise AssertionError


def brute(table, repaired=cheapest):
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted((r for r in damage(table) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, left = repaired(rows, faults)
        body = "\n".join(f"{role}:{text}" for role, text in left)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", "u", None])
            text = rng.choice(["One.", "Two!", "no end", " \t", "", None, f"Said {rng.randint(0, 99)}?", "same. \n"])
            rows.append((conv, rng.choice([turn, turn + 2, None]), role, text))
    return rows + [(None, 3, "user", "A."), (None, 4, "assistant", "B."), (n, None, None, None)] + [rows[0]] * 3


def test_matches_brute_force(spark):
    rows = made(0, 60)
    table = spark.createDataFrame(rows, KINDS).withColumn("seq", F.lit("clash")).withColumn("block", F.lit(1)).repartition(5)
    assert got(R.conversation_repairs(table)) == brute(rows)


def test_conversations_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "No", f"Well {t}.", f"So {t}", ""])) for t in range(400)]
    rows += [(8, t, "user", "Same.") for t in range(40)] + [(6, 0, "user", "x" * 50_000 + ".")]

    def serial(own, faults):
        plain = [(r[2][:1], R.FORCED if f in ("blank", "duplicate") else R.TRUNCATED if f else R.FINE, 1) for r, f in zip(own, faults, strict=True)]
        edits, state = R.walks(plain, list(R.END_COST))[R.START]
        left, role_state, i = [], R.START, 0
        for e in edits + R.END_EDITS[state]:
            if e != "D":
                new = "assistant" if role_state == R.USER else "user"
                role, text = ("" if e == "I" else own[i][2], "" if e == "I" else own[i][3])
                role = role if e == "K" else new
                role_state = R.SYSTEM if role[0] == "s" else R.NEXT[role_state]
                left.append((role, text))
            i += e != "I"
        cost = {"D": 2, "I": 5, "K": 0, "R": 1}
        extra, i = 0, 0
        for e in edits:
            extra += 5 * (e in "KR" and faults[i] == "truncated")
            i += e != "I"
        return sum(cost[e] for e in edits + R.END_EDITS[state]) + extra, edits + R.END_EDITS[state], left

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, KINDS).repartition(3)
        texts, _ = R.ordered(R.damaged(table))
        assert texts.filter("conv = 7").select("block").distinct().count() > 3
        assert got(R.conversation_repairs(table)) == brute(rows, serial)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_matrices_of_pieces_chain():
    rng = random.Random(2)
    rows = [(rng.choice(["s", "u", "a", "t", ""]), rng.choice([R.FINE, R.FINE, R.TRUNCATED, R.FORCED]), rng.choice([1, 1, 3])) for _ in range(40)]
    whole = R.before_piece(R.matrix_of(rows), list(R.END_COST))
    middle = R.before_piece(R.matrix_of(rows[25:]), list(R.END_COST))
    assert R.before_piece(R.matrix_of(rows[:25]), middle) == whole
    for start in R.STATES:
        edits, state = R.walks(rows, list(R.END_COST))[start]
        head, between = R.walks(rows[:25], middle)[start]
        tail, end = R.walks(rows[25:], list(R.END_COST))[between]
        assert (edits, state) == (head + tail, end)


def test_turns_are_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Are you there?"), (1, 2, "assistant", "Yes.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv long, turn long, role string, text string, copies int")
    _, edits, turns = R.repair(table)
    assert [r.audit for r in edits.collect()] == ["DKK"]
    assert [(r.edit, r.role, r.text) for r in turns.orderBy("seq", "part").collect()] == [("K", "user", "Are you there?"), ("K", "assistant", "Yes.")]


def test_empty(spark):
    assert got(R.conversation_repairs(spark.createDataFrame([], KINDS))) == {}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_on_driver_table(spark, scale):
    where = f"/root/testdata/{scale}"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_turn_repair(spark, where)) == brute(rows)
