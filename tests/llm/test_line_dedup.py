import random
import re

import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import line_dedup as L
from talweg.llm.queries import op4_line_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def worded(text):
    return [(k, " ".join(w)) for k, x in enumerate((text or "").split("\n")) if (w := WORDS.findall(x))]


def windows(lines, least):
    """(i, j) of the shortest runs of ``least`` words from each line on, and of those up to each line."""
    out = set()
    for step in (1, -1):
        for i in range(len(lines)):
            j, total = i, 0
            while 0 <= j < len(lines):
                total += lines[j][1].count(" ") + 1
                if total >= least:
                    out.add((min(i, j), max(i, j)))
                    break
                j += step
    return sorted(out)


def brute(docs, least=50, runs=windows):
    """{doc_id: the set of line numbers to delete}; docs: {doc_id: text}."""
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        lines = worded(docs[d])
        for i, j in runs(lines, least):
            key = tuple(x for _, x in lines[i : j + 1])
            if key in seen:
                gone[d] |= set(range(lines[i][0], lines[j][0] + 1))
            seen.add(key)
    return gone


def all_runs(lines, least):
    for i in range(len(lines)):
        total = 0
        for j in range(i, len(lines)):
            total += lines[j][1].count(" ") + 1
            if total >= least:
                yield i, j


def test_windows_cover_all_repeated_runs():
    rng = random.Random(8)
    for _ in range(60):
        pool = [" ".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(6)]
        docs = {d: "\n".join(rng.choices(pool, k=rng.randint(0, 14))) for d in range(4)}
        assert brute(docs, 7) == brute(docs, 7, all_runs)


def test_tails_of_copies_go(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(40))
    texts = [f"{long}\n{short}", f"{long}\n{short}\nown", f"{short}\n{long}", f"{short}\nother"]
    rows = {r.doc_id: r.text for r in L.line_dedup(docs_frame(spark, texts)).collect()}
    assert rows == {0: texts[0], 1: "own", 2: short, 3: texts[3]}


def runs_in(numbers):
    return sum(n - 1 not in numbers for n in numbers)


def expected(docs, least):
    out = {}
    for d, gone in brute(docs, least).items():
        lines = (docs[d] or "").split("\n")
        left = docs[d] if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[d] = (len(lines) if docs[d] is not None else 0, len(gone), runs_in(gone), left)
    return out


def got(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in df.collect()}


@pytest.mark.parametrize("least", [1, 6, 50])
def test_matches_brute_force(spark, least):
    rng = random.Random(least)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 6))) for _ in range(12)]
    texts = ODD_TEXTS + ["\n".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(60)]
    docs = docs_frame(spark, texts).withColumn("runs", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("doc", F.lit(3)).repartition(3)
    assert got(L.line_dedup(docs, least)) == expected(dict(enumerate(texts)), least)


def test_every_shared_run_has_a_common_fingerprint():
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(40)]
    shared = rng.choices(pool, k=9)
    one, two = (("\n".join(rng.choices(pool, k=7) + shared + rng.choices(pool, k=7))).encode() for _ in range(2))
    a, b = ({(w[0], w[2]) for w in L.windows_of(t, 10)} for t in (one, two))
    assert a & b


def test_dropping(spark):
    passage = "\n".join(f"line {i} of the long passage that many documents have" for i in range(8))
    texts = [passage, f"own start\n{passage}\nown end", passage, "short\nshort\nshort", None, ""]
    docs = docs_frame(spark, texts).withColumn("rest", F.lit("mine")).withColumn("start", F.lit(5))
    rows = L.drop_repeated_runs(docs)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    kept = {r.doc_id: (r.text, r.n_chars, r.rest) for r in rows.collect()}
    assert kept == {0: (passage, len(passage), "mine"), 1: ("own start\nown end", 17, "mine"), 3: (texts[3], 17, "mine"), 4: (None, None, "mine"), 5: ("", 0, "mine")}


def test_ids_missing_or_repeated(spark):
    passage = "\n".join(f"line {i} of the long passage that many documents have" for i in range(8))
    rows = [(None, passage), (4, passage), (4, passage), (9, passage + "\nmore")]
    out = [(r.doc_id, r.n_removed) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(None, 8), (4, 0), (4, 0), (9, 8)], key=str)
    assert L.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_query_on_driver_table(spark):
    where = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    assert got(op4_line_dedup(spark, where)) == expected(docs, 50)
