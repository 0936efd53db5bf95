import re

import pytest
from corpus_cases import DOCS, LABELS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import quality_rules as Q
from talweg.llm.queries import op7_quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    starts = {}
    for i in range(len(words) - 4):
        starts.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in starts.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark):
    got = Q.text_statistics(docs_frame(spark, ODD_TEXTS), ["doc_id"]).collect()
    assert len(got) == len(ODD_TEXTS)
    for row in got:
        assert tuple(row[c] for c in Q.STATISTICS) == brute(ODD_TEXTS[row.doc_id]), row.doc_id


def test_query_on_driver_table(spark):
    where = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_quality_rules(spark, where).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = want = brute(texts[r.doc_id])
        assert tuple(r[c] for c in Q.STATISTICS) == want
        assert r.base_failed == (n_words < 10 or 100 * n_repeat > 20 * n_words)
        assert not (r.base_failed and r.kept)


def test_learns_a_planted_rule(spark):
    clean = [f"word{i} other{i} text{i} more{i} plain{i} and{i} so{i} on{i} it{i} goes{i} here{i}" for i in range(120)]
    bad = [t.replace(" ", " ###") for t in clean]
    docs = docs_frame(spark, clean + bad)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], LABELS)
    got = {r.doc_id: r.kept for r in Q.quality_verdicts(docs, labels).collect()}
    assert all(got[i] for i in range(120))
    assert not any(got[i] for i in range(120, 240))


def test_held_out_labels(spark):
    """Rules learned on two thirds of the labelled documents judge the others."""
    where = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    rows = Q.quality_verdicts(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    rows = [r for r in rows if not r.base_failed]
    rejected = [r.quality for r in rows if not r.kept]
    bad, good = (sum(r.quality == q for r in rows) for q in (0, 1))
    assert bad > 5 and good > 50
    assert rejected.count(0) >= 0.85 * bad and rejected.count(1) <= 0.02 * good


@pytest.mark.parametrize("labelled", [[], [(None, 1, 0), (0, None, 0), (99, 0, 0)], [(4, 1, 0)] * 3])
def test_defined_without_usable_labels(spark, labelled):
    docs = docs_frame(spark, ODD_TEXTS).withColumn("n_words", F.lit("clash")).withColumn("bad", F.lit(1)).withColumn("kept", F.lit(1))
    rows = Q.quality_verdicts(docs, spark.createDataFrame(labelled, LABELS)).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(r.kept != r.base_failed for r in rows)
    assert Q.quality_verdicts(spark.createDataFrame([], DOCS), spark.createDataFrame(labelled, LABELS)).count() == 0


def test_stays_native(spark):
    plan = Q.text_statistics(docs_frame(spark, ["a"]), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
