import hashlib
import re

import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import decontamination as D
from talweg.llm.queries import op2_decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1):
            if w:
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


TEXTS = [*ODD_TEXTS, LONG, f"x {LONG.upper()} y", f"{LONG[6:]}", f"É ü {LONG} " * 2, "before short item after", "short-ITEM", LONG.rsplit(" ", 3)[0]]
ITEMS = [(1, LONG), (2, "short item"), (10, "Short  ITEM!"), (3, ""), (4, None), (5, "é"), (1, LONG)]


@pytest.mark.parametrize("block", [1, 3, 500_000])
def test_matches_brute_force(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_frame(spark, TEXTS).withColumn("spans", F.lit(1)).withColumn("k0", F.lit("x")).withColumn("body", F.lit(2))
    got = {r.doc_id: r for r in D.find_contamination(docs, items, ["doc_id"], block_windows=block).collect()}
    want = brute(TEXTS, [(str(i), t) for i, t in ITEMS])
    assert len(got) == len(TEXTS)
    for k, (n, hit, found) in enumerate(want):
        assert (got[k].n_words, sum(s.end - s.start for s in got[k]["spans"]), sorted(got[k]["items"])) == (n, hit, found), k


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    rows = D.find_contamination(docs_frame(spark, ODD_TEXTS), empty, ["doc_id"]).collect()
    assert len(rows) == len(ODD_TEXTS) and not any(r.spans or r["items"] for r in rows)
    assert D.find_contamination(spark.createDataFrame([], DOCS), empty, ["doc_id"]).count() == 0


def test_removal_keeps_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_frame(spark, TEXTS).withColumn("n_words", F.lit("mine")).withColumn("was_null", F.lit(7))
    clean = D.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r for r in clean.collect()}
    bad = {k for k, (n, hit, _) in enumerate(brute(TEXTS, [(str(i), t) for i, t in ITEMS])) if hit and 20 * hit >= n}
    assert set(kept) == set(range(len(TEXTS))) - bad and bad
    assert all(r.text == TEXTS[k] and r.n_words == "mine" for k, r in kept.items())
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert cut[len(ODD_TEXTS) + 1] == "x  y" and cut[0] is None and cut[3] == "one" and cut[len(ODD_TEXTS) + 4] == "before  after"


def test_query_on_driver_table(spark):
    where = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    want = dict(zip(texts, brute(texts.values(), items), strict=True))
    rows = op2_decontamination(spark, where).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
