import hashlib
import random

import numpy as np
import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import suffix_dedup as S
from talweg.llm.queries import op9_suffix_dedup


def brute(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}; docs: {doc_id: text}."""
    seen, out = set(), {}
    for d in sorted(docs):
        body = (docs[d] or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - length + 1):
            s = body[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[d] = (len(body), int(gone.sum()), spans, bytes(b for b, g in zip(body, gone, strict=False) if not g))
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def planted(seed):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [new(n) for n in (99, 100, 101, 130, 400, 70)]
    texts = []
    for _ in range(40):
        parts = [new(rng.randint(0, 60)) for _ in range(3)]
        texts.append("".join(p + rng.choice(shared) for p in parts) + new(5))
    return texts + [texts[3], texts[3][7:], "ab" * 300, "b" + "ab" * 200, "\x00" * 150 + "x", "x" * 250]


def test_interval_expansion_parts_what_differs():
    rng = np.random.default_rng(0)
    for length in (7, 8, 20, 100):
        codes = rng.integers(1, 4, 400)
        codes[rng.integers(0, 400, 8)] = 0
        codes[200:320] = codes[60:180]
        codes[-1] = 0
        order, seeds = S.suffix_order(codes, length)
        parted = S.parted_below(codes, order, seeds, length)
        for slot in range(1, len(order)):
            a, b = codes[order[slot - 1] :][:length].tolist(), codes[order[slot] :][:length].tolist()
            assert a <= b
            if 0 not in a and 0 not in b and len(a) == len(b) == length:
                assert parted[slot] == (a != b)


def test_segments_hold_every_string_once():
    texts = [t.encode() for t in planted(1)] + [b"", b"short"]
    owner, start, run, anchor = S.segments_of(texts)
    strings = {}
    for o, s, r, a in zip(owner, start, run, anchor, strict=True):
        assert 1 <= r <= S.RUN_MASK + 1
        for i in range(s, s + r):
            assert (o, i) not in strings
            strings[o, i] = a
            assert len(texts[o][i : i + 100]) == 100
    assert len(strings) == sum(max(0, len(t) - 99) for t in texts)
    by = {}
    for (o, i), a in strings.items():
        assert by.setdefault(texts[o][i : i + 100], a) == a  # equal strings have equal anchors


@pytest.mark.parametrize("hot", [1, 2, S.HOT])
def test_matches_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(S.repeated_spans, "__defaults__", (S.LENGTH, hot))
    texts = [*ODD_TEXTS, *planted(hot)]
    docs = docs_frame(spark, texts).withColumn("doc", F.lit("clash")).withColumn("anchor", F.lit(1)).withColumn("spans", F.lit(2)).repartition(3)
    assert got(S.remove_repeats(docs)) == brute(dict(enumerate(texts)))


def test_ids_missing_or_repeated(spark):
    body = "".join(random.Random(0).choices("abcdefgh", k=180))
    rows = [(None, body), (4, body), (4, body), (4, "other " + body[:120]), (None, "tiny")]
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    one, other = [x for x in out if x[:2] == (4, 180)], [x for x in out if x[:2] == (4, 126)]
    assert len(out) == 5 and (None, 180, 180) in out and (None, 4, 0) in out
    assert sorted([x[2] for x in one + other]) in ([0, 0, 120], [0, 120, 120])
    assert S.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_without_ids_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "text_mark", lambda body="body": F.lit(7).cast("long"))  # every mark clashes
    rng = random.Random(3)
    alone = ["".join(rng.choices("abcdefgh ", k=150)) for _ in range(6)]
    shared = "".join(rng.choices("abcdefgh ", k=140))
    texts = [*alone, "one " + shared, "two " + shared]
    rows = [(None, t) for t in texts] + [(9, "id:" + shared[:120])]
    found = {bytes(r.kept).decode(): r.n_removed for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[t] == 0 for t in alone)
    assert found["id:" + shared[:120]] == 0
    assert sorted(found.values()) == [0] * 7 + [120, 141]


def test_query_on_driver_table(spark):
    where = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    want = {d: (n, r, s, hashlib.sha256(k).hexdigest()) for d, (n, r, s, k) in brute(docs).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, where).collect()} == want
