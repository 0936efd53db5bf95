import random
import re

import corpus_pipeline
import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import near_copies as N

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_pairs(docs):
    """Pairs of ids with a five-word Jaccard similarity of 0.8 or more; docs: {doc_id: text}."""
    sets, holders, common = {}, {}, {}
    for d, t in docs.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for ids in holders.values():
        for i, b in enumerate(ids):
            for a in ids[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    return [(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]


def roots_of(docs, pairs):
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d: find(d) for d in docs}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_edited_copies_go_from_the_pipeline(spark):
    rng = random.Random(1)
    base = [f"word{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base), edited(rng, base, 3), edited(rng, base, 40), "Another text, of few words"]
    docs = docs_frame(spark, texts)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {0, 2, 3}


@pytest.mark.parametrize(("rounds", "block"), [(0, 4), (2, 7), (2, N.BLOCK)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(N, "ROUNDS", rounds)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PAIRS_A_ROW", 0)
    rng = random.Random(2)
    texts = list(ODD_TEXTS)
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts += [edited(rng, base, rng.randint(0, 6)) for _ in range(25)]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = docs_frame(spark, texts).withColumn("node", F.lit("clash")).withColumn("gone_id", F.lit(1)).repartition(3)
    want = roots_of(docs, brute_pairs(docs))
    assert {r.doc_id: r.root for r in N.near_roots(frame).collect()} == {d: r for d, r in want.items() if r != d}
    kept = N.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d in docs if want[d] == d)


@pytest.mark.parametrize("block", [3, 1_000])
def test_pairs_are_made_once(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [edited(rng, base, 1) for _ in range(20)]
    rows = N.marked(docs_frame(spark, texts))
    placed = rows.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"), "n", "sketch", F.posexplode("bands").alias("k", "band"))
    met = [(min(r.node, r.node_), max(r.node, r.node_)) for r in N._met_once(placed, rows).select("node", "node_").collect()]
    shared = {r.doc_id: r.bands for r in rows.collect()}
    want = {(a, b) for a in shared for b in shared if a < b and any(x == y for x, y in zip(shared[a], shared[b], strict=True))}
    assert len(want) > 50 and sorted(met) == sorted(want)


def test_near_fingerprints_of_all_shingles_link(spark, monkeypatch):
    met_once = N._met_once
    monkeypatch.setattr(N, "_met_once", lambda placed, rows: met_once(placed, rows).filter("false"))  # the balls alone
    monkeypatch.setattr(N, "ROUNDS", 0)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(9000)}" for _ in range(3_000)] for _ in range(3)]
    texts = [edited(rng, words, n) for words in base for n in (0, 1, 1, 2, 900)]
    fps = [N.fingerprint_of(N.shingle_set(t.encode())) for t in texts]
    near = [(a, b) for a, b in brute_pairs(dict(enumerate(texts))) if (fps[a] ^ fps[b]).bit_count() <= N.RADIUS]
    want = {d: r for d, r in roots_of(dict(enumerate(texts)), near).items() if r != d}
    assert len(want) > 3 and {r.doc_id: r.root for r in N.near_roots(docs_frame(spark, texts)).collect()} == want


def test_recall_on_driver_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    pairs = brute_pairs(docs)
    marks = {d: N.marks_of(N.shingle_set((docs[d] or "").encode())) for p in pairs for d in p}
    bands = {d: set(m[0]) for d, m in marks.items()}
    bits = lambda sketch: [tuple(sketch[p * N.LONGS + i] >> b & 1 for p in range(N.PLANES)) for i in range(N.LONGS) for b in range(64)]
    unlike = lambda a, b: sum(x != y for x, y in zip(bits(marks[a][1]), bits(marks[b][1]), strict=True))
    found = [bool(bands[a] & bands[b]) and unlike(a, b) <= N.SKETCH - N.ALIKE for a, b in pairs if bands[a]]
    assert len(pairs) > 50 and found and all(found)
    got = {r.doc_id: r.root for r in N.near_roots(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == {d: r for d, r in roots_of(docs, pairs).items() if r != d}


def test_defined_cases(spark):
    rows = [(3, "x y z w"), (1, "x Y z w"), (None, "x y z w"), (7, None), (9, ""), (9, ""), (4, "other words here")]
    kept = N.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 4, 7, None]
    assert N.keep_first(spark.createDataFrame([], DOCS)).count() == 0
