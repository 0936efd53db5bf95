import re

import pytest
import xxhash
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import simhash as S
from talweg.llm.queries import op6_simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, size=3):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    """fps: {doc_id: fingerprint}."""
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    items = sorted(fps.items())
    for i, (d, f) in enumerate(items):
        for e, g in items[:i]:
            if (f ^ g).bit_count() <= radius:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d in fps}


def test_fingerprints(spark):
    texts = [*ODD_TEXTS, "Two words", "TWO WORDS", "a b c", "a  b\tc d"]
    docs = docs_frame(spark, texts).withColumn("fp", F.lit("clash")).withColumn("k0", F.lit(1))
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in S.fingerprints(docs, ["doc_id"]).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("radius", [0, 2])
def test_edges_connect_what_all_pairs_connect(spark, radius):
    base = 0x0123456789ABCDEF
    values = {base} | {base ^ (1 << b) for b in range(0, 64, 3)} | {base ^ (7 << b) for b in range(0, 60, 7)} | {0, 1, 3, 7, (1 << 64) - 1}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    nodes = {r.node: r.root for r in S.connected_components(S.near_edges(fps, radius)).collect()}
    signed = {v: (v - (1 << 64) if v >> 63 else v) for v in values}
    want = brute_components({s: v for v, s in signed.items()}, radius)
    assert {s: nodes.get(s, s) for s in signed.values()} == want


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(5, 5), (3, 9), (9, 3), (8, 3), (70, 60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in S.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_defined_cases(spark):
    rows = [(3, "x y z w"), (1, "x Y z w"), (None, "x y z w"), (7, None), (9, ""), (9, ""), (4, "other words here entirely different")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(0)).withColumn("gone_id", F.lit(1))
    got = sorted([(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()], key=str)
    assert got == sorted([(3, 1), (1, 1), (None, None), (7, 7), (9, 7), (9, 7), (4, 4)], key=str)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == [1, 4, 7, None]
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query_on_driver_table(spark):
    where = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    components = brute_components(fps)
    rows = op6_simhash(spark, where).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", components[d]) for d in docs}
    assert len(rows) == len(docs)
