import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import passage_dedup as P
from talweg.llm.queries import op13_passage_dedup
from talweg.llm.word_index import WaveletTree, WordIndex

WHITE = b" \t\n\x0b\x0c\r"


def brute(docs, window=20):
    """{doc_id: (n_words, n_removed, kept)}; docs: {doc_id: text}."""
    seen, out = set(), {}
    for d in sorted(docs):
        words = (docs[d] or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone[i : i + window] = True
            seen.add(own)
        out[d] = (len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect()}


def planted(seed):
    rng = random.Random(seed)
    new = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(n))
    shared = [new(n) for n in (19, 20, 21, 45, 200, 15)]
    texts = []
    for _ in range(50):
        parts = [new(rng.randint(0, 40)) + rng.choice(" \n\t") for _ in range(3)]
        texts.append("".join(p + rng.choice(shared) + "\x0b\r " for p in parts) + new(5))
    blob = "x" * 5_000
    return texts + [texts[3], texts[3][30:], "a b " * 90, "b " + "a b " * 50, f"{new(12)} {blob} {shared[1]}", f"{blob} {shared[3]} {blob}y", f"{blob} {shared[3]} {blob}"]


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sigma, depth = int(rng.integers(3, 40)), int(rng.integers(1, 6))
        texts = [rng.integers(1, sigma, int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 8)))]
        index = WordIndex(np.concatenate([np.append(t, 0) for t in texts]).astype(np.int64), sigma, depth)
        streams = [np.where(rng.random(n) < 0.1, -1, rng.integers(1, sigma, n)) for n in rng.integers(0, 30, 5)]
        have = {tuple(t[i : i + k]) for t in texts for k in range(1, depth + 1) for i in range(len(t) - k + 1)}
        want = [max(k for k in range(depth + 1) if i + k <= len(s) and (not k or tuple(s[i : i + k]) in have)) for s in streams for i in range(len(s))]
        assert index.matches(np.concatenate(streams), np.cumsum([len(s) for s in streams])).tolist() == want
        seen, again = set(), []
        for t in texts:
            for i in range(len(t) + 1):
                own = tuple(t[i : i + depth])
                again.append(len(own) == depth and own in seen)
                seen.add(own)
        assert index.own_repeats().tolist() == again


def test_single_places_take_no_ranks(monkeypatch):
    taken = []
    for name in ("rank", "rank_there"):
        if old := getattr(WaveletTree, name, None):
            monkeypatch.setattr(WaveletTree, name, lambda tree, values, at, old=old: taken.append(len(at)) or old(tree, values, at))
    text = np.append(np.arange(1, 61), 0)
    stream = np.concatenate([np.arange(11, 51), [-1], np.arange(5, 30)])
    assert WordIndex(text, 61, 20).matches(stream, np.array([len(stream)])).tolist() == [*[20] * 21, *range(19, 0, -1), 0, *[20] * 6, *range(19, 0, -1)]
    assert sum(taken) == 0


def test_shards_hold_hot_blocks_of_different_anchors():
    kinds = {"anchor": pa.int64(), "salt": pa.int32(), "hot": pa.bool_(), "doc": pa.int64(), "place": pa.int64(), "body": pa.binary()}
    groups = [(1, 0, 3), (2, 1, 2), (2, 3, 2), (3, 0, 4), (4, 2, 3), (5, 0, 30), (6, 0, 2), (7, 0, 2)]
    rows = [(a, s, s > 0, i, 0, b"one text" if a == 5 else b"%d" % i) for a, s, n in groups for i in range(n)]
    for size in (1, 4, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kinds, r, strict=True)) for r in rows[i : i + size]], pa.schema(list(kinds.items()))) for i in range(0, len(rows), size)]
        got = list(P.shards(batches, 20, 10_000, 20))
        assert [tuple(r.values()) for t in got for r in t.to_pylist()] == rows
        # only the second block of anchor 2 and what follows more than 20 rows open another
        assert [list(dict.fromkeys(t.column("anchor").to_pylist())) for t in got] == [[1, 2], [2, 3, 4, 5], [6, 7]]
    assert [t.num_rows for t in P.shards(batches, 20, 1, 10**6)] == [n for *_, n in groups]


def test_words_and_numbers():
    text = "one  two\x0bone é two " + "z" * 33 + " " + "z" * 31 + " " + "abcdefgh" * 4 + " abcdefgh abcdefg"
    flat = np.frombuffer(text.encode(), np.uint8)
    begins, ends = P.word_bounds(flat)
    words = [flat[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
    assert words == text.encode().split()
    numbers, limit = P.word_numbers(flat, begins, ends)
    assert len(set(zip(words, numbers, strict=True))) == len(set(words)) == len(set(numbers.tolist())) and numbers.max() < limit


def test_clashing_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(P, "word_hashes", lambda flat, begins, ends: np.full(len(begins), 5, np.uint64))
    flat = np.frombuffer(b"one two one six", np.uint8)
    assert P.word_numbers(flat, *P.word_bounds(flat))[0].tolist() == [1, 2, 1, 3]


def test_segments_hold_every_window_once():
    texts = [t.encode() for t in planted(1)] + [b"", b"short"]
    by, seen = {}, set()
    for o, s, r, a in zip(*P.segments_of(texts), strict=True):
        assert 1 <= r <= P.RUN_MASK + 1
        words = texts[o].split()
        for i in range(s, s + r):
            assert (o, i) not in seen and len(words[i : i + 20]) == 20
            seen.add((o, i))
            assert by.setdefault(tuple(words[i : i + 20]), a) == a  # equal windows have equal anchors
    assert len(seen) == sum(max(0, len(t.split()) - 19) for t in texts)


@pytest.mark.parametrize("hot", [1, 3, P.HOT])
def test_matches_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(P.repeated_places, "__defaults__", (P.WINDOW, hot))
    monkeypatch.setattr(P, "SHARD_WORDS", 500 * hot)
    texts = [*ODD_TEXTS, *planted(hot)]
    docs = docs_frame(spark, texts).withColumn("doc", F.lit("clash")).withColumn("anchor", F.lit(1)).withColumn("spans", F.lit(2)).repartition(3)
    assert got(P.remove_repeats(docs)) == brute(dict(enumerate(texts)))


def test_many_variants_of_one_passage(spark):
    rng = random.Random(5)
    line = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(120):
        own = line.copy()
        own[rng.randint(0, 8)] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(own))
    assert got(P.remove_repeats(docs_frame(spark, texts))) == brute(dict(enumerate(texts)))


def test_ids_missing_or_repeated(spark):
    body = " ".join(random.Random(0).choices("abcdefgh", k=60))
    rows = [(None, body), (4, body), (4, body), (4, "other " + " ".join(body.split()[:30])), (None, "tiny")]
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in P.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert len(out) == 5 and (None, 60, 60) in out and (None, 1, 0) in out
    assert sorted(x[2] for x in out if x[0] == 4) in ([0, 0, 30], [0, 30, 30], [0, 0, 30])
    assert P.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_on_driver_table(spark, scale):
    where = f"/root/testdata/{scale}"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    want = {d: (n, r, hashlib.sha256(k).hexdigest()) for d, (n, r, k) in brute(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op13_passage_dedup(spark, where).collect()} == want
