import math
import random
import zlib

import numpy as np
import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import language_id as I
from talweg.llm import tokens
from talweg.llm.queries import op10_language_id

FILE = tokens.vocabulary("piece_bpe_32k.model")
SMALL = I.Vocabulary(["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "ba", "X", "<0x41>", "▁▁"])


def brute(word, chance):
    """The sum over all segmentations, and the expected uses of each piece, by enumeration."""
    total, uses = 0.0, np.zeros(len(chance))

    def walk(rest, p, used):
        nonlocal total, uses
        if not rest:
            total += p
            for i in used:
                uses[i] += p
            return
        for k in range(1, len(rest) + 1):
            i = SMALL.number.get(rest[:k], 0 if k == 1 else None)
            if i is not None:
                walk(rest[k:], p * chance[i], [*used, i])

    walk("▁" + word, 1.0, [])
    return total, uses / total


def test_sums_over_all_segmentations():
    rng = random.Random(0)
    words = ["a", "b", "abc", "xa", "abcabca", "é", "zz"] + ["".join(rng.choices("abcx", k=rng.randint(1, 9))) for _ in range(40)]
    chance = np.random.default_rng(0).dirichlet(np.ones(len(SMALL.pieces)), 3).T
    logs = SMALL.log_chances(words, chance)
    counts = np.arange(1, len(words) + 1).astype(float)
    uses = sum(n * brute(w, chance[:, 0])[1] for w, n in zip(words, counts, strict=True))
    for i, w in enumerate(words):
        for lang in range(3):
            assert math.isclose(math.exp(logs[i, lang]), brute(w, chance[:, lang])[0], rel_tol=1e-9)
        assert np.allclose(SMALL._log_chance_of_long("▁" + w, chance), logs[i])
    assert np.allclose(SMALL.expected_uses(words, counts, chance[:, 0]), uses)


@pytest.mark.parametrize("least", [1e-3, 5e-9, 1e-14])
def test_no_word_underflows(least):
    chance = np.full((len(SMALL.pieces), 2), least)
    chance[SMALL.number["a"], 1] = 0.5
    words = ["ab" * 5_000, "a" * 41, "a" * 40, "é" * 40, "é" * 39 + "a", "é", "é" * 3_000]
    logs = SMALL.log_chances(words, chance)
    assert np.isfinite(logs).all() and (logs < 0).all()
    for word, own in zip(words, logs, strict=True):
        assert np.allclose(SMALL._log_chance_of_long("▁" + word, chance), own)
    assert logs[3, 0] == logs[3, 1] and math.isclose(logs[3, 0], 41 * math.log(least), rel_tol=1e-9)
    assert logs[4, 1] > logs[4, 0]
    uses = SMALL.expected_uses(["é" * 40, "a" * 40], np.ones(2), chance[:, 0])
    assert np.isfinite(uses).all() and math.isclose(uses[0], 40, rel_tol=1e-9)


def test_letters_of_no_language(spark):
    rng = random.Random(4)
    long, short = ([" ".join("".join(rng.choices(letters, k=5)) for _ in range(n)) for _ in range(40)] for letters, n in (("abcde", 400), ("vwxyz", 10)))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "aa") for t in long] + [(t, "zz") for t in short])]
    odd = ["\U0001208a" * 40, "\U0001208a" * 40 + " wxyz vwxyz", "abc 漢字漢字 \U0001208a", "漢" * 100]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in I.identify(docs).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[1001][0] == "zz" and got[1002][0] == "aa"
    assert max(got[1000][1], got[1003][1]) < 0.9  # only how words begin tells the languages apart
    blocks = {r.doc_id: (r.lang_pred, r.score) for r in I.identify(docs, at_once=1).collect()}
    assert {d: v[0] for d, v in blocks.items()} == {d: v[0] for d, v in got.items()}
    assert all(math.isclose(blocks[d][1], got[d][1], rel_tol=1e-9) for d in got)


def test_piece_lookup_matches_the_vocabulary():
    known = I.vocabulary(FILE)
    words = ["straße", "l", "überall", "nation", "漢字", "žluťoučký"]
    _, found = known.matches(words)
    got = sorted((int(w), j, k, int(p)) for j, own in enumerate(found) for k, (ws, ps) in enumerate(own, 1) for w, p in zip(ws, ps, strict=True))
    want = []
    for w, word in enumerate(words):
        marked = "▁" + word
        for j in range(1, len(marked) + 1):
            for k in range(1, min(j, known.longest) + 1):
                piece = known.number.get(marked[j - k : j], 0 if k == 1 else None)
                if piece is not None:
                    want.append((w, j, k, piece))
    assert got == sorted(want)


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    rows = op10_language_id(spark, where).join(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and len(held) > 150


@pytest.mark.parametrize("lang", ["en", None])
def test_defined_cases(spark, lang):
    texts = [*ODD_TEXTS, "12 34 !!", "x" * 30_000]
    docs = docs_frame(spark, texts, lang).withColumn("score", F.lit("clash")).withColumn("k0", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in I.identify(docs).collect()}
    for i, t in enumerate(texts):
        letters = any(c.isalpha() for c in t or "")
        assert got[i] == (("en", 1.0) if letters and lang else ("und", 0.0))
    assert I.identify(spark.createDataFrame([], DOCS)).count() == 0
    lost = spark.createDataFrame([(None, "words", "en", "s", 1), (1, "words", "en", "s", 1)], DOCS)
    assert [(r.doc_id, r.held_out) for r in I.identify(lost).collect()] == [(None, False), (1, zlib.crc32(b"1") % 5 == 0)]
