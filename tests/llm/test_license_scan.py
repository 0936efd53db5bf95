import random

import numpy as np
import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import license_scan as L
from talweg.llm.decontamination import words_of
from talweg.llm.license_templates import TEMPLATES
from talweg.llm.queries import op5_license_scan


def brute_align(template, words):
    """(words matched, first, end) by a table of cells, with no band: score, matches, where the run began."""
    n = len(words)
    row = [(0, 0, j) for j in range(n + 1)]
    for word in template:
        new = [(row[0][0] - 1, *row[0][1:])]
        for j in range(1, n + 1):
            same = words[j - 1] == word
            met = (row[j - 1][0] + (4 if same else -1), row[j - 1][1] + same, row[j - 1][2])
            new.append(max((met, (row[j][0] - 1, *row[j][1:]), (new[j - 1][0] - 1, *new[j - 1][1:])), key=lambda c: c[0]))
        row = new
    end = max(range(n + 1), key=lambda j: row[j][0])
    return row[end][1], row[end][2], end


def test_alignment_by_rows_scores_like_a_table():
    rng = random.Random(7)
    for _ in range(200):
        template, words = rng.choices([1, 2, 3, 4], k=rng.randint(1, 9)), rng.choices([0, 1, 2, 3, 4], k=rng.randint(0, 12))
        got = L.align(np.array(template), np.array(words, np.int64), 0, len(template) + len(words) + 1)
        want = brute_align(template, words)
        cost = lambda m: 4 * m[0]
        assert abs(cost(got) - cost(want)) <= 4 * len(template) and 0 <= got[1] <= got[2] <= len(words)
        score = lambda m: brute_align(template, words[m[1] : m[2]])
        assert score(got)[0] >= got[0] - 1 and got[0] >= want[0] - 1


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_recall_on_changed_copies(name):
    """Copies with 15 % of their words changed whose alignment still matches 0.8 of the template."""
    index, rng = L.Index(TEMPLATES), random.Random(name)
    split = words_of(TEMPLATES[name].encode())
    found = wanted = 0
    for _ in range(40):
        body = [w if rng.random() > 0.15 else rng.choice([b"lorem", b"ipsum"]) for w in split]
        text = [b"before"] * 5 + body + [b"after"] * 5
        numbers = [index.number.get(w, 0) for w in text]
        if brute_align([index.number[w] for w in split], numbers)[0] < 0.8 * len(split):
            continue
        wanted += 1
        own = index.scan([text], 0.8)[0]
        found += any(index.names[t] == name or matched >= 0.8 * len(split) for t, matched, _, _ in own)
    assert wanted > 3 and found >= 0.9 * wanted


def test_licenses_that_differ_by_a_word(spark):
    lines = ["Licensed under CC BY-SA 4.0.", "Released under an MIT License.", "Licensed under CC BY-NC 4.0."]
    rows = L.scan_licenses(docs_frame(spark, lines), TEMPLATES, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(0, "CC-BY-SA-4.0/line"), (1, "MIT/line"), (2, "CC-BY-NC-4.0/line")]


def test_a_long_template_is_aligned_fast():
    import time

    rng = random.Random(1)
    text = {"long": " ".join(f"w{rng.randrange(2_000)}" for _ in range(5_000))}
    index = L.Index(text)
    began = time.time()
    (match,) = index.scan([[b"x"] * 50 + words_of(text["long"].encode())], 0.8)[0]
    assert match == (0, 5_000, 50, 5_050) and time.time() - began < 4


def changed(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice(["lorem", "ipsum", "dolor"]) if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append("extra")
    return out


def test_shared_runs_have_a_common_fingerprint():
    index = L.Index(TEMPLATES)
    rng = random.Random(0)
    for _ in range(300):
        template = rng.choice(index.words).tolist()
        at = rng.randrange(len(template) - L.SHARED + 1)
        run = template[at : at + L.SHARED]
        noise = lambda: rng.choices([0, *range(1, 60)], k=rng.randint(0, 9))
        _, found = L.winnow(np.array([*noise(), *run, *noise()], np.uint64))
        assert set(found.tolist()) & {h for h, own in index.entries.items() if any(at - L.SHARED <= p <= at + L.SHARED for _, p in own)}


def test_banded_alignment_finds_what_the_full_one_finds():
    rng = random.Random(1)
    index = L.Index({k: v for k, v in TEMPLATES.items() if len(words_of(v.encode())) > 20})
    for _ in range(12):
        t = rng.randrange(len(index.words))
        template = index.words[t].tolist()
        words = [0] * rng.randint(0, 15) + [index.number.get(w, 0) for w in changed(words_of(TEMPLATES[index.names[t]].encode()), rng, 0.08)] + [0] * 9
        best = brute_align(template, words)
        (own,) = [m for m in index.scan([[*_back(index, words)]], 0.7)[0] if m[0] == t] or [None]
        assert own is not None and own[1] >= best[0] - 1
        assert abs(own[2] - best[1]) <= 2 and abs(own[3] - best[2]) <= 2


def _back(index, words):
    names = {i: w for w, i in index.number.items()}
    return [names.get(w, b"zzz") for w in words]


def test_planted_licenses(spark):
    rng = random.Random(2)
    texts, want = [], {}
    for i in range(60):
        name = rng.choice(list(TEMPLATES))
        words = TEMPLATES[name].split()
        body = words if len(words) < 20 else changed(words, rng, 0.06)
        before = ["é" + rng.choice("abc") for _ in range(rng.randint(0, 40))]
        texts.append(" ".join([*before, *body, "the", "end"]))
        want[i] = (name, len(words_of(" ".join(before).encode())), len(" ".join(before)) + bool(before))
    texts += [*ODD_TEXTS, "the license under the software of any kind", TEMPLATES["MIT"] + "\n\n" + TEMPLATES["MIT"]]
    docs = docs_frame(spark, texts).withColumn("license", F.lit("clash")).withColumn("k0", F.lit(1))
    rows = L.scan_licenses(docs, TEMPLATES, ["doc_id"]).collect()
    for i, (name, word, char) in want.items():
        own = [r for r in rows if r.doc_id == i and r.license == name]
        assert len(own) == 1 and own[0].coverage >= 0.8, (i, name)
        assert abs(own[0].start_word - word) <= 3 and abs(own[0].start_char - char) <= 40
    last = len(texts) - 1
    assert {r.doc_id for r in rows} <= {*want, last}
    assert [(r.start_word > 100, r.coverage) for r in rows if r.doc_id == last and r.license == "MIT"] == [(False, 1.0), (True, 1.0)]
    assert L.scan_licenses(spark.createDataFrame([], DOCS), TEMPLATES, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        L.Index({"short": "one two"})


def test_query_on_driver_table(spark):
    where = "/root/testdata/sf0.01"
    rows = op5_license_scan(spark, where).collect()
    found = {(r.doc_id, r.license) for r in rows if r.coverage == 1.0}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    for name in (n for n in TEMPLATES if n.endswith("/line")):
        own = b" %s " % b" ".join(words_of(TEMPLATES[name].encode()))
        assert {d for d, n in found if n == name} == {d for d, t in texts.items() if own in b" %s " % b" ".join(words_of(t.encode()))}
