import random
import re
import zlib
from collections import Counter

import pytest
from corpus_cases import DOCS, ODD_TEXTS, docs_frame
from pyspark.sql import functions as F

from talweg.llm import spelling_variants as S
from talweg.llm.queries import op11_spelling_variants

LOWER = str.maketrans(S.UPPER, S.LOWER)


def brute_vocabulary(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += len(run) >= 7
    return {w: n for w, n in seen.items() if n >= 2}


def brute_near(words):
    """{word: set of near words} by all words with one letter marked or taken out."""
    near, marked, cut = {w: set() for w in words}, {}, {}
    for w in words:
        for i in range(len(w)):
            marked.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            cut.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for same in marked.values():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for x in cut.get(w, ()):
            near[w].add(x)
            near[x].add(w)
    return near


def brute(docs):
    words = brute_vocabulary(docs)
    near, form, out = brute_near(words), {}, {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        if best and -best[0] >= 10 * n:
            form[w] = best[1]
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(rng, base, n):
    letters = "abcdé"
    words = {base}
    while len(words) < n:
        w = rng.choice(sorted(words))
        i = rng.randint(0, len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return [w for w in words if len(w) >= 7]


@pytest.mark.parametrize("size", [1, 5, 40, 10_000])
def test_near_words_against_brute_force(spark, size):
    rng = random.Random(size)
    words = sorted({*variants(rng, "abcabcab", 300), *variants(rng, "aaaaaaaa", 80), *("".join(rng.choices("abc", k=rng.randint(7, 8))) for _ in range(500)), "a" * 3_000, "a" * 3_001, "b" + "a" * 2_999})
    table = spark.createDataFrame([(w, rng.randint(2, 50)) for w in words], "word string, n long").repartition(3)
    counts = {r.word: r.n for r in table.collect()}
    near = brute_near(words)
    found = {r.word: (r.n_near, r.best and (r.best.n, r.best.word)) for r in S.near_words(table, size).collect()}
    assert found == {w: (len(near[w]), min(((-counts[x], x) for x in near[w]), default=None) and (lambda b: (-b[0], b[1]))(min((-counts[x], x) for x in near[w]))) for w in words}


def test_light_edges_halve():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(7, 12))) for _ in range(2_000)})
    whole = S.light_edges(words, ({d: Counter(w[d] for w in words if w.startswith(words[0][:d]) and len(w) > d).most_common(1)[0][0] for d in range(len(words[0]))}, {d: Counter(w[d] for w in words if w.startswith(words[-1][:d]) and len(w) > d).most_common(1)[0][0] for d in range(len(words[-1]))}))
    above = Counter(k for first, stop, _, _ in whole for k in range(first, stop))
    assert max(above.values()) <= 11  # the logarithm of 2,000


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    pool = variants(rng, "spelling", 120) + ["Straßenbahn", "STRASSENBAHN", "Ünterwegs", "naïveté×÷"]
    weights = [1000 // (k + 1) + 1 for k in range(len(pool))]
    texts = [*ODD_TEXTS, *(" ".join(rng.choices(pool, weights, k=200)) for _ in range(40)), "x" * 40_000, "x" * 40_000]
    docs = docs_frame(spark, texts)
    extra = spark.createDataFrame([(None, "abcdefgh Abcdefgh"), (3, "abcdefgh"), (3, "abcdefgh")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra).withColumn("word", F.lit(1)).withColumn("n", F.lit("clash")).repartition(3)
    rows = [*enumerate(texts), (None, "abcdefgh Abcdefgh"), (3, "abcdefgh"), (3, "abcdefgh")]
    assert got(S.spelling_variants(table)) == brute(rows)


def test_chains_of_forms(spark):
    words = {"abcdefgh": 20_000, "abcdefg": 2_000, "abcdefgx": 3, "abcdefxx": 2, "bcdefgx": 30}
    rows = S.grouped(S.near_words(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r.word: (r.form, r.root) for r in rows.collect()} == {"abcdefgh": (None, "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdefgx": ("abcdefgh", "abcdefgh"), "abcdefxx": (None, "abcdefxx"), "bcdefgx": (None, "bcdefgx")}
    chain = {"a" * (7 + k): 2 * 10**k for k in range(9)}
    assert {r.root for r in S.grouped(S.near_words(spark.createDataFrame(list(chain.items()), "word string, n long"), 2)).collect()} == {"a" * 15}


def test_empty(spark):
    assert got(S.spelling_variants(spark.createDataFrame([], DOCS))) == {}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_on_driver_table(spark, scale):
    where = f"/root/testdata/{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert got(op11_spelling_variants(spark, where)) == brute(rows)
