import corpus_pipeline
from corpus_cases import LABELS, docs_frame
from pyspark.sql import functions as F
from test_decontamination import brute as brute_hits
from test_line_dedup import expected as brute_lines
from test_near_copies import brute_pairs, roots_of
from test_packing import brute_pieces, check_packing
from test_quality_rules import brute as brute_statistics

WHERE = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet").withColumn("n_words", F.lit("clash")).withColumn("runs", F.col("doc_id"))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect()]
    whole = [name for name, _ in corpus_pipeline.STAGES]
    assert whole == ["quality", "lines", "near_copies", "benchmark", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = texts(docs), stage(spark, docs, WHERE)
        out.cache()
        after = texts(out)
        assert out.columns == docs.columns and out.count() == len(after)
        assert all(r.n_words == "clash" and r.runs == r.doc_id and r.n_chars == len(r.text) for r in out.collect())
        if name == "quality":
            stats = {d: brute_statistics(t) for d, t in before.items()}
            assert all(d not in after for d, s in stats.items() if s[0] < 10 or 100 * s[4] > 20 * s[0])
            quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{WHERE}/labels.parquet").collect()}
            passed = [d for d, s in stats.items() if s[0] >= 10 and 100 * s[4] <= 20 * s[0]]
            assert sum(d in after for d in passed if quality.get(d) == 1) >= 0.95 * sum(quality.get(d) == 1 for d in passed)
            assert all(before[d] == t for d, t in after.items())
        elif name == "lines":
            want = {d: w[3] for d, w in brute_lines(before, 50).items()}
            assert after == {d: t for d, t in want.items() if t.split() or t == before[d]}
        elif name == "near_copies":
            roots = roots_of(before, brute_pairs(before))
            assert after == {d: t for d, t in before.items() if roots[d] == d}
        else:
            hits = dict(zip(before, brute_hits(before.values(), items), strict=True))
            assert after == {d: t for d, t in before.items() if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])}
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, WHERE).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == sorted((d, k, len(p)) for d, t in texts(docs).items() for k, p in enumerate(brute_pieces(t)))
    check_packing(rows, 2048)


def test_run_and_odd_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, WHERE).count() > 0
    clean = " ".join(f"word{i}" for i in range(60))
    docs = docs_frame(spark, [None, "", clean, clean, clean + " more", "tiny"])
    for name, frame in (("documents", docs), ("labels", spark.createDataFrame([], LABELS)), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {2}
    spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
