"""The pipeline's stages by hand, and the whole."""

import corpus_pipeline
from pyspark.sql import functions as F

from typeloom.llm.common import rest
from tests.llm.test_operators import PASSAGE, brute_components, docs_of, prose


def test_stages(spark, tmp_path):
    base = prose(3, 300)
    near = base.split(" ")
    near[10] = "other"
    rows = [(i, prose(100 + i, 120, ("en", "de")[i % 2]), ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)]
    rows += [(50, base, "en", "a"), (51, base, None, "a"), (52, " ".join(near), "en", "a"), (53, None, "en", "a"), (54, "short", "en", "a"), (55, "1 " * 100, "en", "a"), (56, prose(5, 90) + "\n" + PASSAGE, "en", "b"), (57, prose(6, 90) + "\n" + PASSAGE, "en", "b"), (58, "a b c " * 60, "en", "b")]
    docs = docs_of(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    whole = {r[0] for r in rows}
    assert ids["language"] == whole - {53, 55}
    assert ids["quality"] == ids["language"] - {54, 58}
    kept = brute_components([(r.doc_id, r.text) for r in seen["quality"].collect()], 5, 8, 10)
    assert ids["ngram_join"] == {d for d, _, c in kept if d == c} == ids["quality"] - {51, 52}
    texts = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert texts[57].text == prose(6, 90) + "\n" and texts[57].n_chars == len(texts[57].text) and PASSAGE in texts[56].text
    assert texts[0].text == rows[0][1] and ids["packing"] == ids["substring_dedup"] == ids["ngram_join"]


def test_empty(spark, tmp_path):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_clashing_names_are_kept(spark):
    docs = docs_of(spark, [(i, prose(100 + i, 120), "en", "s") for i in range(12)])
    for c in ("language", "score", "_score", "text_hash", "removed", "_kept", "row", "spans"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns and made.count() == 12
        assert {(r.score, r._score, r.removed, r.text_hash, r["_kept"], r.spans) for r in made.collect()} == {("score", "_score", "removed", "text_hash", "_kept", "spans")}


def test_run_is_the_stages(spark):
    small = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, small)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty() and got.count() > 0


def test_stages_begin_on_rested_executors(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in beans)
    rest(spark)
    assert sum(b.getCollectionCount() for b in beans) >= before + spark.sparkContext.defaultParallelism

    rested = []
    monkeypatch.setattr(corpus_pipeline, "rest", rested.append)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs_of(spark, [(1, prose(1, 120), "en", "s")]), "")
        assert len(rested) == n + 1
