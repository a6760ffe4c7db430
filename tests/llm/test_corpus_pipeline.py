"""The pipeline: each stage against brute force on its own input, and odd rows through all of them."""

import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 34"), (9004, "the and of with that " * 30), (9004, "the and of with that " * 30)],
                                "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("class", F.lit("x")).withColumn("score", F.lit(1.0)).withColumn("_text", F.lit("y"))
    columns = docs.columns
    benchmark = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).checkpoint()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before), name
        gone = set(before) - set(after)
        if name == "language":
            assert gone == {9001, 9002, 9003} | (gone - {9001, 9002, 9003}) and len(gone) <= 4
        if name == "near_duplicates":
            def shingles(t):
                w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
                return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
            sets = {i: shingles(r.text) for i, r in before.items()}
            similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert all(any(j < i and similar(i, j) for j in before) for i in gone)
            assert not any(similar(i, j) for i in after for j in after if i < j)
            assert docs.where("doc_id = 9004").count() == 1
        if name == "decontamination":
            holds = lambda t: any(" " + " ".join(b) + " " in " " + " ".join(t.lower().split()) + " " for b in benchmark)
            assert not any(holds(r.text) for r in after.values()) and any(holds(before[i].text) for i in gone)
        if name == "secrets":
            assert not gone and all(r.n_chars is None or r.n_chars == len(r.text) for r in after.values())
            assert not any(re.search(r'token = "[0-9a-f]{40}"', r.text) for r in after.values())
            same = [i for i, r in after.items() if r.text == before[i].text]
            assert len(same) >= 0.9 * len(after)
    out = cp.STAGES[-1][1](spark, docs, SF)
    assert out.where("copies < 1").count() == 0 and out.count() > 0


def test_run_and_registration(spark):
    from tillroll.llm.queries import llm_queries
    assert "pipeline" in llm_queries() and cp.ORACLE_SQL is None
    assert cp.run(spark, SF).count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0


def test_stages_with_odd_column_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.union(docs.limit(3)).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    docs = docs.toDF(*docs.columns).select("*", F.lit("other").alias("Text"), F.lit(0).alias("DOC_ID"))
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and docs.count() > 0, name
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 0
