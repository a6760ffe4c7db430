"""Registered queries of the corpus operators: thin digests of what each operator returns."""

from __future__ import annotations

import string
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (line_quality, merkle, metric_tree, multiprobe, oracles, page_model, periodic_runs, secret_forest, simhash_windows, soft_mixing,
               subword_language, word_shapes)
from .ngram_join import near_duplicates
from .repeated_phrases import remove_repeated
from .samples import held_out
from .tables import columns, read


def op1_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = word_shapes.train(word_shapes.labelled_lines())
    out = word_shapes.find_personal(read(spark, sf_dir, "documents"), model)
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    rank = F.create_map(*(F.lit(x) for pair in zip(word_shapes.KINDS, range(4), strict=True) for x in pair))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        rank[s.kind].alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))), lambda s: s)
    return out.select("doc_id", *(count(k) for k in word_shapes.KINDS),
                      F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(ordered).alias("spans"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = line_quality.score_documents(docs, line_quality.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_forest.train(secret_forest.labelled_findings())
    out = secret_forest.scan(read(spark, sf_dir, "documents"), forest)
    return out.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"),
                      F.transform("findings", lambda f: F.concat_ws(":", f.start, f.end)).alias("spans"),
                      F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = soft_mixing.label_domains(read(spark, sf_dir, "labels"))
    return soft_mixing.mix(read(spark, sf_dir, "documents"), labels, soft_mixing.TARGETS)


def op7_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_windows.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = subword_language.identify(docs, subword_language.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest(read(spark, sf_dir, "embeddings"))


def op10_page_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = page_model.train(page_model.labelled_pages())
    out = page_model.extract(read(spark, sf_dir, "pages"), model)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.nearest(read(spark, sf_dir, "embeddings"))


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the crc32 of the id and h % 10 = 0, the words from one place on repeat the first few of them."""
    rows = columns(docs, "doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = F.col("h") % 10 == 0
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", F.when(chosen, words)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.call_function("div", F.col("n") - F.col("a"), F.lit(3) + F.col("g") % 8))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform("w", lambda w, i: F.element_at("w", (at(i) + 1).cast("int"))), " ")
    return rows.select("doc_id", F.when(chosen & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(_planted(read(spark, sf_dir, "documents")))
    sign = lambda test, otherwise: F.when(test < 0, -1).when(test > 0, 1).otherwise(otherwise)
    strongest = F.get(F.array_sort("runs", lambda x, y: sign(y.length * x.period - x.length * y.period, sign(
        x.start - y.start, sign(x.period - y.period, F.lit(0))))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    best = out.withColumn("best", strongest)
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
                       hashed(lines).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), {"text": lowered}, third)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_repeated_phrases, op2_ngram_join, op3_word_shapes, op4_line_quality, op5_secret_forest, op6_soft_mixing,
        op7_simhash_windows, op8_subword_language, op9_multiprobe, op10_page_model, op11_metric_tree, op12_block_convolution, op13_merkle_manifest, pipeline)}


def llm_oracles() -> dict[str, str]:
    fixed = {"op1_repeated_phrases": oracles.OP1, "op2_ngram_join": oracles.OP2, "op11_metric_tree": oracles.OP11,
             "op12_block_convolution": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
    return fixed | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
