"""Corpus pipeline: language, near duplicates, benchmark leaks, secrets and the mixture, in this order.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and calls one operator of
``tillroll.llm``.  All but the last return the columns of ``docs`` as they came, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import secret_forest, simhash_windows, soft_mixing, subword_language
from tillroll.llm.ngram_join import first_of_each
from tillroll.llm.tables import cut, read


def _numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """The rows with columns c0, c1, ..., these names, and each column's (the first of a name).

    Then no name can clash with an operator's own, differ in case only, or need quotes.
    """
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, dict(reversed(list(zip(docs.columns, names, strict=True))))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that it rejects go (no letters, or no language likelier than not)."""
    rows, names, at = _numbered(docs)
    model = subword_language.fit(rows, key=at["doc_id"], text=at["text"], label=at["lang"])
    out = subword_language.identify(rows, model, text=at["text"], keep=names)
    return out.where("NOT rejected").select(*names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 on shingles of five words at 0.8: the document with the least id of each group stays (see ``first_of_each``)."""
    rows, names, at = _numbered(docs)
    return first_of_each(rows, size=5, percent=80, key=at["doc_id"], text=at["text"]).select(*names).toDF(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item or a near copy of one go."""
    rows, names, at = _numbered(docs)
    found = simhash_windows.contaminated(rows, read(spark, sf_dir, "benchmark"), key=at["doc_id"], text=at["text"])
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    return rows.join(gone, F.col(at["doc_id"]) == F.col("gone"), "left_anti").toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets are replaced in the text, and n_chars follows; every document stays."""
    forest = secret_forest.train(secret_forest.labelled_findings())
    rows, names, at = _numbered(docs)
    out = secret_forest.scan(rows, forest, text=at["text"], keep=names)
    columns = {at["text"]: F.col("redacted")}
    if n_chars := at.get("n_chars"):
        changed = F.size("findings") > 0
        columns[n_chars] = F.when(changed, F.length("redacted")).otherwise(F.col(n_chars)).cast(rows.schema[n_chars].dataType)
    return out.select(*(columns.get(n, F.col(n)).alias(n) for n in names)).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents drawn at least once, with their token count, rate and number of copies."""
    out = soft_mixing.mix(docs, soft_mixing.label_domains(read(spark, sf_dir, "labels")), soft_mixing.TARGETS)
    return out.where("copies > 0")


STAGES = [("language", languages), ("near_duplicates", near_copies), ("decontamination", benchmark_leaks),
          ("secrets", secrets), ("mixture", mixture)]

#: Trained models and iterations: SQL can't express them; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each stage's rows are written to the checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
