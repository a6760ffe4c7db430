"""Reading inputs and cutting lineage, shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def columns(frame: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, found by position: others may differ in case only, hold dots, or repeat an operator's own names."""
    at = [frame.columns.index(n) for n in names]
    rows = frame.toDF(*(f"_{i}" for i in range(len(frame.columns))))
    return rows.select(*(F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads."""
    return columns(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def bounded(frame: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``frame``, of a few numbers a row, written and counted: broadcast up to ``most`` rows, shuffled by joins beyond."""
    kept = cut(frame)
    return F.broadcast(kept) if kept.count() <= most else kept
