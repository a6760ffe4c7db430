"""Bounded, deterministic samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that no model learns from: crc32(id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of each label, those with the least hash of their key.

    A first filter on the hash, with a rate from the exact label counts, leaves about twice the bound,
    so that ranking never sorts a whole class.  Give it keys and labels only and join the rest to the sample.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    # one row a label: broadcast, so that a label of most rows isn't one task's
    near = (rows.join(F.broadcast(counts), label)
            .where(share <= (2.0 * bound + 20) / F.col("_n")).drop("_n"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), F.col(key)))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= bound).drop("_rank")
