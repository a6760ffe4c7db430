"""Order-dependent numbering and running sums without a single-task window.

``ROW_NUMBER() OVER (ORDER BY ...)`` and a running sum over a huge group both
make Spark move every row of the group (or of the table) into one task.  The
two helpers here split the work by range partitions instead:

1. the input is range-partitioned on the order (a sampled, balanced split) and
   frozen with a reliable ``checkpoint()`` — partition contents are then the
   same for every later pass, also after an executor is lost;
2. each partition is numbered / summed locally;
3. the carry-in of each partition (count or sum of everything before it) comes
   from a table with at most one row per partition and key, whose window
   groups are bounded by the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.plans.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row index


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def assign_keys(df: DataFrame, key: str, order_by: list, start: Column | int = 0) -> DataFrame:
    """Add ``key`` = start + 1, start + 2, ... in the order of ``order_by``.

    ``order_by`` should be unique for a reproducible numbering.  ``start`` may
    be a scalar Column (e.g. the current maximum id as a scalar subquery).
    """
    ensure_checkpoint_dir(df.sparkSession)
    order = [_col(c) for c in order_by]
    staged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_seq", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright(F.col("_seq"), _LOCAL_BITS)
    local = F.col("_seq").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = staged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a size bound that does not grow with the data.
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (staged.withColumn("_pid", pid)
            .join(F.broadcast(offsets), "_pid")
            .withColumn(key, (start_col + F.col("_off") + local + F.lit(1)).cast("bigint"))
            .drop("_seq", "_pid", "_off"))


def running_sum(df: DataFrame, keys: list[str], order_by: list, value: Column | str,
                out: str) -> DataFrame:
    """Add ``out`` = SUM(value) OVER (PARTITION BY keys ORDER BY order_by ROWS
    BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), safe for a key that holds a
    large share of all rows: no task ever holds more than one range partition."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [_col(c) for c in order_by]
    staged = (df.withColumn("_v", _col(value))
              .repartitionByRange(*[F.col(k) for k in keys], *order)
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    local_w = (Window.partitionBy("_pid", *keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = staged.withColumn("_local", F.sum("_v").over(local_w))
    totals = staged.groupBy("_pid", *keys).agg(F.sum("_v").alias("_ptot"))
    before = (Window.partitionBy(*keys).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select("_pid", *keys, F.sum("_ptot").over(before).alias("_carry"))
    cond = [local["_pid"] == carry["_pid"]] + [local[k].eqNullSafe(carry[k]) for k in keys]
    zero = F.lit(0).cast(staged.schema["_v"].dataType)
    return (local.join(carry, cond)
            .select(*[local[c] for c in df.columns],
                    (F.coalesce(carry["_carry"], zero) + local["_local"]).alias(out)))
