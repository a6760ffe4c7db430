"""Exact search for repeated keys with bitmaps instead of a shuffle of every key.

Grouping a table by its key sends each key to another task although almost all are unique.  Here keys are
dealt into buckets of consecutive values, and each map task sends one bitmap of the values it has seen per bucket
(``bitmap_construct_agg``, 4 KB that compress well).  A bucket with as many bits as rows holds no
repeated key; only the rows of the other buckets are grouped by key.

* A composite key groups by its other columns and buckets one integer column of it.
* Keys with a stride (order * 1000 + line) are packed: ``stride`` consecutive values keep ``slots`` places.  A
  value beyond them is a bucket of its own, so packing never changes a result.
* One aggregate first estimates how many buckets each way would make.  Where bitmaps would hold too few
  keys (hashes, texts, sparse ids), the keys are grouped as they are.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.session import ensure_checkpoint_dir

#: Rows that a bucket must hold on average for its bitmap to be smaller than their keys.
LEAST_FILL = 128
#: (stride, slots) that are tried.
PACKINGS = ((1, 1), (100, 8), (1000, 8), (1000, 32), (10000, 32))
#: Rows of (bucket, columns of the key) that are broadcast at most.
MOST_BROADCAST = 1 << 20


class Packing(NamedTuple):
    column: str
    stride: int
    slots: int


def _code(p: Packing) -> Column:
    """The packed value, NULL for a residue without a place; distinct values have distinct codes, negative ones too."""
    key = F.col(p.column).cast("bigint")
    if p.stride == 1:
        return key
    rest = key % p.stride
    return F.when(F.abs(rest) < p.slots, F.call_function("div", key, F.lit(p.stride).cast("bigint")) * p.slots + rest)


def _bucket(p: Packing) -> list[Column]:
    """(alone, bucket): the bucket of a value, or the value itself where it has no place."""
    code = _code(p)
    return [code.isNull().alias("_alone"), F.coalesce(F.bitmap_bucket_number(code), F.col(p.column).cast("bigint")).alias("_bucket")]


def choose_packing(rows: DataFrame, keys: list[str]) -> Packing | None:
    """The packing with the fewest buckets over rows with complete keys; None if the keys had better be grouped."""
    integral = [f.name for f in rows.schema.fields if f.name in keys and isinstance(f.dataType, T.IntegralType)]
    ways = [Packing(c, *p) for c, p in product(integral, PACKINGS)]
    if not ways:
        return None
    groups = [F.approx_count_distinct(F.xxhash64(*(F.col(k) for k in keys if k != w.column), *_bucket(w)), 0.1).alias(f"g{i}")
              for i, w in enumerate(ways)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *groups).first()
    fewest, best = min((found[f"g{i}"], i) for i in range(len(ways)))
    return ways[best] if found.n and found.n >= LEAST_FILL * fewest else None


def repeated_keys(rows: DataFrame, keys: list[str], pack: bool = True) -> DataFrame:
    """(keys, _null, n): each complete key of more than one row, and the number of rows with a NULL in the key, if any.

    Without ``pack`` all keys are grouped, in one job less: for tables that are small beside the facts."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    whole = rows.select(*keys).filter(~any_null)
    nulls = (rows.select(*keys).filter(any_null).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
             .select(*(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys), F.lit(True).alias("_null"), "n"))
    suspects, way = whole, choose_packing(whole, keys) if pack else None
    if way is not None:
        place = [k for k in keys if k != way.column]
        by = [*place, "_alone", "_bucket"]
        marked = whole.select(*keys, *_bucket(way))
        ensure_checkpoint_dir(rows.sparkSession)
        seen = F.bitmap_count(F.bitmap_construct_agg(F.coalesce(F.bitmap_bit_position(_code(way)), F.lit(0).cast("bigint"))))
        differing = (marked.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), seen.alias("_bits"))
                     .filter(F.col("_rows") > F.col("_bits")).select(*by).checkpoint(eager=True))
        small = differing.count() <= MOST_BROADCAST
        suspects = marked.join(F.broadcast(differing) if small else differing, by, "left_semi")
    repeated = suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return repeated.select(*keys, F.lit(False).alias("_null"), "n").unionByName(nulls)
