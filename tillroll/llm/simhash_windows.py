"""Operator 7, benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

Words are lower-cased; a shingle is ``size`` consecutive words, of a shorter item all its words.

* *Windows.*  A window has the item's number of words, at any start; a text shorter than the item is one
  window.  With a and b shingles, a similarity of ``percent`` / 100 needs ``percent * (a + b) / (100 + percent)``
  of them in common, so every start gets a SimHash whose window holds that many shingles that items of its length
  have, whatever their order; no other can be similar.  The shingles of all benchmark items are broadcast only
  after they have been counted and found few (``broadcast_rows``); beyond that, an ordinary shuffle join
  is used, which adaptive execution splits on hot shingles.
* *SimHash and blocks.*  Windows and items get 64-bit SimHashes of their shingles, weighted by how
  often each occurs.  The 64 bits are cut into 8 blocks; if two hashes differ in at most 23 bits, then some
  block differs in at most 2 of its 8 bits.  Items are listed under every such variant of each block, so
  that a join on (window length, block, value) meets all pairs within the radius, whichever items the
  window's shingles come from.
* *Verification.*  Pairs within 23 bits are compared exactly: the weighted Jaccard similarity of the
  shingles themselves, sum of the smaller over sum of the larger counts, at least ``percent / 100``.

At a similarity of 0.8 about 10 of 64 bits differ (standard deviation 3), so that the radius of 23 loses
a pair with a probability below one in 100,000.

Defined results: null or empty texts and items match nothing; a text shorter than an item is compared whole;
rows with a null doc_id or item_id take no part; rows with the same doc_id are one document; of several windows of one
document and item the most similar is given, the first of equals; extra columns are ignored; an empty
table on either side gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .soft_mixing import words_of
from .tables import cut, texts

BLOCKS = 8
RADIUS = 23
_MASKS = [0, *(1 << i for i in range(8)), *(1 << i | 1 << j for i, j in combinations(range(8), 2))]


def _words(frame: DataFrame) -> DataFrame:
    return frame.withColumn("w", words_of("text")).select(*(c for c in frame.columns if c != "text"), "w")


def _lower(frame: DataFrame) -> DataFrame:
    return frame.withColumn("text", F.lower("text"))


def _shingles(words: str, size: int) -> Column:
    """Shingles as strings; of fewer words than ``size`` the whole, of none no shingle."""
    n = F.size(words)
    return (F.when(n == 0, F.array().cast("array<string>"))
            .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))),
                                   lambda i: F.array_join(F.slice(words, i, size), " "))))


def _hashes(words: str, size: int) -> Column:
    """The hash of each run of ``size`` words, in order."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.col(words)[i + j] for j in range(size)))))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash; a shingle that occurs twice weighs twice."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(
        F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int")) * 2 > F.size(hashes),
        F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _block(name: str, number: str) -> Column:
    """Eight of the 64 bits, as 0 to 255."""
    return F.call_function("shiftrightunsigned", F.col(name), F.col(number) * 8).bitwiseAND(F.lit(255)).cast("int")


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of smaller counts over sum of larger ones, of two arrays of shingles."""
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(
        F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return both / (F.size(a) + F.size(b) - both)


def _starts(size: int, percent: int) -> Column:
    """Runs (lo, hi) of the starts whose window holds enough of the places ``at`` of a text of ``n`` words.

    The window from s has ``need`` places if the first of them at or after s is followed by ``need - 1`` others in it.
    """
    gram = F.least(F.lit(size), F.col("len"))
    room = F.least("n", "len") - gram + 1  # shingles of a window
    common = F.lit(percent) * (room + F.col("len") - gram + 1)
    need = F.greatest(F.lit(1), F.ceil(common / (100 + percent)).cast("int"))

    def run(i: Column) -> Column:
        place = lambda j: F.get("at", j)
        return F.struct(F.greatest(F.lit(0), F.coalesce(place(i - 1), F.lit(-1)) + 1, place(i + need - 1) - room + 1).alias("lo"),
                        F.least(place(i), F.greatest(F.lit(0), F.col("n") - F.col("len"))).alias("hi"))

    last = F.size("at") - need
    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run))
    return F.filter(runs, lambda r: r.lo <= r.hi)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, start (first word of the window, from 0), n_words, distance in bits, similarity."""
    items = texts(benchmark, item_key, item_text).withColumnRenamed("doc_id", "item_id")
    items = cut(_words(_lower(items.where("item_id IS NOT NULL AND text IS NOT NULL"))).where("size(w) > 0")
                .select("item_id", "w", F.size("w").alias("len"), _shingles("w", size).alias("item_shingles"))
                .withColumn("item_hash", simhash(F.col("item_shingles"))))
    short = sorted(r.len for r in items.where(F.col("len") < size).select("len").distinct().collect())
    known = texts(docs, key, text).where("doc_id IS NOT NULL AND text IS NOT NULL")
    spoken = _words(_lower(known))
    seeds, places = [], []
    for n in [*short, size]:
        own = items.where(F.col("len") == n if n < size else F.col("len") >= size)
        seeds.append(own.select(F.lit(n).alias("g"), "len", F.explode(_hashes("w", n)).alias("h")))
        places.append(spoken.select("doc_id", F.size("w").alias("n"), F.lit(n).alias("g"), F.posexplode(_hashes("w", n)).alias("pos", "h")))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    seeds = cut(union(seeds).distinct())
    if seeds.count() <= broadcast_rows:
        seeds = F.broadcast(seeds)
    hits = (union(places).join(seeds, ["g", "h"]).groupBy("doc_id", "n", "len").agg(F.array_sort(F.collect_set("pos")).alias("at"))
            .select("doc_id", "n", "len", _starts(size, percent).alias("runs")).where("size(runs) > 0"))
    per = hits.groupBy("doc_id", "n").agg(F.collect_list(F.struct("len", "runs")).alias("lens"))
    windows = (_words(_lower(known.join(per, "doc_id").select("doc_id", "n", "lens", "text"))).where("size(w) = n")
               .select("doc_id", "w", F.explode("lens").alias("o"))
               .select("doc_id", "w", F.col("o.len").alias("len"), F.explode("o.runs").alias("o"))
               .select("doc_id", "w", "len", F.explode(F.sequence("o.lo", "o.hi")).alias("start"))
               .select("doc_id", "start", "len", F.slice("w", F.col("start") + 1, F.col("len")).alias("v"))
               .select("doc_id", "start", "len", _shingles("v", size).alias("shingles")).withColumn("hash", simhash(F.col("shingles"))))
    windows = cut(windows)
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.lit(m).alias("mask")) for i in range(BLOCKS) for m in _MASKS)))
    variants = (items.select("item_id", "len", "item_hash", listed.alias("o"))
                .select("item_id", "len", "item_hash", "o.block", _block("item_hash", "o.block").bitwiseXOR(F.col("o.mask")).alias("value")))
    blocks = (windows.select("doc_id", "start", "len", "hash", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("block"))
              .select("doc_id", "start", "len", "hash", "block", _block("hash", "block").alias("value")))
    pairs = (blocks.join(variants, ["len", "block", "value"])
             .withColumn("distance", F.bit_count(F.col("hash").bitwiseXOR(F.col("item_hash")))).where(F.col("distance") <= RADIUS)
             .select("doc_id", "start", "len", "item_id", "distance").distinct())
    near = (pairs.join(windows.select("doc_id", "start", "len", "shingles"), ["doc_id", "start", "len"])
            .join(items.select("item_id", "item_shingles"), "item_id")
            .withColumn("similarity", weighted_jaccard("shingles", "item_shingles")).where(F.col("similarity") * 100 >= percent))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("len").alias("n_words"), (-F.col("distance")).alias("d"))).alias("b")
    return (near.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"),
                    (-F.col("b.d")).cast("long").alias("distance"), F.col("b.similarity").alias("similarity")))
