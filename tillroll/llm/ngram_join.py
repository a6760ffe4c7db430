"""Operator 2, n-gram Jaccard join by prefix filters under several token orders.

A document's set is its distinct 4-word shingles (A-Z lower-cased; fewer words: the whole sequence as
one; no words: empty), as 56-bit hashes.  Two documents link when their sets' Jaccard similarity is at
least ``percent / 100``.  Documents with equal sets form one class; all work below is on classes.

* *Orders.*  A global order ranks tokens by how frequent they are and then by a hash; each order has its
  own hash.  Frequencies come from a Count-Min table of fixed size over every document, so that tokens
  of many documents come last; any order gives right results.  Of a set of n tokens, the prefix is the
  first ``n - ceil(0.85 n) + 1``: two linked sets share a token of their prefixes under every order.
* *Candidates.*  Under the first order, classes meet on prefix tokens.  Of tokens that the same classes have only the first of the
  order stays, which is the first common one of any two classes that have it, so a shared passage is one token.  A token's classes are first
  linked sparsely, each to the class that has the token earliest in its order and to the next one.  Candidates must also be
  of compatible size, have enough tokens left from the common one on in both (linked sets have at their
  first common token), have parity bits that differ in no more places than linked sets may differ in tokens, and
  share a prefix token under each of the other orders; those that remain are verified on their whole sets.
* *The rest.*  Verified links give components.  Then each token whose classes lie in more than one
  component pairs its classes across components - classes outside the token's largest component
  against all others - and the same filters and verification follow.  So no pair of different
  components stays untested, a group of near copies costs pairs in proportion to its size, and no
  cap or sample is involved.

Defined results: a null or empty text or one without words has n_shingles 0 and links with nothing; rows
with equal sets have one class whose component is the least doc_id; a null doc_id takes no part and
is not returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .tables import bounded, cut, texts
from .words import Words, grams, mix, slices, unzipped, zipped

U64 = np.uint64
#: Count-Min cells: 4 MB whatever the corpus.
CELLS = 1 << 20
CHUNKS = 16
#: Seeds of the token orders; candidates must share a prefix token under each.
ORDERS = (0x51, 0xA7, 0x1F3)
TOKEN = U64((1 << 56) - 1)
#: Parity bits of a class: the power of two above this many a token, between these.
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 1, 128, 1 << 15


def token_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token, 56-bit token), sorted by both and distinct, of at most 256 rows."""
    words = Words(text, lower=True)
    row = words.row()
    n = len(row) - size + 1
    token, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    if n > 0:
        inside = row[:n] == row[size - 1:]
        token, owner = grams(words.hash, size)[inside], row[:n][inside]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = [grams(words.hash[words.first[r]:words.first[r + 1]], int(words.count[r]), seed=1)[0] for r in short]
        token, owner = np.concatenate((token, whole)), np.concatenate((owner, short))
    both = np.unique(token & TOKEN | owner.astype(U64) << U64(56))
    return (both >> U64(56)).astype(np.int64), both & TOKEN


def _cells(token: np.ndarray) -> np.ndarray:
    return (mix(token ^ U64(0xC0FFEE)) % U64(CELLS)).astype(np.int64)


def _count_tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.uint32)
        for piece in slices(batches, "text", max_rows=256):
            _, token = token_sets(piece.column("text"), size)
            cells += np.bincount(_cells(token), minlength=CELLS).astype(np.uint32) if len(token) > CELLS // 8 else 0
            if len(token) <= CELLS // 8:
                np.add.at(cells, _cells(token), 1)
        parts = [zlib.compress(c.tobytes(), 1) for c in cells.reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())],
                                         names=["chunk", "cells"])

    return run


def _add_cells(group: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // CHUNKS, dtype=np.uint64)
    for blob in group.column("cells"):
        total += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32)
    return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()),
                     "cells": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})


def frequency_ranks(known: DataFrame, size: int) -> np.ndarray:
    """For each Count-Min cell a rank, 0 for what can't be told from rare; one byte each, 1 MB in all."""
    rows = (known.mapInArrow(_count_tokens(size), "chunk int, cells binary").groupBy("chunk")
            .applyInArrow(_add_cells, "chunk int, cells binary").orderBy("chunk").collect())
    cells = np.concatenate([np.frombuffer(r.cells, np.uint32) for r in rows]) if rows else np.zeros(CELLS, np.uint32)
    usual = 2.0 * np.median(cells) + 4
    return np.maximum(0, np.ceil(np.log2(np.maximum(cells, 1) / usual))).astype(np.uint8)


def _profiles(size: int, percent: int, ranks: np.ndarray):
    """doc_id, class, n, the parity bits of the set and the prefixes under each order (bits and prefixes once a class and task).

    Under the further orders they are only compared within a pair: 32 bits of each token do, as equal
    bits of other tokens can but let a pair pass to verification.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("bits", pa.list_(pa.int64())), ("p0", pa.list_(pa.int64()))]
                       + [(f"p{i}", pa.list_(pa.int32())) for i in range(1, len(ORDERS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in slices(batches, "text", max_rows=256):
            row, token = token_sets(piece.column("text"), size)
            n = np.bincount(row, minlength=piece.num_rows)
            first = np.concatenate(([0], np.cumsum(n)))
            kind = class_keys(token, first)
            new = np.array([k not in seen and not seen.add(k) for k in kind.tolist()]) & (n > 0)
            prefix = np.where(new, n - (-(-percent * n // 100)) + 1, 0)
            rank = ranks[_cells(token)].astype(U64) << U64(58)
            at = np.repeat(first[:-1], prefix) + np.arange(prefix.sum()) \
                - np.repeat(np.cumsum(prefix) - prefix, prefix)
            offsets = pa.array(np.concatenate(([0], np.cumsum(prefix))), pa.int32())
            lists = []
            for seed in ORDERS:
                order = np.lexsort((mix(token ^ U64(seed)) >> U64(6) | rank, row))
                chosen = token[order][at]
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(
                    chosen.astype(np.uint32).view(np.int32) if lists else chosen.view(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(kind), pa.array(n, pa.int32()), parities(token, first, new), *lists],
                schema=schema)

    return run, "doc_id long, class long, n int, bits array<long>, p0 array<long>, " + ", ".join(f"p{i} array<int>" for i in range(1, len(ORDERS)))


def parities(token: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """For each wanted row a list of words: bit i tells whether an odd number of its tokens hash to i."""
    place, out = mix(token ^ U64(0xB175)), []
    for r in range(len(first) - 1):
        own = place[first[r]:first[r + 1]]
        if not wanted[r]:
            out.append(None)
            continue
        width = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_TOKEN * len(own) - 1).bit_length()))
        odd = np.bincount((own % U64(width)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def class_keys(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's whole set."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token + U64(0x1234567)))))
        other = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token ^ U64(0xABCDEF)) * U64(0x9E3779B97F4A7C15))))
        a, b = total[first[1:]] - total[first[:-1]], other[first[1:]] - other[first[:-1]]
        return mix(a + mix(b + n.astype(U64))).view(np.int64)


def _bodies(size: int):
    """class and the compressed text, a third of its set's bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", max_rows=256):
            _, kind = _classes(piece.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array(kind), zipped(piece.column("text"))], names=["class", "body"])

    return run, "class long, body binary"


def _classes(text: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the token set of each text, its class)."""
    row, token = token_sets(text, size)
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(text)))))
    return np.split(token, first[1:-1]), class_keys(token, first)


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "ta", 1 << 18, max_rows=64):  # linked texts are of like size
            keep = []
            for x, y in zip(*(_classes(unzipped(piece.column(c)), size)[0] for c in ("ta", "tb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, "a long, b long"


def _compatible(percent: int, x: str, y: str) -> str:
    """Whether two classes may be linked, seen from a token at ``pos`` of each one's order.

    Their sizes must allow it; and if this is their first common token, no earlier token is common, so that
    the overlap is at most what follows on either side.  Linked classes pass at their first common token.
    """
    return (f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) AND "
            f"{100 + percent} * least({x}n - {x}pos, {y}n - {y}pos) >= {percent} * ({x}n + {y}n)")


def similar_classes(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id",
                    text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, class, n_shingles), (links between classes: a, b that join their components).

    The links are verified ones; within a component they may be fewer than all similar pairs, but two
    classes are connected by them exactly if they are by all similar pairs.
    """
    known = texts(docs, key, text).where("doc_id IS NOT NULL")
    ranks = frequency_ranks(known, size)
    run, kind = _profiles(size, percent, ranks)
    profile = cut(known.mapInArrow(run, kind))
    members = profile.select("doc_id", "class", F.col("n").alias("n_shingles"))
    w = Window.partitionBy("token")
    held = lambda seed: F.bit_xor(F.xxhash64("class", F.lit(seed))).over(w)
    at = F.col("n").cast("long") * (1 << 32) + F.col("pos")  # one column of both: what is written stays small
    position = F.col("at").bitwiseAND((1 << 32) - 1)
    told = cut(profile.where("size(p0) > 0").select(F.posexplode("p0").alias("pos", "token"), "class", at.alias("at"))
               .select("token", "class", "at").repartition("token").dropDuplicates(["token", "class"])
               .select("token", "class", "at", F.count("*").over(w).alias("many"), held(1).alias("held"), held(2).alias("held2"), F.sum(position).over(w).alias("place"))
               .where("many > 1").drop("many"))
    # tokens of the same classes tell the same: of each passage's, only the first of the order stays
    firsts = told.groupBy("held", "held2").agg(F.min(F.struct("place", "token")).alias("first")).select(F.col("first.token").alias("token"))
    shared = cut(told.join(firsts, "token", "left_semi").select(
        "token", "class", position.cast("int").alias("pos"), F.shiftright("at", 32).cast("int").alias("n")))
    # the hub has the token earliest: few of its tokens are rarer, so it is the source of its copies, if any is
    sparse = (shared.withColumn("hub", F.min(F.struct("pos", "class", "n")).over(w))
              .withColumn("next", F.lead(F.struct("pos", "class", "n")).over(w.orderBy("pos", "class"))))
    pairs = cut(sparse.select(F.explode(F.array("hub", "next")).alias("o"), "class", "n", "pos")
                .where("o IS NOT NULL AND o.class <> class AND " + _compatible(percent, "", "o."))
                .select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b")).distinct())
    orders = [f"p{i}" for i in range(1, len(ORDERS))]
    rep = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))

    def verified(pairs: DataFrame) -> DataFrame:
        classes = lambda of: of.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        once = lambda of, *kept: (profile.where("size(p0) > 0").join(bounded(classes(of)), "class", "left_semi")
                                  .dropDuplicates(["class"]).select("class", *kept))
        marks = once(pairs, "n", "bits")
        mark = lambda s: marks.toDF(s, f"{s}n", f"{s}bits")
        apart = F.aggregate(F.zip_with("abits", "bbits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        near = (F.size("abits") != F.size("bbits")) | (apart * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent))
        pairs = cut(pairs.join(mark("a"), "a").join(mark("b"), "b").where(near).select("a", "b"))
        others = once(pairs, *orders)
        side = lambda s: others.toDF(s, *(f"{s}{p}" for p in orders))
        left = cut(pairs.join(side("a"), "a").join(side("b"), "b")
                   .where(" AND ".join(f"arrays_overlap(a{p}, b{p})" for p in orders)).select("a", "b"))
        wanted = bounded(classes(left).join(rep, "class").select("doc_id"))
        run, kind = _bodies(size)
        bodies = known.join(wanted, "doc_id", "left_semi").mapInArrow(run, kind).dropDuplicates(["class"])
        run, kind = _verify(size, percent)
        return cut(left.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b")
                   .select("a", "b", "ta", "tb").mapInArrow(run, kind))

    links = verified(pairs)
    near = bounded(components(links).withColumnRenamed("node", "class"))
    # the two tokens before it in the class's order: classes with one of them in common met there already
    order = Window.partitionBy("class").orderBy("pos")
    placed = (shared.withColumn("q1", F.lag("token").over(order)).withColumn("q2", F.lag("token", 2).over(order))
              .join(near, "class", "left").withColumn("component", F.coalesce("component", "class")))
    # one shuffle by token serves the largest component and both sides of the join
    apart = (placed.withColumn("c", F.count("*").over(Window.partitionBy("token", "component")))
             .withColumn("main", F.max(F.struct("c", "component")).over(w)["component"]))
    x, y = apart.where("component <> main").alias("x"), apart.alias("y")
    across = cut(x.join(y, F.expr("x.token = y.token AND x.component <> y.component AND (y.component = y.main OR x.class < y.class) AND "
                                   "NOT coalesce(x.q1 = y.q1 OR x.q1 = y.q2 OR x.q2 = y.q1 OR x.q2 = y.q2, false) AND " + _compatible(percent, "x.", "y.")))
                 .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
                 .join(pairs, ["a", "b"], "left_anti"))
    return members, links.union(verified(across))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every document."""
    members, links = similar_classes(docs, size, percent, key, text)
    placed = (members.join(components(links).withColumnRenamed("node", "class"), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    full = placed.where("n_shingles > 0")
    least = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (full.join(least, "component").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
            .union(members.where("n_shingles = 0")
                   .select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document with the least id stays.

    Rows without an id stay.  Rows with the same id are judged by their texts like others; of linked ones the least by a hash of
    the text stays, of those with one text the least by all columns as JSON.  No column may be named own, again, or first.
    """
    known = docs.where(F.col(key).isNotNull())
    repeated = cut(known.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"))
    rest = docs.where(F.col(key).isNull())
    if repeated.isEmpty():
        groups = near_duplicates(docs, size, percent, key, text)
        first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
        return known.join(first, F.col(key) == F.col("first"), "left_semi").union(rest)
    rows = (known.join(repeated.withColumn("again", F.lit(True)), F.col(key) == F.col("id"), "left").drop("id")
            .withColumn("own", F.when(F.col("again"), F.xxhash64(key, text)).otherwise(F.col(key).cast("long"))))
    groups = near_duplicates(rows, size, percent, "own", text).select(F.col("doc_id").alias("own"), "component_id").distinct()
    first = (groups.join(rows.select("own", key).distinct(), "own").groupBy("component_id")
             .agg(F.min(F.struct(key, "own")).alias("first")).select(F.col("first.own").alias("own")))
    kept = rows.join(first, "own", "left_semi")
    whole = F.struct(*docs.columns)
    one = kept.where("again").groupBy("own").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return kept.where("again IS NULL").select(*docs.columns).union(one).union(rest)
