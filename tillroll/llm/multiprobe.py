"""Operator 9, nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product.  Vectors are scaled by the largest norm and given one more
component that makes them unit vectors, queries are scaled to norm 1; then the largest inner product
is the least Euclidean distance, for which p-stable (Gaussian) hashing is made.  Each of ``tables`` hash
tables cuts ``planes`` random projections into cells of width ``width``.  A query visits, in each table, the
cells in the order of their estimated success - the probability that a neighbour at the query's
distance lies there, a product of normal distribution functions - until the sum of these probabilities
lets all tables together reach ``reach``.  Candidates of all tables are merged, scored exactly in
double precision on the original vectors and ranked; equal scores go to the smaller vec_id.

The query's distance is that of its k-th neighbour in a bounded sample, which no k-th neighbour in the table exceeds,
or the usual one of the sample if that is more; every row is indexed.  A query whose k-th neighbour found lies farther
visits the further cells for that distance, and one with fewer than ``k`` found visits all cells of a table.  Vectors and probes of a cell meet in
a co-grouped numpy product.  Cells are cut into blocks of at most about ``block`` vectors by
``block`` probes with an exact count, so one frequent vector never lands in one task, and no candidate is
dropped.  The projections depend only on the seed, the dimension and the parameters.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do those whose length isn't the most usual one (the greater on a tie); rows with a null id take no
part; a repeated id counts once for each row; fewer candidates than ``k`` give fewer ranks; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

_ERF = np.vectorize(math.erf, otypes=[float])
SAMPLE = 4000
SAMPLE_QUERIES = 100


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _ERF(x / math.sqrt(2.0)))


@dataclass
class Hashing:
    planes: np.ndarray  # tables x (dim + 1) x planes
    shifts: np.ndarray  # tables x planes
    width: float
    half: int           # cells on each side of 0; the outermost are open
    largest: float      # the norm that vectors are scaled by
    usual: float        # distance of a k-th neighbour
    share: float        # success to reach in each table
    most: int           # cells that are ever enumerated
    sample: np.ndarray  # some vectors, scaled
    k: int

    def distance(self, query: np.ndarray) -> float:
        """What the query's probes are chosen for: at least the distance of its k-th neighbour."""
        near = -np.partition(-(self.sample @ (query / np.linalg.norm(query))), min(self.k, len(self.sample) - 1))  # it may be in the sample itself
        return max(self.usual, math.sqrt(max(0.0, 2.0 - 2.0 * float(near[min(self.k, len(near) - 1)]))))

    def further(self, query: np.ndarray, n: int | None, last: float | None) -> list[np.ndarray]:
        """For each table the cells to visit after ``n`` neighbours were found, the k-th with the score ``last``."""
        none = [np.zeros(0, np.int64) for _ in self.planes]
        if (n or 0) < self.k:
            return [np.arange((2 * self.half) ** self.planes.shape[2]), *none[1:]]
        known, found = self.distance(query), math.sqrt(max(0.0, 2.0 - 2.0 * last / (np.linalg.norm(query) * self.largest)))
        if found <= known * (1 + 1e-9):
            return none
        return [np.setdiff1d(new, old) for new, old in zip(self.probes(query, found), self.probes(query, known), strict=True)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """tables x rows: the cell number of each vector."""
        scaled = vectors / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        full = np.concatenate((scaled, rest[:, None]), axis=1)
        out = []
        for plane, shift in zip(self.planes, self.shifts, strict=True):
            at = np.clip(np.floor((full @ plane + shift) / self.width), -self.half, self.half - 1).astype(np.int64) + self.half
            out.append(at @ (2 * self.half) ** np.arange(plane.shape[1]))
        return np.array(out)

    def probes(self, query: np.ndarray, distance: float) -> list[np.ndarray]:
        """For each table the cells that one query visits, in the order of estimated success at a distance."""
        unit = np.append(query / np.linalg.norm(query), 0.0)
        low = np.arange(-self.half, self.half) * self.width
        high = low + self.width
        low[0], high[-1] = -1e9, 1e9
        out = []
        for plane, shift in zip(self.planes, self.shifts, strict=True):
            cell, chance = np.zeros(1, np.int64), np.ones(1)
            for j, p in enumerate(unit @ plane + shift):
                mass = _normal((high - p) / distance) - _normal((low - p) / distance)
                chance = (chance[:, None] * mass).ravel()
                cell = (cell[:, None] + np.arange(2 * self.half) * (2 * self.half) ** j).ravel()
                order = np.argsort(-chance, kind="stable")[:self.most]  # best products have best prefixes
                chance, cell = chance[order], cell[order]
            out.append(cell[:int(np.searchsorted(np.cumsum(chance), self.share)) + 1])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _blobs(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND "
                      "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def prepare(rows: DataFrame, k: int, tables: int, planes: int, width: float, reach: float, most: int, seed: int):
    """(rows of the usual dimension, Hashing) or None for no rows."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()
    if not stats:
        return None
    best = max(stats, key=lambda r: (r.n, r.d))
    rows = rows.where(F.size("v") == best.d)
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(share <= (1.5 * SAMPLE + 20) / best.n).limit(SAMPLE).collect()
    data = np.array([r.v for r in some])
    unit = data[:SAMPLE_QUERIES] / np.linalg.norm(data[:SAMPLE_QUERIES], axis=1, keepdims=True)
    near = np.sort(unit @ data.T / best.norm, axis=1)[:, ::-1][:, min(k, len(data) - 1)]  # the first is the row itself
    usual = float(np.quantile(np.sqrt(np.maximum(2.0 - 2.0 * near, 0.0)), 0.75))
    rng = np.random.default_rng(seed)
    return rows, Hashing(rng.normal(size=(tables, best.d + 1, planes)), rng.uniform(0, width, (tables, planes)), width,
                         max(1, math.ceil(3.5 / width)), float(best.norm) * (1 + 1e-12), max(usual, 0.05), 1 - (1 - reach) ** (1 / tables), most,
                         data / best.norm, k)


def _index(h: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                blobs = _blobs(m)
                for t, cell in enumerate(h.cells(m)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(m), t, np.int32)), pa.array(cell), batch.column("vec_id"), blobs],
                        names=["tab", "cell", "vec_id", "v"])

    return run, "tab int, cell long, vec_id long, v binary"


def _visit(h: Hashing, again: bool = False):
    """The cells of each query; ``again``: those that its ``n`` neighbours found, the last with the score ``last``, leave to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(batch.column("n").to_pylist(), batch.column("last").to_pylist(), strict=True) if again else [None] * batch.num_rows
            for query, row, known in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("v")), told, strict=True):
                cells = h.further(row, *known) if again else h.probes(row, h.distance(row))
                n = sum(map(len, cells))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(cells), dtype=np.int32), list(map(len, cells)))), pa.array(np.concatenate(cells)),
                     pa.array([query] * n, pa.int64()), pa.array([row.tobytes()] * n, pa.binary())],
                    names=["tab", "cell", "query_id", "q"])

    return run, "tab int, cell long, query_id long, q binary"


def _rank(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            x = np.array([np.frombuffer(b.as_buffer()) for b in left.column("v").combine_chunks()])
            y = np.array([np.frombuffer(b.as_buffer()) for b in right.column("q").combine_chunks()])
            vec, query = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            for at in range(0, len(y), 512):
                near = y[at:at + 512] @ x.T
                near[query[at:at + 512][:, None] == vec[None, :]] = -np.inf
                low = near.min(axis=1) if len(vec) <= k else np.partition(near, -k, axis=1)[:, -k]
                for i, bound in enumerate(low):
                    pick = np.flatnonzero((near[i] >= bound - 1e-9 * (1 + abs(bound))) & (near[i] > -np.inf)) if bound > -np.inf \
                        else np.flatnonzero(near[i] > -np.inf)
                    # one fixed order of addition, so that equal vectors have equal scores
                    score = (x[pick] * y[at + i]).sum(axis=1)
                    order = np.lexsort((vec[pick], -score))[:k]
                    if len(order):
                        out_q.append(query[at + i])
                        out_v.append(vec[pick][order])
                        out_s.append(score[order])
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vecs": pa.array(out_v, pa.list_(pa.int64())),
                         "scores": pa.array(out_s, pa.list_(pa.float64()))})

    return run


def _merge(k: int):
    def run(group: pa.Table) -> pa.Table:
        lists = group.column("vecs").combine_chunks()
        query = np.repeat(group.column("query_id").to_numpy(), lists.value_lengths().to_numpy())
        vec = lists.flatten().to_numpy()
        score = group.column("scores").combine_chunks().flatten().to_numpy()
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        new = np.ones(len(query), bool)  # the same candidate from another table has the same score
        new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
        query, vec, score = query[new], vec[new], score[new]
        head = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        rank = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query)))) + 1
        keep = rank <= k
        return pa.table({"query_id": query[keep], "rank": rank[keep].astype(np.int32), "vec_id": vec[keep], "score": score[keep]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, tables: int = 2, planes: int = 3, width: float = 1.5,
            reach: float = 0.97, most: int = 4096, block: int = 2048, key: str = "vec_id", column: str = "embedding", seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each query (by default ids divisible by 20)."""
    rows = usable(vectors, key, column)
    made = prepare(rows, k, tables, planes, width, reach, most, seed)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, h = made
    asked = rows.where("pmod(vec_id, 20) = 0") if queries is None else usable(queries, key, column).where(F.size("v") == h.planes.shape[1] - 1)
    run, kind = _index(h)
    index = rows.mapInArrow(run, kind)
    run, kind = _visit(h)
    shards = max(8, asked.count() // 512)
    first = cut(_merged(_candidates(index, asked.mapInArrow(run, kind), k, block), k, shards))
    counts = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    run, kind = _visit(h, again=True)
    probes = cut(asked.join(counts, asked["vec_id"] == counts["query_id"], "left").select("vec_id", "v", "n", "last").mapInArrow(run, kind))
    if probes.isEmpty():
        return first
    held = (first.join(probes.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id")
            .agg(F.collect_list(F.struct("vec_id", "score")).alias("l")).select("query_id", F.col("l.vec_id").alias("vecs"), F.col("l.score").alias("scores")))
    later = _merged(_candidates(index, probes, k, block).union(held), k, shards)
    return first.join(probes.select("query_id").distinct(), "query_id", "left_anti").union(later)


def _candidates(index: DataFrame, probes: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vecs, scores: the best of each block of a visited cell."""
    cells = (index.groupBy("tab", "cell").agg(F.ceil(F.count("*") / block).alias("nv"))
             .join(probes.groupBy("tab", "cell").agg(F.ceil(F.count("*") / block).alias("nq")), ["tab", "cell"]))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = (index.join(cells, ["tab", "cell"]).select("tab", "cell", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), "nv").alias("vb"), spread(F.col("nq")).alias("qb")))
    right = (probes.join(cells, ["tab", "cell"]).select("tab", "cell", "query_id", "q", F.pmod(F.xxhash64("query_id"), "nq").alias("qb"), spread(F.col("nv")).alias("vb")))
    by = ["tab", "cell", "vb", "qb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_rank(k), "query_id long, vecs array<long>, scores array<double>")


def _merged(found: DataFrame, k: int, shards: int) -> DataFrame:
    return (found.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards))).groupBy("shard")
            .applyInArrow(lambda t: _merge(k)(t), "query_id long, rank int, vec_id long, score double"))
