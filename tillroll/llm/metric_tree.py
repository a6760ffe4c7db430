"""Operator 11, exact top-k by inner product with an M-tree searched best first.

Components become integers, floor(scale * x).  With M the largest norm, a vector x gets one more component
sqrt(M^2 - |x|^2) and a query a zero there; then |q - x|^2 = M^2 + |q|^2 - 2 <q, x>, so the largest inner
products are the least Euclidean distances, a metric.  Distances only prune, with a margin above their
rounding error; scores are integers.

* *Tree.*  A node has a routing object (one of its vectors), a covering radius and the distance to its parent's
  routing object.  Nodes of more than ``subtree`` vectors are split in rounds: up to ``FAN`` routing objects are
  drawn by a hash, each vector goes to the nearest (equal ones share ties by a hash), in blocks of a node so
  that a node of most rows is no single task.  After ``NEAR_ROUNDS`` rounds vectors are dealt by the hash alone,
  which any shape of data can't keep from ending.  A node that is small enough is cut into pages of at most ``PAGE`` entries in one
  task and stored as one row a page.
* *Search.*  Each query descends to its nearest subtree first, which gives its k-th score so far; then it descends
  again through all nodes that this leaves, and visits their subtrees in rounds by ascending lower bound, each
  round with the k-th score of the former ones.  In a subtree a queue gives the page with the least lower bound, until that exceeds the
  k-th distance; stored parent distances rule entries out by the triangle inequality before any distance is computed.
  Queries of a subtree are dealt in blocks, each of which meets the subtree's pages.

Nothing is approximate: vectors without structure only let less be ruled out.  Defined results: vectors that are null or hold null
or non-finite components and rows with a null id take no part; a shorter vector counts as ending in zeros; of rows with one id
the least vector counts; components of 2^31 or more after scaling raise; fewer candidates than ``k`` give fewer ranks;
equal scores go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bounded, columns, cut
from .words import mix

FAN, PAGE, NEAR_ROUNDS = 64, 64, 6
#: Vectors, and queries of one node, that a task takes at a time.
BLOCK = 8192
#: Subtrees of a query visited in the first round after its nearest one; each later round takes this many times more.
WIDER = 8


@dataclass(frozen=True)
class Space:
    """The metric: ``square`` is the largest squared norm, ``dim`` the length of vectors, ``exact`` whether doubles hold every score."""
    square: float
    dim: int
    exact: bool

    def rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.square - (x * x).sum(axis=1)))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all vectors ``x`` to all ``y``."""
        both = x @ y.T + self.rest(x)[:, None] * self.rest(y)[None, :]
        return np.sqrt(np.maximum(0.0, 2.0 * (self.square - both)))

    def far(self, query_square: float, score):
        """The distance of a query to a vector with that inner product."""
        return np.sqrt(np.maximum(0.0, self.square + query_square - 2.0 * score))

    def margin(self, query_square: float) -> float:
        return 1e-6 * (math.sqrt(self.square) + math.sqrt(query_square)) + 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype(np.int32).ravel()))


def _nearest(distance: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """For each row one of the columns at its least distance, by a hash of the id."""
    least = distance <= distance.min(axis=1, keepdims=True) + 1e-9
    ties = least.sum(axis=1)
    turn = (mix(ids.astype(np.uint64) + np.uint64(seed)) % ties.astype(np.uint64)).astype(np.int64)
    return (np.cumsum(least, axis=1) > turn[:, None]).argmax(axis=1)


# --- building -----------------------------------------------------------------------------------------

def _assign(space: Space, by_hash: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The vectors of a block of one node with their child and the distance to its routing object."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("v")).reshape(left.num_rows, space.dim)
        right = right.sort_by("child")
        distance = space.between(x, _matrix(right.column("pivot")).reshape(right.num_rows, space.dim))
        pick = _nearest(np.zeros_like(distance) if by_hash else distance, ids, 11) if left.num_rows else np.zeros(0, np.int64)
        return pa.table({"vec_id": ids, "v": left.column("v"), "node": right.column("child").to_numpy()[pick],
                         "dist": distance[np.arange(len(ids)), pick]})

    return run


def _split(rows: DataFrame, sizes: DataFrame, space: Space, subtree: int, level: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their new nodes, the new nodes) for the nodes of more than ``subtree`` vectors among ``rows``."""
    big = bounded(sizes.where(F.col("n") > subtree))
    inside = rows.join(big, "node")
    share = F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("vec_id", F.lit(level)), "vec_id"))
    fan = F.least(F.lit(FAN), 2 * F.ceil(F.col("n") / subtree))
    pivots = (inside.where(share <= (2.0 * FAN + 20) / F.col("n")).withColumn("turn", turn).where(F.col("turn") <= fan)
              .select("node", (F.col("node") * FAN + F.col("turn") - 1).alias("child"), F.col("v").alias("pivot"), F.col("dist").alias("parent_dist"), "n"))
    pivots = cut(pivots)
    blocks = F.ceil(F.col("n") / BLOCK)
    left = inside.select("vec_id", "v", "node", F.pmod(F.xxhash64("vec_id"), blocks).alias("block"))
    right = pivots.select("node", "child", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same rows
    placed = cut(left.groupBy("node", "block").cogroup(right.groupBy("node", "block"))
                 .applyInArrow(_assign(space, level > NEAR_ROUNDS), "vec_id long, v array<int>, node long, dist double"))
    reach = placed.groupBy("node").agg(F.max("dist").alias("radius"), F.count("*").alias("size"))
    made = pivots.join(reach.withColumnRenamed("node", "child"), "child").select("node", "child", "pivot", "radius", "parent_dist", "size")
    return placed, cut(made)


def _paged(ids: np.ndarray, x: np.ndarray, dist: np.ndarray, space: Space) -> list[dict]:
    """Pages of one subtree, the first its root: entries with their radius and the distance to the page's routing object."""
    order = np.lexsort((ids, mix(ids.astype(np.uint64))))
    ids, x, dist = ids[order], x[order], dist[order]
    pages: list[dict] = [{}]
    open_pages = [(0, np.arange(len(ids)), dist)]
    while open_pages:
        at, own, to_parent = open_pages.pop()
        if len(own) <= PAGE:
            pages[at] = {"leaf": True, "entry": ids[own], "vectors": x[own], "radii": np.zeros(len(own)), "dists": to_parent}
            continue
        fan = min(PAGE, 2 * -(-len(own) // PAGE))
        pick = _nearest(space.between(x[own], x[own[:fan]]), ids[own], at)
        if np.bincount(pick, minlength=fan).max() > 0.9 * len(own):  # no nearer to an end: equal parts by distance
            pick = np.empty(len(own), np.int64)
            pick[np.argsort(to_parent, kind="stable")] = np.arange(len(own)) * fan // len(own)
        children, routing, radii = [], [], []
        for c in range(fan):
            inside = np.flatnonzero(pick == c)
            if len(inside):
                route = c if pick[c] == c else int(inside[0])
                near = space.between(x[own[inside]], x[own[route]][None, :])[:, 0]
                children.append(len(pages))
                routing.append(route)
                radii.append(near.max())
                open_pages.append((len(pages), own[inside], near))
                pages.append({})
        pages[at] = {"leaf": False, "entry": np.array(children), "vectors": x[own[routing]], "radii": np.array(radii), "dists": to_parent[routing]}
    return pages


PAGES = "node long, page int, leaf boolean, entry array<long>, vectors array<int>, radii array<double>, dists array<double>"


def _pages(space: Space) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v")).reshape(group.num_rows, space.dim)
        made = _paged(group.column("vec_id").to_numpy(), x, group.column("dist").to_numpy(zero_copy_only=False).astype(float), space)
        return pa.table({"node": pa.array([group.column("node")[0].as_py()] * len(made), pa.int64()), "page": pa.array(range(len(made)), pa.int32()),
                         "leaf": pa.array([p["leaf"] for p in made], pa.bool_()), "entry": pa.array([p["entry"] for p in made], pa.list_(pa.int64())),
                         "vectors": pa.array([p["vectors"].astype(np.int32).ravel() for p in made], pa.list_(pa.int32())),
                         "radii": pa.array([p["radii"] for p in made], pa.list_(pa.float64())),
                         "dists": pa.array([p["dists"] for p in made], pa.list_(pa.float64()))})

    return run


@dataclass
class Tree:
    space: Space
    levels: list[DataFrame]  # node (the parent), child, pivot, radius, parent_dist, size; from the root down
    pages: DataFrame         # PAGES


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v (integers) of the rows that take part, one for each id."""
    rows = columns(vectors, key, column).toDF("vec_id", "v").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    wide = F.raise_error(F.lit("a scaled component has more than 31 bits")).cast("int")
    fit = lambda y: F.when((y >= -2147483648.0) & (y < 2147483648.0), y.cast("int")).otherwise(wide)
    rows = rows.select("vec_id", F.transform("v", lambda x: fit(F.floor(x * float(scale)).cast("double"))).alias("v"))
    again = cut(rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    return rows.join(again, "vec_id", "left_anti").union(rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def build(rows: DataFrame, subtree: int = BLOCK) -> Tree | None:
    """The tree over ``rows`` (vec_id, v); None for no rows."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = rows.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("square"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("long"))))).alias("most")).first()
    if stats.dim is None:
        return None
    dim, most = max(1, stats.dim), stats.most or 0
    if most * most * dim >= 1 << 62:
        raise ValueError("inner products of these vectors don't fit in 63 bits")
    space = Space(float(stats.square) * (1 + 1e-12), dim, most * most * dim < 1 << 52)
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    rows = cut(rows.select("vec_id", padded.alias("v"), F.lit(1).cast("long").alias("node"), F.lit(float("nan")).alias("dist")))
    done, levels = [], []
    while True:
        sizes = cut(rows.groupBy("node").agg(F.count("*").alias("n")))
        if sizes.where(F.col("n") > subtree).isEmpty():
            break
        if len(levels) == 9:
            raise RuntimeError("the tree has more levels than its node ids can hold")
        small = rows.join(bounded(sizes.where(F.col("n") <= subtree).select("node")), "node", "left_semi")
        done.append(small.select("vec_id", "v", "node", "dist"))
        rows, made = _split(rows, sizes, space, subtree, len(levels) + 1)
        levels.append(made)
    for part in done:
        rows = rows.union(part)
    return Tree(space, levels, cut(rows.groupBy("node").applyInArrow(_pages(space), PAGES)))


# --- searching ----------------------------------------------------------------------------------------

def best_first(pages: list[dict], query: np.ndarray, own: int, k: int, space: Space, to_root: float, kth: float,
               counts: list[int] | None = None) -> list[tuple[int, int]]:
    """At most ``k`` (score, id) of a subtree, best first: all that may be among the query's k best.

    ``to_root`` is the query's distance to the root page's routing object (or nan) and ``kth`` a score that k other vectors reach (or
    -inf).  ``counts`` gets the distances computed and those that parent distances ruled out.
    """
    square, margin = float(query @ query), space.margin(float(query @ query))
    whole = query if space.exact else query.astype(np.int64)
    limit = lambda score: math.inf if score == -math.inf else float(space.far(square, float(score))) + margin
    best: list[tuple[int, int]] = []
    reach, queue = limit(kth), [(0.0, 0, to_root)]
    while queue:
        bound, at, to_parent = heapq.heappop(queue)
        if bound > reach:
            break
        page = pages[at]
        if math.isnan(to_parent) or reach == math.inf:
            some = np.arange(len(page["entry"]))
        else:
            some = np.flatnonzero(~(np.abs(to_parent - page["dists"]) - page["radii"] > reach))  # a nan rules nothing out
        if counts is not None:
            counts[0] += len(some)
            counts[1] += len(page["entry"]) - len(some)
        scores = page["vectors"][some] @ whole
        if page["leaf"]:
            near = np.flatnonzero((scores >= kth) & (page["entry"][some] != own))
            best += zip((-scores[near]).tolist(), page["entry"][some[near]].tolist(), strict=True)
            best = heapq.nsmallest(k, best)
            if len(best) == k and -best[-1][0] > kth:
                kth = -best[-1][0]
                reach = limit(kth)
        else:
            distance = space.far(square, scores.astype(float))
            for entry, d, r in zip(page["entry"][some].tolist(), distance.tolist(), page["radii"][some].tolist(), strict=True):
                if d - r <= reach:
                    heapq.heappush(queue, (max(bound, d - r), entry, d))
    return [(int(-score), vec) for score, vec in best]


def _search(space: Space, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pages: list[dict] = [{}] * left.num_rows
        for row in range(left.num_rows):
            get = lambda name: left.column(name)[row]  # noqa: B023, E731
            x = get("vectors").values.to_numpy(zero_copy_only=False).astype(np.float64 if space.exact else np.int64)
            pages[get("page").as_py()] = {
                "leaf": get("leaf").as_py(), "entry": get("entry").values.to_numpy(zero_copy_only=False), "vectors": x.reshape(-1, space.dim),
                "radii": get("radii").values.to_numpy(zero_copy_only=False), "dists": get("dists").values.to_numpy(zero_copy_only=False)}
        queries, found = right.column("query_id").to_pylist(), []
        starts = zip(right.column("dist").to_pylist(), right.column("kth").to_pylist(), strict=True)
        for query, q, (dist, kth) in zip(queries, _matrix(right.column("q")), starts, strict=True):
            found.append(best_first(pages, q, query, k, space, math.nan if dist is None else dist, -math.inf if kth is None else kth) if pages else [])
        return pa.table({"query_id": pa.array(queries, pa.int64()), "vecs": pa.array([[v for _, v in f] for f in found], pa.list_(pa.int64())),
                         "scores": pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64()))})

    return run


def _expand(space: Space) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The children of one node that each query of a block must still look at."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        child, pivot = right.column("child").to_numpy(), _matrix(right.column("pivot")).reshape(right.num_rows, space.dim)
        radius = right.column("radius").to_numpy()
        to_parent = right.column("parent_dist").to_numpy(zero_copy_only=False).astype(float)
        rows, nodes, dists, bounds = [], [], [], []
        starts = zip(left.column("dist").to_pylist(), left.column("kth").to_pylist(), strict=True)
        for row, (q, (dist, kth)) in enumerate(zip(_matrix(left.column("q")), starts, strict=True)):
            square = float(q @ q)
            reach = math.inf if kth is None else float(space.far(square, float(kth))) + space.margin(square)
            some = np.arange(len(child)) if dist is None else np.flatnonzero(~(np.abs(dist - to_parent) - radius > reach))
            far = space.far(square, pivot[some] @ q)
            near = far - radius[some] <= reach
            rows += [row] * int(near.sum())
            nodes.append(child[some][near])
            dists.append(far[near])
            bounds.append(np.maximum(0.0, far - radius[some])[near])
        out = left.select(["query_id", "q", "kth"]).take(pa.array(rows, pa.int64()))
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return out.append_column("node", flat(nodes, pa.int64())).append_column("dist", flat(dists, pa.float64())).append_column("bound", flat(bounds, pa.float64()))

    return run


_FRONT = "query_id long, q array<int>, kth long, node long, dist double, bound double"


def _meet(left: DataFrame, right: DataFrame, run, kind: str, pages_left: bool = False) -> DataFrame:
    """``run`` on the queries of ``left``, in blocks of a node, and the rows of ``right`` of that node."""
    sizes = cut(left.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    kept = bounded(sizes)
    queries = left.join(kept, "node").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).drop("blocks")
    spread = right.join(kept, "node").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    queries, spread = queries.toDF(*queries.columns), spread.toDF(*spread.columns)  # columns of their own
    x, y = queries.groupBy("node", "block"), spread.groupBy("node", "block")
    return (y.cogroup(x) if pages_left else x.cogroup(y)).applyInArrow(run, kind)


def _descend(tree: Tree, start: DataFrame, nearest: bool) -> DataFrame:
    """The subtrees (node) that each query must visit, with ``bound``; only the nearest on the way if ``nearest``."""
    out, front = [], start
    for level, nodes in enumerate(tree.levels):
        front = _meet(front, nodes, _expand(tree.space), _FRONT)
        if nearest:
            least = F.min(F.struct("bound", "node", "dist", "q", "kth")).alias("r")
            front = front.groupBy("query_id").agg(least).select("query_id", "r.q", "r.kth", "r.node", "r.dist", "r.bound")
        front = cut(front)
        if level + 1 < len(tree.levels):
            inner = bounded(tree.levels[level + 1].select("node").distinct())
            out.append(front.join(inner, "node", "left_anti").select(*front.columns))
            front = front.join(inner, "node", "left_semi").select(*front.columns)
    for part in out:
        front = front.union(part)
    return front


def _visit(tree: Tree, visits: DataFrame, held: DataFrame | None, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``held`` and of the subtrees in ``visits``."""
    found = _meet(visits, tree.pages, _search(tree.space, k), "query_id long, vecs array<long>, scores array<long>", pages_left=True)
    rows = found.select("query_id", F.explode(F.arrays_zip("vecs", "scores")).alias("r")).select("query_id", F.col("r.vecs").alias("vec_id"), F.col("r.scores").alias("score"))
    rows = rows if held is None else rows.union(held.select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cut(rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search(tree: Tree, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each of ``queries`` (query_id, q: integers of the tree's length)."""
    none = lambda kind: F.lit(None).cast(kind)
    start = cut(queries.select("query_id", "q", none("long").alias("kth"), F.lit(1).cast("long").alias("node"), none("double").alias("dist"), F.lit(0.0).alias("bound")))
    first = _descend(tree, start, nearest=True)
    held = _visit(tree, first, None, k)
    if not tree.levels:
        return held
    told = lambda rows: rows.drop("kth").join(held.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "query_id", "left")
    front = _descend(tree, cut(told(start).select(*start.columns)), nearest=False)
    front = cut(front.join(first.select("query_id", "node"), ["query_id", "node"], "left_anti")
                .withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("bound", "node"))))
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    margin = (math.sqrt(tree.space.square) + F.sqrt(square)) * 1e-6 + 1e-9
    reach = F.sqrt(F.greatest(F.lit(0.0), F.lit(tree.space.square) + square - 2.0 * F.col("kth"))) + margin
    most = front.agg(F.max("turn")).first()[0] or 0
    done, until = 0, WIDER
    while done < most:
        now = told(front.where((F.col("turn") > done) & (F.col("turn") <= until))).where(F.col("kth").isNull() | (F.col("bound") <= reach))
        held = _visit(tree, now.select(*start.columns), held, k)
        done, until = until, until * WIDER
    return held


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, subtree: int = BLOCK, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all others."""
    tree = build(integers(vectors, key, column, scale), subtree)
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    entries = tree.pages.where("leaf").select(F.posexplode("entry").alias("i", "query_id"), "vectors").where(F.col("query_id") % every == 0)
    dim = F.lit(tree.space.dim)
    return search(tree, entries.select("query_id", F.slice("vectors", F.col("i") * dim + 1, dim).alias("q")), k)
