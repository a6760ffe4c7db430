"""Operator 13, a Merkle manifest of a dataset, checked by a recursive query that climbs from every leaf.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
Leaves of a group (``lang``) ascend by id; while more than one node remains, every ``FAN`` consecutive
ones become the hash of their digests (lowercase hex, concatenated), the last of a level of fewer, even of
one.  What remains is the group's subroot; the subroots, ordered by group, give the root in the same way.

* *Order.*  ``assign_keys`` numbers the rows on range partitions of (group, id, digest), so a group that holds
  most rows isn't one task's.  Places, parents and slots are arithmetic on these numbers and on the group's
  first one; no window runs over a group.
* *Levels.*  Each level is one grouped aggregate over ``FAN`` rows a key, written to the checkpoint folder as
  node rows: id, parent, slot and the digests of its children.  A level has an eighth of the rows of the one below.
* *Climb.*  ``WITH RECURSIVE`` ascends one level a step for all leaves: it joins the parent's row, appends the
  siblings (as one more row of the leaf that names them by parent and slot, 60 bytes instead of seven digests),
  and folds the claimed digest with them.  The top levels, whose nodes together are at most ``UPPER`` rows, are
  climbed by a second such query against a broadcast, so that no join key has a share of the leaves that grows with
  the table.  One aggregate by leaf then hashes the digests of its siblings in order of the level.

Defined results: null ids and null groups come first, equal ids ascend by digest, identical rows are leaves each;
a single leaf is its group's subroot, a single subroot the root, and no siblings hash as the empty text; an
empty table gives no rows; texts of any length are hashed whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.sequence import assign_keys

from .tables import bounded, columns, cut

FAN = 8
#: Bits of a node id that hold its level; levels of the tree of subroots start at TOP.
LEVEL_BITS, TOP = 6, 32
#: Node rows that are broadcast at most, about 300 bytes each (20 MB).
UPPER = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """One field as it is hashed."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(written, values)).cast("binary"), 256))


def _hash_hex(digests: Column) -> Column:
    """The digest over hex digests, from their bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)).cast("binary"), 256))


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` of them: the least t with FAN ** t >= n."""
    return reduce(lambda a, b: a + b, ((n > FAN ** t).cast("int") for t in range(20)))


def _id(level: Column | int, first: Column) -> Column:
    return (first * (1 << LEVEL_BITS) + level).cast("long")


def _links(level: int, top: bool) -> tuple[Column, Column]:
    """(parent, slot) of a node of ``level`` whose first leaf is ``first`` in the tree that starts at ``start``.

    A group's subroot goes on as leaf ``j`` of the top tree; the root has no parent.
    """
    step = F.col("first") - F.col("start")
    span = FAN ** (level + 1)
    inside = _id(level + 1 + (TOP if top else 0), F.col("start") + step - step % span)
    slot = F.floor(step / F.lit(FAN ** level)).cast("long") if level > 15 else F.call_function("div", step, F.lit(FAN ** level))
    parent, slot = F.when(F.col("depth") > level, inside), F.when(F.col("depth") > level, slot % FAN)
    if not top:
        above = F.when(F.col("top_depth") > 0, _id(TOP + 1, F.col("j") - F.col("j") % FAN))
        parent, slot = F.coalesce(parent, above), F.coalesce(slot, F.when(F.col("top_depth") > 0, F.col("j") % FAN))
    return parent.cast("long").alias("parent"), slot.cast("int").alias("slot")


_TREE = ("start", "depth", "j", "top_depth")


def _climbed(nodes: DataFrame, level: int, top: bool) -> DataFrame:
    """Nodes of the next level from those of ``level`` (first, digest, parent, slot and the tree's columns)."""
    pairs = F.array_sort(F.collect_list(F.struct("slot", "digest")))
    children = F.unhex(F.array_join(F.transform(pairs, lambda p: F.hex(p.digest)), ""))
    up = (nodes.where(F.col("depth") > level).groupBy("parent", *_TREE).agg(children.alias("children"))
          .select(F.col("parent").alias("id"), F.shiftright("parent", LEVEL_BITS).alias("first"), "children", _hash_hex(F.col("children")).alias("digest"), *_TREE))
    return up.select("*", *_links(level + 1, top))


@dataclass
class Manifest:
    leaves: DataFrame    # g (place), key, leaf, claimed, j (group), parent, slot
    nodes: DataFrame     # id, parent, slot, children (digests side by side)
    subroots: DataFrame  # j, subroot
    root: bytes | None   # of an empty table: None


def build(rows: DataFrame, key: str, group: str, leaf: str = "leaf", claimed: str = "claimed") -> Manifest:
    """The tree over ``rows`` (key, group, digest of the leaf, digest claimed for it; both binary)."""
    rows = cut(rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(leaf).alias("leaf"), F.col(claimed).alias("claimed"),
                           F.monotonically_increasing_id().alias("spread")))  # many identical rows go to several ranges; hashed once
    placed = assign_keys(rows, "g", ["grp", "key", "leaf", "spread"], -1).drop("spread")
    groups = placed.groupBy("grp").agg(F.min("g").alias("start"), F.count("*").alias("n"))
    groups = cut(assign_keys(groups, "j", ["start"], -1).select("grp", "start", "j", _depth(F.col("n")).alias("depth")))
    n_groups, deepest = groups.agg(F.count("*"), F.max("depth")).first()
    if not n_groups:
        empty = rows.sparkSession.createDataFrame([], "j long, subroot binary")
        return Manifest(placed, empty, empty, None)
    top_depth = next(t for t in range(20) if FAN ** t >= n_groups)
    trees = bounded(groups.withColumn("top_depth", F.lit(top_depth)).withColumnRenamed("grp", "_grp"))
    leaves = (placed.join(trees, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp", "grp").withColumn("first", F.col("g"))
              .select("g", "key", "leaf", "claimed", "first", F.col("leaf").alias("digest"), *_TREE))
    leaves = cut(leaves.select("*", *_links(0, False)))
    levels, roots, now = [], [], leaves
    for level in range(deepest + 1):
        roots.append(now.where(F.col("depth") == level).select("j", F.col("digest").alias("subroot")))
        if level < deepest:
            now = cut(_climbed(now, level, False))
            levels.append(now)
    subroots = cut(reduce(DataFrame.union, roots))
    now = subroots.select(F.col("j").alias("first"), F.col("subroot").alias("digest"), F.lit(0).cast("long").alias("start"), F.lit(top_depth).alias("depth"),
                          F.lit(0).cast("long").alias("j"), F.lit(top_depth).alias("top_depth"))
    now = now.select("*", *_links(0, True))
    for level in range(top_depth):
        now = cut(_climbed(now, level, True))
        levels.append(now)
    root = bytes(now.select("digest").first().digest)  # one row
    kind = "id long, parent long, slot int, children binary"
    nodes = [x.select("id", "parent", "slot", "children") for x in levels] or [rows.sparkSession.createDataFrame([], kind)]
    return Manifest(leaves.select("g", "key", "leaf", "claimed", "j", "parent", "slot"), reduce(DataFrame.union, nodes), subroots, root)


#: One step: the parent's row, the digest folded with its other children, and where the next siblings stand.
CLIMB = """
WITH RECURSIVE climb(g, level, parent, slot, folded) AS (
  SELECT g, level, parent, slot, folded FROM {start}
  UNION ALL
  SELECT g, level + 1, n.parent, n.slot,
         unhex(sha2(cast(lower(hex(concat(substring(n.children, 1, 32 * c.slot), c.folded, substring(n.children, 32 * c.slot + 33)))) AS BINARY), 256))
  FROM climb c JOIN {nodes} n ON n.id = c.parent)
SELECT * FROM climb
"""
#: Rows of all levels come from one recursive query; Spark's default would end it at a million.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(tree: Manifest) -> DataFrame:
    """g, folded_root, proof_sha256 of each leaf with a parent: its claimed digest folded with the stored siblings up to the root."""
    spark = tree.leaves.sparkSession
    level = lambda c: F.col(c).bitwiseAND((1 << LEVEL_BITS) - 1)
    sizes = {r.level: r.n for r in tree.nodes.groupBy(level("id").alias("level")).agg(F.count("*").alias("n")).collect()}  # a row a level
    cutoff, held = 1 << LEVEL_BITS, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > UPPER:
            break
        cutoff = at
    start = tree.leaves.where("parent IS NOT NULL").select("g", F.lit(0).alias("level"), "parent", "slot", F.col("claimed").alias("folded"))
    upper, lower = F.broadcast(tree.nodes.where(level("id") >= cutoff)), tree.nodes.where(level("id") < cutoff)
    near = F.coalesce(level("parent") < cutoff, F.lit(False))
    lean = lambda rows, ended: rows.withColumn("folded", F.when(ended, F.col("folded")))

    def paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """g, the last folded digest, and the siblings of each step side by side."""
        rows = rows.join(nodes.select(F.col("id").alias("parent"), "children"), "parent", "left")
        siblings = F.concat(F.expr("substring(children, 1, 32 * slot)"), F.expr("substring(children, 32 * slot + 33)"))
        steps = F.array_sort(F.collect_list(F.when(F.col("children").isNotNull(), F.struct("level", siblings.alias("siblings")))))
        return rows.groupBy("g").agg(F.max_by("folded", "level").alias("folded"), F.array_join(F.transform(steps, lambda p: F.hex(p.siblings)), "").alias("path"))

    below = None
    if cutoff > 1:
        low = cut(lean(spark.sql(CLIMB, start=start, nodes=lower), ~near))
        start, below = low.where(~near), paths(low.where(near), lower).select("g", F.col("path").alias("below"))
    # the broadcast gives the upper siblings after the rows of a leaf have met, so that they aren't shuffled
    above = paths(lean(spark.sql(CLIMB, start=start, nodes=upper), F.col("parent").isNull()).repartition("g"), upper)
    above = above.withColumn("below", F.lit("")) if below is None else above.join(below, "g", "left")
    return above.select("g", F.lower(F.hex("folded")).alias("folded_root"),
                        F.sha2(F.lower(F.concat(F.coalesce("below", F.lit("")), "path")).cast("binary"), 256).alias("proof_sha256"))


def verify(tree: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf."""
    spark = tree.leaves.sparkSession
    out = "key {0}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if tree.root is None:
        return spark.createDataFrame([], out.format(tree.leaves.schema["key"].dataType.simpleString()))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        folded = cut(climb(tree))  # the recursion runs here, under its setting
    finally:
        spark.conf.set(ROW_LIMIT, before)
    root = tree.root.hex()
    hexed = lambda c: F.lower(F.hex(c))
    rows = tree.leaves.join(bounded(tree.subroots), "j").join(folded, "g", "left")
    folded_root = F.coalesce("folded_root", hexed("claimed"))  # a leaf without a parent is the root
    return rows.select("key", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root).alias("root"),
                       F.coalesce("proof_sha256", F.sha2(F.lit(b""), 256)).alias("proof_sha256"), folded_root.alias("folded_root"),
                       (folded_root == root).alias("verified"))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, fields: tuple[str, ...] = FIELDS,
             key: str = "doc_id", group: str = "lang") -> DataFrame:
    """The manifest of ``docs`` and, for rows ``where`` holds, the check of a copy whose fields are replaced by ``tampered``."""
    rows = columns(docs, *dict.fromkeys((*fields, key, group)))
    changed = leaf_digest(*((tampered or {}).get(f, F.col(f)) for f in fields))
    rows = rows.select(key, group, leaf_digest(*map(F.col, fields)).alias("leaf"),
                       (F.when(where, changed) if tampered and where is not None else F.lit(None).cast("binary")).alias("changed"))
    return verify(build(rows.withColumn("claimed", F.coalesce("changed", "leaf")), key, group)).withColumnRenamed("key", key)
