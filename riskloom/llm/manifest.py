"""A Merkle manifest of reports: a digest of the whole set, proofs for single reports, and a check of what is found against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.lineage import stored

#: Nodes that become one node of the next level.
FAN = 8
#: Levels of a superblock, which has 4,096 leaves then.
HEIGHT = 4
#: What a leaf is made of.
FIELDS = ("report_id", "report_type", "location", "source", "report_text")

_ROOTS = "tree string, block long, blocks long, digest string"
_WAYS = "tree string, rank long, path array<string>, top string"
_LEAVES = "key string, tree string, leaf string, subroot string, root string, proof array<string>, folded_root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values: each ``-`` if null, else its bytes in UTF-8 counted, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes, and the levels above them, up to ``height`` of them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def height_of(leaves: int) -> int:
    """Levels until one node remains."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FAN), height + 1
    return height


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and its siblings give: those to its left and to its right, level by level."""
    for left, right in zip(path[::2], path[1::2]):
        node = digest(left + node + right)
    return node


def _tower(rows: pd.DataFrame, height: int) -> list[list[str]]:
    """The levels of one superblock. A tree of one superblock ends at its top, others go on above."""
    size = int(rows["size"].iloc[0])
    return levels(rows["digest"].tolist(), height if size > FAN**height else height_of(size))


def _root(height: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        return pd.DataFrame({
            "tree": rows["tree"].iloc[:1], "block": rows["block"].iloc[:1], "blocks": [-(-int(rows["size"].iloc[0]) // FAN**height)],
            "digest": [_tower(rows, height)[-1][0]]})

    return run


def _ways(height: int):
    """Each node's path to the top: within its superblock, and on from there; and what the leaf found folds to."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        tower = _tower(rows, height)
        on, top = list(above["path"].iloc[0]), above["top"].iloc[0]
        paths = []
        for at in range(len(rows)):
            path = []
            for level in tower[:-1]:
                first = at // FAN * FAN
                path += ["".join(level[first:at]), "".join(level[at + 1 : first + FAN])]
                at //= FAN
            paths.append(path + on)
        if "found" not in rows:
            return pd.DataFrame({"tree": rows["tree"], "rank": rows["rank"], "path": paths, "top": top})
        return pd.DataFrame({
            "key": rows["key"], "tree": rows["tree"], "leaf": rows["digest"], "subroot": above["subroot"].iloc[0], "root": top, "proof": paths,
            "folded_root": [fold(n, p) for n, p in zip(rows["found"], paths)]})

    return run


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / FAN**height))


def _above(nodes: DataFrame, height: int) -> DataFrame:
    """For each superblock: tree, block, path from its root to the top of its tree, top. The roots make trees of their own."""
    blocked = _blocked(nodes, height).select("tree", "rank", "block", "size", "digest")
    roots = stored(blocked.groupBy("tree", "block").applyInPandas(_root(height), _ROOTS))
    done = roots.filter("blocks = 1").select("tree", "block", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    going = roots.filter("blocks > 1")
    if going.isEmpty():
        return done
    nodes = going.select("tree", F.col("block").alias("rank"), F.col("blocks").alias("size"), "digest")
    ways = _finished(nodes, _above(nodes, height), _WAYS, height)
    return done.unionByName(ways.select("tree", F.col("rank").alias("block"), "path", "top"))


def _finished(nodes: DataFrame, above: DataFrame, schema: str, height: int) -> DataFrame:
    """Nodes and what stands above their superblock, brought together."""
    return _blocked(nodes, height).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(_ways(height), schema)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their rank within their tree, from 0, and its size. Sorted in parallel: a tree of most rows fills many partitions."""
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    sorted_rows = stored(spread.withColumns({"task": F.spark_partition_id(), "seat": F.monotonically_increasing_id()}))
    counts = sorted_rows.groupBy("tree", "task").agg(F.count("*").alias("number"), F.min("seat").alias("first"))
    # A row for each task that holds a part of the tree.
    before = Window.partitionBy("tree").orderBy("task")
    starts = counts.select(
        "tree", "task", "first", F.sum("number").over(Window.partitionBy("tree")).alias("size"),
        (F.sum("number").over(before) - F.col("number")).alias("done"))
    ranked = sorted_rows.join(starts, ["tree", "task"]).withColumn("rank", F.col("seat") - F.col("first") + F.col("done"))
    return ranked.drop("task", "seat", "first", "done")


def merkle_manifest(
    reports: DataFrame, fields: Sequence[str] = FIELDS, group: str = "report_type", found: Mapping[str, Column] | None = None, key: str = "report_id",
    height: int = HEIGHT,
) -> DataFrame:
    """Digests of reports, their proofs, and whether what is found of each report still belongs to the set.

    A report's leaf is the SHA-256 (lower-case hexadecimal) of its ``fields``: each ``-`` if null, else the number of its bytes in
    UTF-8, a colon and the value. The leaves of one ``group`` (a null is a group of its own) ascend by ``key``, nulls first; runs of 8
    become the digest of their digests until one remains, the subroot. Subroots by group, null first and then by bytes, likewise
    give the root. ``found`` has, for some fields, the values found at a later time or in a copy; by default all are as recorded.

    Result, a row per report: the key, ``group``, leaf, subroot, root, proof (for each level up to the root two texts: the digests to the
    left of the node in its run, and those to the right), folded_root (from the leaf found and the proof), verified (it is the root).

    Leaves are made where the texts are read; after that only digests travel. Leaves are cogrouped with the nodes above their superblock
    (4,096 leaves) and finished there: levels, proof and folding. The roots of superblocks are the leaves of smaller trees of the same
    kind, so that no task ever holds more than a superblock, however large a group is.

    Reports with equal keys stand in the order of their leaves; equal rows are rows of their own. A null or an empty text is a value as any
    other, and so is a null key. A table without rows gives none.
    """
    now = {f: (found or {}).get(f, F.col(f)) for f in fields}
    # A null group comes first, also before the empty text.
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    shown = reports.select(
        tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), leaf([now[f] for f in fields]).alias("found"))
    leaves = stored(_ranked(shown, "key", "digest", "found").withColumn("key", F.col("key").cast("string")))
    under = stored(_above(leaves, height))
    # The top of every tree is a leaf of the tree of trees.
    tops = under.groupBy("tree").agg(F.first("top").alias("digest")).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    last = stored(_ranked(tops, "name"))
    names = last.select("rank", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
    roots = last.select("tree", "rank", "size", "digest")
    upper = _finished(roots, _above(roots, height), _WAYS, height).select("rank", F.col("path").alias("rest"), F.col("top").alias("root"))
    above = under.join(names.join(upper, "rank"), "tree").select(
        "tree", "block", "subroot", F.concat("path", "rest").alias("path"), F.col("root").alias("top"))
    types = reports.schema
    return _finished(leaves, above, _LEAVES, height).select(
        F.col("key").cast(types[key].dataType).alias(key), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast(types[group].dataType).alias(group),
        "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
