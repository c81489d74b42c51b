"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.lineage import stored


def components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """A row per vertex of ``edges``: node, root. Vertices have the same root if and only if a path joins them.

    Each round draws a new order of the vertices by hash; every vertex moves to its first neighbour, or stays
    if it comes before them all, and the edges move along. Whatever the shape of the graph, a round takes away
    a constant share of the vertices on average, so rounds grow with the logarithm of its size. The first
    neighbour is a minimum, so a vertex with very many edges is reduced before the shuffle. Rounds are written
    to the shared folder. An empty edge table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")

    def tidy(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(a != b)
        return stored(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())

    left, moves = tidy(edges.select(F.col(one).alias("a"), F.col(other).alias("b"))), []
    while not left.isEmpty():
        turn = F.lit(len(moves))
        ways = left.select(F.explode(F.array(
            F.struct(a.alias("node"), b.alias("to")), F.struct(b.alias("node"), a.alias("to")),
        )).alias("w")).select("w.*")
        first = ways.groupBy("node").agg(F.min(F.struct(F.xxhash64("to", turn).alias("h"), "to")).alias("n"))
        stays = F.struct(F.xxhash64("node", turn).alias("h"), F.col("node").alias("to")) < F.col("n")
        move = stored(first.select("node", F.when(stays, F.col("node")).otherwise(F.col("n.to")).alias("root")))
        moves.append(move)
        of_a = move.select(F.col("node").alias("a"), F.col("root").alias("to_a"))
        of_b = move.select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        left = tidy(left.join(of_a, "a").join(of_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    if not moves:
        return left.select(a.alias("node"), b.alias("root"))
    reached = moves.pop()
    while moves:
        later = reached.select(F.col("node").alias("root"), F.col("root").alias("end"))
        reached = moves.pop().join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return reached
