"""Recurring patterns kept up to date as analysed reports arrive: new texts probe the stored ones, and changed patterns alone are worked out anew."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskloom.functions import graph
from riskloom.functions import vectors as VX
from riskloom.functions.lineage import scope, stored
from riskloom.operators import patterns as PT
from riskloom.operators import persist as P
from riskloom.operators import similar as SIM
from riskloom.packs import wording as W
from riskloom.streaming.keyed_table import KeyedTable

#: Columns of the reports that come in: analysed, with their place in the order of all reports.
ANALYSED = "report_id string, pos long, report_text string, created_at timestamp, activity string, hazard string, barrier string, barrier_status string"
_TEXTS = "block int, vid string, text string, vec array<double>, first long, copies long, grp string"
_TALLIES = "grp string, kind string, value string, n long, seen long"
_PATTERNS = (
    "cluster string, number_of_reports long, first long, representative_text string, average_similarity double, trend_direction string, "
    "first_seen timestamp, last_seen timestamp, span_days long, date_counts map<string,bigint>, common_activity string, common_hazard string, "
    "common_barrier_failure string, recommended_action string"
)
_PLAN = f"{_TEXTS}, angle double, fresh boolean, cluster string"


def _counted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Texts of both; a known one has the copies of both and the group that it has been in."""
    rest = F.first(F.struct("text", "vec", "grp")).alias("t")
    both = old.unionByName(new).groupBy("block", "vid").agg(rest, F.min("first").alias("first"), F.sum("copies").alias("copies"))
    return both.select("block", "vid", "t.text", "t.vec", "first", "copies", "t.grp")


def _tallied(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("grp", "kind", "value").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))


class PatternTables:
    """Texts, groups, tallies and patterns under a path, equal to :func:`riskloom.operators.patterns.semantic_patterns` of all reports so far.

    *Texts* stand in blocks around pivots that the first batch with texts gives, so that batch should be a good sample of what follows:
    other pivots change which texts are compared, not what is found. A new text is compared with the blocks that can hold a similar one,
    and becomes part of a group, named after one of its texts; *merges* says which groups have become part of others, with a row for
    those only. *Tallies* are counts per group, which add up. *Patterns* have a row per group of ``min_size`` reports or more.

    A batch reads and rewrites the buckets it touches. Buckets of texts go by block, so a block that holds many of all texts is
    rewritten by one task, in sorted runs. Reports must not arrive twice; a batch may: it changes nothing that it has changed already. Texts
    without a vector (blank ones) are in no pattern. All columns may be null; an empty batch leaves its records only. Columns beyond
    :data:`ANALYSED` are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.60, min_size: int = 2, embedding: Column | None = None,
                 buckets: int = 64, block_rows: int = SIM.BLOCK_ROWS, pivots: int = SIM.PIVOTS):
        self.spark, self.path, self.threshold, self.min_size = spark, path.rstrip("/"), threshold, min_size
        self.embedding, self.block_rows, self.pivots = embedding, block_rows, pivots

        def table(name: str, ddl: str, *key: str) -> KeyedTable:
            return KeyedTable(spark, f"{self.path}/{name}", StructType.fromDDL(ddl), key, buckets)

        self.texts = table("texts", _TEXTS, "block")
        self.merges = table("merges", "grp string, root string", "grp")
        self.tallies = table("tallies", _TALLIES, "grp")
        self.patterns = table("patterns", _PATTERNS, "cluster")

    # ------------------------------------------------------------------ reading

    def clusters(self) -> DataFrame:
        """Texts in groups of ``min_size`` reports or more: vid, text, first, copies, cluster, size, cluster_first."""
        merged = self.merges.read()
        named = self.texts.read().join(merged, "grp", "left").withColumn("cluster", F.coalesce("root", "grp"))
        sizes = named.groupBy("cluster").agg(F.sum("copies").alias("size"), F.min("first").alias("cluster_first"))
        return named.drop("grp", "root", "vec", "block").join(sizes.filter(F.col("size") >= self.min_size), "cluster")

    def ranked(self) -> DataFrame:
        """All patterns with the ids that follow from their order."""
        return PT.ranked_patterns(self.patterns.read())

    # ------------------------------------------------------------------ writing

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One batch into all tables."""
        with scope(self.spark):
            if self.merges.record()["batch"] < batch_id:
                pivots = self._plan(batch, batch_id)
                self.merges.apply(batch_id, self._read(batch_id, "moved", "grp string, root string"), lambda old, new: P.replace_analysis(old, new, "grp"), {"pivots": pivots})
            # What is left to do after a failure is done from the plan.
            plan = self._read(batch_id, "plan", _PLAN)
            if self.texts.record()["batch"] < batch_id:
                self.texts.apply(batch_id, plan.select(*self.texts.schema.names), _counted, {"blocks": self._blocks_after(plan)})
            self.tallies.apply(batch_id, self._read(batch_id, "tallies", _TALLIES), _tallied)
            if self.patterns.record()["batch"] < batch_id:
                self.patterns.apply(batch_id, self._changed(plan, self._read(batch_id, "moved", "grp string, root string")), self._kept)

    def _kept(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return P.replace_analysis(old, new, "cluster").filter(F.col("number_of_reports") >= self.min_size)

    def _read(self, batch_id: int, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromDDL(ddl)).parquet(f"{self.path}/work/{batch_id}/{name}")

    def _written(self, rows: DataFrame, batch_id: int, name: str, ddl: str) -> DataFrame:
        rows.select(*StructType.fromDDL(ddl).names).write.mode("overwrite").parquet(f"{self.path}/work/{batch_id}/{name}")
        return self._read(batch_id, name, ddl)

    def _of(self, table: KeyedTable, keys: DataFrame) -> DataFrame:
        """The rows of a table in the buckets of some keys; the driver sees the numbers of the buckets."""
        return table.read([r[0] for r in keys.select(table.bucket()).distinct().collect()])

    def _pivots(self, texts: DataFrame, batch_id: int) -> tuple[np.ndarray, int | None]:
        """The pivots, and the batch that gave them. They are at most ``pivots`` vectors."""
        given = self.merges.record()["note"].get("pivots")
        if given is None:
            found = SIM.far_pivots(texts, self.pivots)
            if not len(found):
                return found, None
            given = batch_id
            rows = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(found)], "i int, vec array<double>")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots/{given}")
        rows = self.spark.read.schema("i int, vec array<double>").parquet(f"{self.path}/pivots/{given}").orderBy("i").collect()
        return np.array([r["vec"] for r in rows]), given

    def _blocks(self) -> dict[int, list]:
        """Radius and number of texts of each block."""
        return {int(b): v for b, v in self.texts.record()["note"].get("blocks", {}).items()}

    def _blocks_after(self, plan: DataFrame) -> dict[str, list]:
        now = self._blocks()
        for r in plan.filter("fresh").groupBy("block").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
            radius, n = now.get(r["block"], (0.0, 0))
            now[r["block"]] = [max(radius, r["radius"]), n + r["n"]]
        return {str(b): v for b, v in now.items()}

    def _plan(self, batch: DataFrame, batch_id: int) -> int | None:
        """Write what this batch changes, from the tables as they are before it; the batch that gave the pivots."""
        rows = batch.select(*StructType.fromDDL(ANALYSED).names)
        texts = SIM.embedded(SIM.distinct_texts(rows), self.embedding).withColumn("vec", VX.unit(F.col("vec").cast("array<double>")))
        # Written before the filter, which would repeat the embedding.
        texts = stored(texts).filter(F.exists("vec", lambda x: x != 0))
        pivots, given = self._pivots(texts, batch_id)
        if not len(pivots):
            for name, ddl in (("plan", _PLAN), ("moved", "grp string, root string"), ("tallies", _TALLIES)):
                self._written(self.spark.createDataFrame([], StructType.fromDDL(ddl)), batch_id, name, ddl)
            return None
        placed = stored(SIM.place(texts.select("vid", "text", "first", "copies", "vec"), pivots))
        known = self._of(self.texts, placed).select("block", "vid", "grp")
        met = stored(placed.join(known, ["block", "vid"], "left").withColumn("fresh", F.col("grp").isNull()))
        merged = self.merges.read()
        fresh = met.filter("fresh")
        to_groups = stored(self._probes(fresh, merged, pivots))
        among = SIM.edges(fresh.select("vid", "vec", "first"), self.threshold, self.block_rows)
        reached = stored(graph.components(to_groups.unionByName(among), "src", "dst"))
        # The name of a component is that of a group it had before, so that few rows have to follow.
        old = to_groups.select(F.col("dst").alias("node"), F.lit(True).alias("old")).distinct()
        vertices = reached.join(old, "node", "left").withColumn("old", F.coalesce("old", F.lit(False)))
        names = vertices.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("old"), F.col("node"))), F.min("node")).alias("name"))
        named = stored(vertices.join(names, "root").select("node", "name", "old"))
        given_way = named.filter("old and node <> name").select(F.col("node").alias("root"), F.col("name").alias("to"))
        moved = given_way.select(F.col("root").alias("grp"), F.col("to").alias("root")).unionByName(
            merged.join(given_way, "root").select("grp", F.col("to").alias("root")))
        moved = self._written(moved, batch_id, "moved", "grp string, root string")
        now = merged.join(moved.select("grp"), "grp", "left_anti").unionByName(moved)
        founded = met.join(named.select(F.col("node").alias("vid"), "name"), "vid", "left")
        grouped = founded.withColumn("grp", F.coalesce("grp", "name", "vid"))
        plan = self._written(grouped.join(now, "grp", "left").withColumn("cluster", F.coalesce("root", "grp")), batch_id, "plan", _PLAN)
        self._written(self._tallies_of(rows, plan), batch_id, "tallies", _TALLIES)
        return given

    def _probes(self, fresh: DataFrame, merged: DataFrame, pivots: np.ndarray) -> DataFrame:
        """Edges from new texts to the groups, as they are named now, that have a similar text."""
        blocks = self._blocks()
        radius = np.array([blocks[b][0] if b in blocks else -np.inf for b in range(len(pivots))])
        met = stored(SIM.visit(fresh.select("vid", "vec"), pivots, radius, SIM.reach_of(self.threshold)))
        visited = met.select(F.explode("visited").alias("block")).distinct()
        beside = self._of(self.texts, visited).join(merged, "grp", "left").withColumn("grp", F.coalesce("root", "grp"))
        return SIM.edges_between(met, beside.select("vid", "vec", "block", "grp"), {b: n for b, (_, n) in blocks.items()}, self.threshold, self.block_rows)

    def _tallies_of(self, rows: DataFrame, plan: DataFrame, salts: int = 16) -> DataFrame:
        """Counts of this batch by group. Salted, because one text may stand behind a large part of the reports."""
        moment = F.unix_micros(F.col("created_at").cast("timestamp")).cast("string")
        counted = {"activity": F.col("activity"), "hazard": F.col("hazard"), "barrier_failure": PT.barrier_failure(), "moment": moment}
        facts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in counted.items()]))
        digest = F.md5(F.coalesce("report_text", F.lit("")).cast("binary"))
        each = rows.select(digest.alias("vid"), "pos", facts.alias("f")).groupBy("vid", "f.kind", "f.value").agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
        salted = each.withColumn("salt", F.pmod(F.xxhash64("kind", "value"), F.lit(salts)).cast("int"))
        groups = plan.select("vid", F.col("cluster").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        of_reports = salted.join(groups, ["vid", "salt"]).select("grp", "kind", "value", "n", "seen")
        # Where the texts of a group stand, so that they can be read without the others.
        places = plan.filter("fresh").select(F.col("cluster").alias("grp"), F.lit("block").alias("kind"), F.col("block").cast("string").alias("value"), F.lit(1).cast("long").alias("n"), F.col("first").alias("seen"))
        return of_reports.unionByName(places).groupBy("grp", "kind", "value").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))

    def _changed(self, plan: DataFrame, moved: DataFrame) -> DataFrame:
        """The patterns this batch has changed, worked out anew from their tallies and texts; those of groups that gave way have no reports."""
        clusters = stored(plan.select("cluster").distinct())
        merged = self.merges.read()
        groups = stored(clusters.withColumn("grp", F.col("cluster")).unionByName(
            merged.withColumnRenamed("root", "cluster").join(clusters, "cluster").select("cluster", "grp")))
        tallies = self._of(self.tallies, groups).join(groups, "grp")
        figures = stored(tallies.groupBy("cluster", "kind", "value").agg(F.sum("n").alias("n"), F.min("seen").alias("seen")))
        blocks = figures.filter(F.col("kind") == "block").select(F.col("value").cast("int").alias("block")).distinct()
        texts = self._of(self.texts, blocks).join(groups, "grp").drop("grp")
        sizes = texts.groupBy("cluster").agg(F.sum("copies").alias("size"), F.min("first").alias("cluster_first"))
        clustered = stored(texts.join(sizes.filter(F.col("size") >= self.min_size), "cluster"))
        base = clustered.groupBy("cluster").agg(F.max("size").alias("number_of_reports"), F.min("first").alias("first"))
        common = [PT.most_common(figures.filter(F.col("kind") == kind), name, W.COMMON_DEFAULTS[default]) for kind, name, default in PT.COMMON]
        times = figures.filter(F.col("kind") == "moment").select("cluster", F.col("value").cast("long").alias("us"), "n")
        fresh = PT.advised(base, PT.cohesion(clustered), PT.trend_of(times), *common)
        gone = moved.select(F.col("grp").alias("cluster"), F.lit(0).cast("long").alias("number_of_reports")).join(clusters, "cluster", "left_anti")
        return stored(fresh.unionByName(gone, allowMissingColumns=True).select(*self.patterns.schema.names))


def start_patterns(stream: DataFrame, tables: PatternTables, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep :class:`PatternTables` up to date from a stream of analysed reports with the columns of :data:`ANALYSED`."""
    writer = stream.writeStream.foreachBatch(tables.write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
