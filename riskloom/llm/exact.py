"""Exact copies of report texts by a global content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from riskloom.functions.lineage import stored
from riskloom.llm.batches import light, own

# The characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
#: Characters of the text that a splitter carries; the digest after them orders texts with a common opening.
HEAD = 32


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition; only its first and last row keep the text."""
    ids, digests, same, first, last = [], [], [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        normal = batch.column("normal")
        equal = np.zeros(len(normal), dtype=bool)
        if len(normal) > 1:
            equal[1:] = pc.equal(normal[1:], normal[:-1]).to_numpy(zero_copy_only=False)
        opening = normal[0].as_py()
        if last is None:
            first = opening
        else:
            equal[0] = opening == last
        last = normal[-1].as_py()
        ids.append(own(batch.column("report_id")))
        digests.append(own(batch.column("text_sha256")))
        same.append(equal)
    if not ids:
        return
    ids, digests, head = pa.concat_arrays(ids), pa.concat_arrays(digests), ~np.concatenate(same)
    run = np.cumsum(head) - 1
    sizes, starts, n = np.bincount(run), np.flatnonzero(head), len(run)
    edge = (run == 0).astype(np.int32) + 2 * (run == run[-1]).astype(np.int32)
    task = TaskContext.get().partitionId()
    for at in range(0, n, 10_000):
        to = min(at + 10_000, n)
        part = run[at:to]
        texts = [None] * (to - at)
        if at == 0:
            texts[0] = first
        if to == n:
            texts[-1] = last
        opens, closes = np.zeros(to - at, dtype=bool), np.zeros(to - at, dtype=bool)
        opens[0], closes[-1] = at == 0, to == n
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(at, to - at), ids.take(pa.array(starts[part])), pa.array(sizes[part], pa.int64()),
                pa.array(head[at:to]), digests.slice(at, to - at), pa.array(np.full(to - at, task), pa.int32()),
                pa.array(edge[at:to], pa.int32()), pa.array(opens), pa.array(closes), pa.array(texts, pa.string()),
            ],
            names=["report_id", "keep_id", "group_size", "kept", "text_sha256", "task", "edge", "opens", "closes", "end_text"],
        )


def _chained(ends: list) -> list[tuple]:
    """Runs that go on across partitions: (task, edge code, keep_id, size, does it begin earlier)."""
    chains: list[list[tuple]] = []
    for row in sorted(ends, key=lambda r: r.task):
        # A partition that is one run has the edge code 3; otherwise 1 is its first run and 2 its last.
        opening = (row.task, 3 if row.whole else 1, row.first_keep, row.first_size)
        if row.goes_on:
            chains[-1].append(opening)
        elif row.whole:
            chains.append([opening])
        if not row.whole:
            chains.append([(row.task, 2, row.last_keep, row.last_size)])
    found = []
    for chain in chains:
        if len(chain) > 1:
            size = sum(part[3] for part in chain)
            found += [(task, edge, chain[0][2], size, k > 0) for k, (task, edge, _, _) in enumerate(chain)]
    return found


def exact_copies(reports: DataFrame) -> DataFrame:
    """Groups of reports whose ``report_text`` is the same but for white space, and the one of each that stays.

    Reads ``report_id`` and ``report_text`` of every row; other columns are not looked at. Sampled splitters
    range-partition the normalised texts (by their opening, digest, length and id, so that a splitter stays
    small and copies of one text may fill many partitions); an external sort puts equals side by side and
    neighbours are compared in full. Of equal texts the longest original stays, then the smallest ``report_id``.
    A run that crosses partitions is joined up from two rows a partition.

    Returns one row per input row: report_id, keep_id, group_size, kept, text_sha256 (of the normalised text).
    A null text counts as empty. A null id sorts after all others. Rows repeated with one id and one text
    are copies of each other: one of them is kept. An empty table gives an empty result.
    """
    light(reports.sparkSession)
    text = F.coalesce(F.col("report_text"), F.lit(""))
    kind = reports.schema["report_id"].dataType
    rows = reports.select("report_id", F.translate(text, IGNORED, "").alias("normal"), F.length(text).alias("size"))
    rows = rows.withColumns({
        "opening": F.substring("normal", 1, HEAD), "text_sha256": F.sha2("normal", 256),
    })
    place = ["opening", "text_sha256", F.col("size").desc(), F.col("report_id").asc_nulls_last()]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(
        "opening", "text_sha256", "normal", F.col("size").desc(), F.col("report_id").asc_nulls_last()
    )
    shape = StructType([
        StructField("report_id", kind), StructField("keep_id", kind), StructField("group_size", LongType()),
        StructField("kept", BooleanType()), StructField("text_sha256", StringType()), StructField("task", IntegerType()),
        StructField("edge", IntegerType()), StructField("opens", BooleanType()), StructField("closes", BooleanType()),
        StructField("end_text", StringType()),
    ])
    found = stored(ordered.select("report_id", "normal", "text_sha256").mapInArrow(_neighbours, shape))
    run = F.struct("keep_id", "group_size", "edge")
    ends = found.filter("opens or closes").groupBy("task").agg(
        F.max_by("end_text", "opens").alias("head"), F.max_by("end_text", "closes").alias("tail"),
        F.max_by(run, "opens").alias("first"), F.max_by(run, "closes").alias("last"),
    )
    # Two rows a partition at most from here on: the driver sees ids and sizes, the texts are compared by executors.
    spark, tasks = reports.sparkSession, sorted(r.task for r in found.filter("opens").select("task").collect())
    outcome = ["report_id", "keep_id", "group_size", "kept", "text_sha256"]
    if len(tasks) < 2:
        return found.select(*outcome)
    earlier = spark.createDataFrame(list(zip(tasks, [None, *tasks[:-1]])), "task int, before int")
    tails = ends.select(F.col("task").alias("before"), F.col("tail").alias("tail_before"))
    compared = ends.join(earlier, "task").join(tails, "before", "left").select(
        "task", F.coalesce(F.col("head") == F.col("tail_before"), F.lit(False)).alias("goes_on"),
        F.col("first.keep_id").alias("first_keep"), F.col("first.group_size").alias("first_size"),
        F.col("last.keep_id").alias("last_keep"), F.col("last.group_size").alias("last_size"),
        (F.col("first.edge") == 3).alias("whole"),
    )
    chains = _chained(compared.collect())
    if not chains:
        return found.select(*outcome)
    mended = spark.createDataFrame(chains, StructType([
        StructField("task", IntegerType()), StructField("edge", IntegerType()), StructField("chain_id", kind),
        StructField("chain_size", LongType()), StructField("began", BooleanType()),
    ]))
    # At most two rows for each partition of the sort, hence the broadcast.
    joined = found.join(F.broadcast(mended), ["task", "edge"], "left")
    return joined.select(
        "report_id",
        F.when(F.col("began").isNull(), F.col("keep_id")).otherwise(F.col("chain_id")).alias("keep_id"),
        F.coalesce("chain_size", "group_size").alias("group_size"),
        (F.col("kept") & ~F.coalesce("began", F.lit(False))).alias("kept"), "text_sha256",
    )
