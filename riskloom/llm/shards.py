"""Contiguous shards of reports with nearly equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskloom.functions.lineage import stored

SHARDS = 24
#: Bytes that a report takes in a shard besides its text: its length field.
OVERHEAD = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bytes before each row within its partition."""
    task, rows, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size, n = batch.column("size").to_numpy(), batch.num_rows
        ends = before + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, task), pa.int32()), pa.array(np.arange(rows, rows + n)), pa.array(ends - size)],
            names=[*batch.schema.names, "task", "row", "before"],
        )
        rows += n
        before = int(ends[-1]) if n else before


def shard_reports(reports: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """The shard of every report: in order of ``report_id``, cut where the bytes so far pass equal targets.

    A report's size is its ``report_text`` in UTF-8 (null: none) and ``overhead``. Only ids, sizes and checksums
    are sorted, by range; a partition sums up its own rows, the totals of the partitions (one row each) give
    the sums before them, and a report goes to the shard in whose equal share of the bytes its middle lies. So
    shards are contiguous and differ by about one report at most. A text longer than a shard leaves shards empty.

    Returns a row per input row: report_id, size, text_crc32, shard (from 0), slot (place in the shard, gapless
    from 0). A null id comes last. Rows repeated with one id follow each other by checksum. Other columns are
    not looked at. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("report_text"), F.lit(""))
    sized = reports.select(
        "report_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    order = [F.col("report_id").asc_nulls_last(), "text_crc32"]
    shape = StructType([*sized.schema.fields, StructField("task", IntegerType()), StructField("row", LongType()), StructField("before", LongType())])
    placed = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, shape))
    totals = sorted(placed.groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect(), key=lambda t: t.task)
    offsets, rows, size = [], 0, 0
    for total in totals:
        offsets.append((total.task, rows, size))
        rows, size = rows + total.n, size + total.size
    # A row for each partition of the sort, hence the broadcast.
    earlier = reports.sparkSession.createDataFrame(offsets, "task int, rows_before long, bytes_before long")
    share = F.expr(f"(2 * (bytes_before + before) + size) * {shards} div {2 * max(size, 1)}")
    numbered = placed.join(F.broadcast(earlier), "task").select(
        "report_id", "size", "text_crc32", (F.col("rows_before") + F.col("row")).alias("at"),
        F.least(F.lit(shards - 1), share).cast("int").alias("shard"),
    )
    first = numbered.groupBy("shard").agg(F.min("at").alias("first"))  # a row per shard
    return numbered.join(F.broadcast(first), "shard").select(
        "report_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
