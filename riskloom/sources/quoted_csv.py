"""CSV whose quoted values hold line breaks, read by many tasks a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.functions.lineage import stored

#: Parts of files (a path and two numbers each) up to which the table of their states goes to every task.
FEW = 100_000
#: What a row of the pass over the lines is: a whole record, or the lines of one that began in an earlier part or goes on in a later one.
WHOLE, HEAD, TAIL, THROUGH = 0, 1, 2, 3

_SHAPE = "file string, block long, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the part of it that owns them, and their number of quotes. Within a part they come in order."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", quotes.alias("quotes"))


def _states(lines: DataFrame) -> DataFrame:
    """For each part whether a quote is open where it starts: the parity of all quotes before it in its file."""
    counted = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("open"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in order. A record ends with the line after which no quote is open."""
    part, held, began, done = None, [], False, 0

    def rest() -> list[tuple]:
        return [(*part, (THROUGH if began else TAIL), False, "\n".join(held))] if held else []

    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "open", "value", "quotes")]
        odd = (np.array(columns[4], np.int64) % 2).tolist()
        for file, block, opened, value, change in zip(*columns[:4], odd):
            if (file, block) != part:
                if part is not None:
                    rows += rest()
                # ``began``: these lines belong to a record of an earlier part.
                part, held, began, done = (file, block), [], bool(opened), 0
                inside = began
            inside ^= bool(change)
            held.append(value)
            if not inside:
                rows.append((*part, HEAD if began else WHOLE, not began and done == 0 and block == 0, "\n".join(held)))
                held, began, done = [], False, done + 1
        yield _batch(rows)
    if part is not None:
        yield _batch(rest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "kind", "first", "record"])


def _joined(cut: DataFrame) -> DataFrame:
    """Records that go over the ends of parts, put together. A file has two pieces a part at most."""
    order = Window.partitionBy("file").orderBy("block", "kind")
    # In a part the piece of an earlier record comes before the one that goes on: HEAD < TAIL.
    owned = cut.filter(F.col("kind") != WHOLE).withColumn("owner", F.last(F.when(F.col("kind") == TAIL, F.col("block")), True).over(order))
    return owned.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "record"))).alias("pieces")).select(
        F.lit(False).alias("first"), F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))


def quoted_records(spark: SparkSession, path: str, few: int = FEW) -> DataFrame:
    """The records of CSV files as text: first (is it the first one of its file) and record, without the line end.

    Files are read in parts as Spark cuts them. One pass counts the quotes of each part; the parity of all parts before one tells whether
    it starts within quotes. A second pass puts lines together to records, each by the task in whose part it starts; of those that go over
    the end of a part only the pieces are shuffled. Empty lines between records are left out.
    """
    lines = _lines(spark, path)
    states = stored(_states(lines))
    if states.count() <= few:
        ready = lines.join(F.broadcast(states), ["file", "block"])
    else:
        numbered = lines.withColumn("seat", F.monotonically_increasing_id())
        ready = numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seat")
    cut = ready.select("file", "block", "open", "value", "quotes").mapInArrow(_cut, _SHAPE)
    out = cut.filter(F.col("kind") == WHOLE).select("first", "record")
    # Where no part starts within quotes no record goes over an end, except one that the end of its file cuts off.
    out = out.unionByName(_joined(cut))
    return out.withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter(F.col("first") | (F.col("record") != ""))


def read_quoted(spark: SparkSession, path: str, few: int = FEW) -> DataFrame:
    """CSV files with a header as columns of text, the same rows as with ``multiLine``, in no order.

    Quotes stand only around values, and are doubled within them. The header is one line, and all files have the same one. An empty
    value is null, quoted or not. A quote that is never closed takes the rest of its file.
    """
    options = {"quote": '"', "escape": '"', "header": "true"}
    names = spark.read.options(**options).csv(path).columns
    # Values keep the line ends that they have.
    parsed = F.from_csv("record", StructType([StructField(n, StringType()) for n in names]).toDDL(), {"quote": '"', "escape": '"', "multiLine": "true"})
    return quoted_records(spark, path, few).filter(~F.col("first")).select(parsed.alias("r")).select("r.*")
