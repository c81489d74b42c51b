"""Arrow batches in Python workers: small parts, and copies that do not hold on to what they came with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are Python objects at a time.
ROWS = 256
#: Rows of whole texts that travel between Spark and Python at a time.
BATCH = 1024


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time; then memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def own(column: pa.Array) -> pa.Array:
    """A copy. A column that came through a stream keeps the memory of its whole batch."""
    return column.take(pa.array(np.arange(len(column))))


def light(spark) -> None:
    """Fewer rows an Arrow batch for what follows in this session: whole texts make rows of some KB up to many MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
