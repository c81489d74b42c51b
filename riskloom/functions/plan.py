"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def in_parts(condition: Column) -> Column:
    """A condition by way of an array function, for projections of much code.

    Whole-stage generation would make one method of such a projection, and one of more than 8,000 bytes stays interpreted by
    the JVM. It leaves projections with array functions out, whose code Spark cuts into methods that are compiled.
    """
    return F.exists(F.array(condition), lambda c: c)


def settled(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, with the columns it adds to ``before`` computed once.

    The optimizer moves a filter below the projection that makes its column by repeating the column's
    expression in the filter. For a column that hangs on a dozen projections that repeats the work many
    times over, and so do the filters it derives from ``explode``. A condition on the partition id, which
    is always met, marks the columns as not repeatable. Filters on input columns belong before the call.
    """
    known = set(before.columns)
    met = in_parts(F.spark_partition_id() >= 0)
    return after.withColumns({c: F.when(met, F.col(c)) for c in after.columns if c not in known})
