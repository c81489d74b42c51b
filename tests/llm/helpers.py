"""Small tables of reports with everything that must not break an operator."""

from pyspark.sql import functions as F

SHAPE = "report_id long, report_text string, source string, lang string, source_file_path string"
LONG = "guard rail missing near the tank farm. " * 3000
AWKWARD = [
    (1, "Worker entered the vessel without a gas test.", "site", "en", None), (2, None, None, None, None), (3, "", "site", None, ""),
    (4, " \t\n", None, "xx", "http://a.example.org/x"), (5, LONG, "site", "en", None), (6, LONG, "yard", "en", None),
    (7, "Ärger mit dem Gerüst퟿ 😀 ��", "yard", "de", None), (7, "Ärger mit dem Gerüst퟿ 😀 ��", "yard", "de", None),
    (None, "Worker entered the vessel without a gas test.", "site", "en", None), (None, None, None, None, None),
]


def reports(spark, rows, clash=True):
    """The rows in several partitions, with columns named like those that operators add."""
    table = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], SHAPE)
    if clash:
        extra = ("keep_id", "kept", "size", "normal", "digest", "task", "root", "node", "a", "b", "copies", "rate", "target", "bucket", "ids", "n", "unit")
        table = table.withColumns({c: F.lit("x") for c in extra})
    return table.repartition(3)


def rows_of(frame, *columns):
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
