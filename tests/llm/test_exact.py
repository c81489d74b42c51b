import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from riskloom.llm.exact import exact_copies
from tests.llm.helpers import AWKWARD, reports, rows_of

OUT = ("report_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        text = row[1] or ""
        groups["".join(c for c in text if c not in " \t\n\x0b\x0c\r")].append((-len(text), row[0] is None, row[0] or 0, row[0]))
    out = []
    for normal, members in groups.items():
        for k, m in enumerate(sorted(members, key=lambda x: x[:3])):
            out.append((m[3], sorted(members, key=lambda x: x[:3])[0][3], len(members), k == 0, hashlib.sha256(normal.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_awkward_rows(spark):
    assert ordered(rows_of(exact_copies(reports(spark, AWKWARD)), *OUT)) == ordered(brute(AWKWARD))


def test_one_text_in_most_rows_fills_many_partitions(spark):
    rows = [(k, f"text {k % 7}" if k % 3 else "the  same " + " " * (k % 2), "s") for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = exact_copies(reports(spark, rows))
        assert ordered(rows_of(found, *OUT)) == ordered(brute(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_common_openings_and_string_ids(spark):
    rows = [(k, "x" * 200 + str(k % 5), "s") for k in range(60)]
    named = reports(spark, rows).withColumn("report_id", F.concat(F.lit("R"), F.lpad(F.col("report_id").cast("string"), 3, "0")))
    got = rows_of(exact_copies(named), "report_id", "keep_id")
    assert got == [(f"R{k:03d}", f"R{k % 5:03d}") for k in range(60)]


def test_empty_table(spark):
    assert rows_of(exact_copies(reports(spark, []))) == []
