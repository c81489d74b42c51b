import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from riskloom.sources import readers as RD
from riskloom.sources.quoted_csv import quoted_records, read_quoted


def written(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    writer.writerow(["report_id", "report_text", "note"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def made(seed, n):
    draw = random.Random(seed)
    words = ["gas", "test", '"', "\n", "\r\n", ",", "\n\n", "Ärger", "", " ", "valve", '""', "\n\"\n"]
    return [(f"R{seed}-{k}", "".join(draw.choices(words, k=draw.randint(0, 12))), draw.choice(["", "ok", "a\nb"])) for k in range(n)]


@pytest.fixture
def small_parts(spark):
    """Files are cut every few bytes, so that records, and quotes, go over many ends."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.na.fill("\0").collect())


@pytest.mark.parametrize("size,few,end", [(64, 100_000, "\n"), (257, 0, "\n"), (1 << 20, 100_000, "\r\n"), (100, 100_000, "\r\n")])
def test_same_rows_as_one_task_a_file(spark, tmp_path, small_parts, size, few, end):
    small_parts(size)
    for seed in range(3):
        written(tmp_path / f"{seed}.csv", made(seed, 60), end, csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL)
    got = read_quoted(spark, str(tmp_path), few)
    # An empty value is null; all others are as they were written.
    want = sorted(tuple("\0" if v == "" else v for v in row) for seed in range(3) for row in made(seed, 60))
    assert rows_of(got) == want and got.columns == ["report_id", "report_text", "note"]
    if end == "\r\n":
        return  # the other reader turns line ends within values into this one
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(str(tmp_path))
    assert rows_of(got) == rows_of(whole)
    if size == 64:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 50


def test_one_record_over_many_parts(spark, tmp_path, small_parts):
    small_parts(50)
    long = "line of the report\n" * 60
    written(tmp_path / "a.csv", [("A", long, "x"), ("B", "short", "y"), ("C", "\n" + long, "")])
    got = {r.report_id: r.report_text for r in read_quoted(spark, str(tmp_path)).collect()}
    assert got == {"A": long, "B": "short", "C": "\n" + long}


def test_an_open_quote_takes_the_rest(spark, tmp_path, small_parts):
    small_parts(40)
    (tmp_path / "a.csv").write_text('report_id,report_text,note\nA,one,x\nB,"two\nthree,y\nfour,z\n')
    (tmp_path / "b.csv").write_text("report_id,report_text,note\n\nC,five,\n")
    records = sorted(r.record for r in quoted_records(spark, str(tmp_path)).filter(~F.col("first")).collect())
    assert records == ["A,one,x", 'B,"two\nthree,y\nfour,z', "C,five,"]


def test_header_only_and_empty_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('report_id,report_text,note\n')
    assert read_quoted(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text('report_id,report_text,note\nA,"",\nB\n')
    assert sorted((tuple(r) for r in read_quoted(spark, str(tmp_path)).collect()), key=str) == [("A", None, None), ("B", None, None)]


def test_readers_take_quoted_line_breaks(spark, tmp_path, small_parts):
    small_parts(64)
    written(tmp_path / "a.csv", [("A", "first\nsecond", "x"), ("", 'said "stop"\n', "y"), ("B", " \n ", "z")])
    got = {r.report_text: r.report_id for r in RD.read_reports(spark, str(tmp_path), quoted=True).collect()}
    assert set(got) == {"first\nsecond", 'said "stop"\n'} and got["first\nsecond"] == "A" and got['said "stop"\n'].startswith("REP-")
    assert RD.read_table(spark, str(tmp_path), quoted=True).count() == 3
