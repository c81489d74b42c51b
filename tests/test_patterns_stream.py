from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import patterns as PT
from riskloom.streaming.pattern_stream import ANALYSED, PatternTables

WORDS = ["crane", "load", "valve", "pressure", "scaffold", "harness", "tank", "gas", "lockout", "panel", "forklift", "aisle"]
SHOWN = ("number_of_reports", "common_activity", "common_hazard", "common_barrier_failure", "recommended_action", "representative_text", "average_similarity",
         "trend_direction", "first_seen", "last_seen", "span_days", "date_counts", "pattern_id")


def reports(n):
    """Reports whose texts share words with their neighbours, so that later ones join groups; with copies, blanks and nulls."""
    rows = []
    for i in range(n):
        k = (i * 7) % len(WORDS)
        words = [WORDS[(k + j) % len(WORDS)] for j in range(3 + i % 3)]
        text = None if i % 23 == 5 else "" if i % 29 == 3 else "same text on every shift" if i % 3 == 0 else " ".join(words)
        day = None if i % 19 == 4 else datetime(2024, 1, 1) + timedelta(hours=31 * (i * 5 % n))
        rows.append((f"R{i}", i, text, day, ["Lifting", "Welding", None][i % 3], ["Gravity", None][i % 2], ["Isolation", None][i % 2], ["Failed", None][i // 2 % 2]))
    return rows


def shown(frame):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in frame.select(*SHOWN).collect()), key=str)


@pytest.mark.parametrize("threshold, cuts", [
    (0.6, ["pos >= 48", "false", "pos < 20", "pos >= 20 and pos < 48"]),
    (0.85, ["length(report_text) < 1 or report_text is null", "pos % 3 = 1 and length(report_text) > 0", "pos % 3 <> 1 and length(report_text) > 0"]),
])
def test_batches_come_to_what_one_batch_would(spark, tmp_path, threshold, cuts):
    """With an empty batch, one without texts, batches that come twice, and one that failed half way."""
    frame = spark.createDataFrame(reports(72), ANALYSED).cache()
    patterns, listed = PT.semantic_patterns(frame, threshold)
    want = shown(patterns)
    assert len(want) >= 2
    pairs = sorted((r.pattern_id, r.report_id) for r in listed.collect())
    tables = PatternTables(spark, f"{tmp_path}/t", threshold, buckets=4, block_rows=4, pivots=3)
    for batch_id, cut in enumerate(cuts):
        batch = frame.filter(cut).withColumn("block", F.lit("clash"))
        if batch_id == 2:
            apply = tables.tallies.apply
            tables.tallies.apply = lambda *a: (_ for _ in ()).throw(OSError("lost"))
            with pytest.raises(OSError):
                tables.write(batch, batch_id)
            tables.tallies.apply = apply
        for _ in range(2):
            tables.write(batch, batch_id)
    got = tables.ranked()
    assert shown(got) == want
    members = PT.members(frame, tables.clusters()).join(got.select("cluster", "pattern_id"), "cluster")
    assert sorted((r.pattern_id, r.report_id) for r in members.collect()) == pairs


def test_a_text_that_joins_two_patterns(spark, tmp_path):
    """Their rows give way to one, patterns that are far from it keep their files, and copies only count."""
    def batch(*texts, at):
        return spark.createDataFrame([(f"R{at + i}", at + i, t, None, None, None, None, None) for i, t in enumerate(texts)], ANALYSED)

    tables = PatternTables(spark, f"{tmp_path}/t", 0.55, buckets=32, pivots=8)
    tables.write(batch("aa bb", "aa bb", "cc dd", "cc dd", "xx yy", "xx yy", at=0), 0)
    first = {r.representative_text: r for r in tables.patterns.read().collect()}
    assert {t: r.number_of_reports for t, r in first.items()} == {"aa bb": 2, "cc dd": 2, "xx yy": 2}
    tables.write(batch("aa bb cc dd", at=6), 1)
    after = {r.number_of_reports: r for r in tables.patterns.read().collect()}
    assert set(after) == {5, 2} and after[2].representative_text == "xx yy" and after[5].first == 0
    where = tables.patterns.record()["buckets"]
    apart = tables.patterns.read().filter("number_of_reports = 2").select(tables.patterns.bucket()).first()[0]
    assert where[apart] == 0
    tables.write(batch("xx yy", at=7), 2)
    assert sorted(r.number_of_reports for r in tables.patterns.read().collect()) == [3, 5]
    assert tables.merges.read().count() == 1 and tables.texts.read().count() == 4
