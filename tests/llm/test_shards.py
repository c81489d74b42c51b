import zlib

from riskloom.llm.shards import shard_reports
from tests.llm.helpers import AWKWARD, reports, rows_of


def check(spark, rows, shards):
    got = sorted(rows_of(shard_reports(reports(spark, rows), shards), "report_id", "size", "text_crc32", "shard", "slot"), key=lambda r: (r[3], r[4]))
    want = sorted((((r[1] or "").encode(), r[0]) for r in rows), key=lambda x: (x[1] is None, x[1] or 0, zlib.crc32(x[0])))
    assert [(r[0], r[1], r[2]) for r in got] == [(i, len(t) + 8, zlib.crc32(t)) for t, i in want]
    total, before, slots = sum(r[1] for r in got), 0, {}
    for r in got:
        assert r[3] == min(shards - 1, (2 * before + r[1]) * shards // (2 * total)) and r[4] == slots.get(r[3], 0)
        slots[r[3]], before = r[4] + 1, before + r[1]
    return got


def test_awkward_rows(spark):
    check(spark, AWKWARD, 4)


def test_balance(spark):
    rows = [(k * 7919 % 5000, "x" * (k % 90), "s") for k in range(5000)]
    got, size = check(spark, rows, 24), {}
    for r in got:
        size[r[3]] = size.get(r[3], 0) + r[1]
    assert len(size) == 24 and max(size.values()) - min(size.values()) < 2 * 98


def test_empty_table(spark):
    assert rows_of(shard_reports(reports(spark, []))) == []
