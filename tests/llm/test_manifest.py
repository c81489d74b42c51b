from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from riskloom.llm import manifest as M
from tests.llm.helpers import LONG

SHAPE = "report_id long, report_type string, location string, source string, report_text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top, and for each node its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            paths[k] += ["".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])]
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute(rows, change=lambda row: row):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    trees = []
    for _, members in groupby(sorted(rows, key=key), key):
        members = sorted(members, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf(change(r))))
        trees.append((members, *climb([leaf(r) for r in members])))
    root, rest = climb([t[1] for t in trees])
    out = []
    for (members, top, paths), above in zip(trees, rest):
        for r, path in zip(members, paths):
            folded = leaf(change(r))
            for left, right in zip((path + above)[::2], (path + above)[1::2]):
                folded = h(left + folded + right)
            out.append((r[0], r[1], leaf(r), top, root, path + above, folded, folded == root))
    return sorted(out, key=str)


def lowered(row):
    return (*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if row[4] and row[0] is not None and row[0] % 3 == 0 else row[4])


def made(spark, rows, parts=5, **options):
    table = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("tree", "key", "rank", "size", "block", "digest", "found", "task", "path")})
    text = F.when(F.col("report_id") % 3 == 0, F.translate("report_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("report_text"))
    return sorted((tuple(r) for r in M.merkle_manifest(table.repartition(parts), found={"report_text": text}, **options).collect()), key=str)


AWKWARD = [(1, None, None, None, None), (None, None, "yard", "a", "No id"), (None, "near_miss", None, "", ""), (3, "", "x", None, LONG), (3, "", "x", None, LONG), (3, "", "x", None, "Other TEXT"),
           (6, "near_miss", "Tank-Nord", "app", "Ärger MIT Gerüst 😀"), (2**60 + 1, "incident", "a:b", "1-", "-"), (2**60, "incident", None, None, "Gas"), (9, "zz", None, None, "alone")]


def test_equals_brute_force(spark):
    rows = AWKWARD + [(100 + k, ("near_miss", "incident", None)[k % 3], "pad", "app", f"Report {k % 50}") for k in range(150)]
    got = made(spark, rows)
    assert got == brute(rows, lowered) and 0 < sum(r[7] for r in got) < len(got)


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65, 77])
def test_many_superblocks(spark, count):
    """Superblocks of one run: the trees of their roots have superblocks again."""
    rows = [(k, "near_miss", None, "app", f"Report {k}") for k in range(count)] + [(k, f"type {k}", None, "app", "Few") for k in range(9)]
    assert made(spark, rows, height=1) == brute(rows, lowered)


def test_unchanged_rows_are_verified(spark):
    rows = AWKWARD[:7]
    table = spark.createDataFrame(rows, SHAPE)
    assert all(r.verified for r in M.merkle_manifest(table).collect())
    # Another order of the rows in other partitions gives the same root.
    assert len({r.root for n in (1, 7) for r in M.merkle_manifest(table.repartition(n)).collect()}) == 1


def test_height():
    assert [M.height_of(n) for n in (1, 2, 8, 9, 64, 65, 4096, 4097)] == [0, 1, 1, 2, 2, 3, 4, 5]


def test_empty_table(spark):
    assert made(spark, []) == []
