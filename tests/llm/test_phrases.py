import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import phrases as P
from tests.llm.helpers import LONG

OUT = ("report_type", "rank", "phrase", "a", "l", "r", "n", "score")
SHAPE = "report_id string, report_type string, report_text string"


def brute(rows, longest=3, least=10, first=2000, absorbed=50):
    counts, totals = Counter(), Counter()
    for _, kind, text in rows:
        kind = "und" if kind is None else kind
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[kind] += len(words)
            counts.update((kind, tuple(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    candidates = {(k, w): a for (k, w), a in counts.items() if len(w) > 1 and a >= least}
    gone = set()
    for (k, w), a in candidates.items():
        for n in range(2, len(w)):
            gone |= {(k, w[i : i + n]) for i in range(len(w) - n + 1) if 100 * a >= absorbed * counts[k, w[i : i + n]]}
    out = []
    for kind in totals:
        scored = []
        for (k, w), a in candidates.items():
            if k == kind and (k, w) not in gone:
                score, _, left, right = min((1000000 * a * a // (counts[k, w[:c]] * counts[k, w[c:]]), c, counts[k, w[:c]], counts[k, w[c:]]) for c in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((kind, rank, phrase.decode(), -a, left, right, totals[kind], -score))
    return sorted(out)


def mined(spark, rows, parts=3, **options):
    table = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("doc", "a", "l", "n", "score", "phrase", "parts", "rank")})
    return sorted(tuple(r) for r in P.mine_phrases(table.repartition(parts), **options).select(*OUT).collect())


def sentences(seed, count, kinds=("near_miss", "incident", None)):
    """Invented reports in which some words keep company."""
    draw = np.random.default_rng(seed)
    words = ["gas", "test", "Hot", "work", "permit", "the", "the", "a", "Ärger", "valve", "lock-out", "😀", "crane"]
    fixed = ["gas test done", "hot  work\tpermit", "lifting plan", "the the the", "confined space entry"]
    out = []
    for k in range(count):
        parts = [fixed[draw.integers(5)] if draw.random() < 0.3 else words[draw.integers(len(words))] for _ in range(draw.integers(0, 25))]
        joined = "".join(p + [" ", "  ", "\t", ", ", ". ", "\n"][min(int(draw.exponential(0.8)), 5)] for p in parts)
        out.append((f"R{k}", kinds[int(draw.integers(len(kinds)))], joined))
    return out


AWKWARD = [("A", "near_miss", None), ("B", None, ""), (None, None, " \t\n"), ("C", "near_miss", LONG), (None, "near_miss", LONG), ("C", "near_miss", LONG),
           ("C", "und", "gas test gas test gas"), ("D", "", "no\x00 zero\x00 no zero"), (None, None, None), ("E", "near_miss", "!?.,"), ("F", "x", "end")] + [
    (None, "x", "space"), ("G", "x", "last word wide　blank"), ("G", "x", "another text of one id")]


def test_equals_brute_force(spark):
    rows = sentences(1, 400) + AWKWARD
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 60


def test_longer_phrases_and_short_report(spark):
    rows = sentences(2, 200)
    assert mined(spark, rows, longest=5, least=4, first=7, absorbed=80) == brute(rows, 5, 4, 7, 80)


def test_equal_addresses_are_told_apart(spark):
    """With an address of a few bits most phrases share theirs with others; the check and the texts tell them apart."""
    rows = sentences(3, 150)
    assert mined(spark, rows, width=5) == brute(rows)


def test_slices_and_long_words(spark, monkeypatch):
    rows = sentences(4, 60) + [("Z", "incident", "x" * 5000 + " gas test " * 12)]
    monkeypatch.setattr(P, "SLICE", 64)
    texts = pa.array([r[2] for r in rows])
    kinds = pa.array([r[1] or "und" for r in rows])
    batch = pa.RecordBatch.from_arrays([kinds, texts, pa.array(np.arange(len(rows)))], names=["report_type", "report_text", "doc"])
    runs = [b for b in P._counts(2, b"\xff" * (1 << P.TABLE - 3), P.WIDTH)(iter([batch]))]
    want = Counter()
    for _, kind, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            words = piece.split()
            want.update((kind, a.lower().replace("Ä", "ä"), b.lower()) for a, b in zip(words, words[1:]))
    assert sum(b.column("number").to_numpy().sum() for b in runs) == sum(want.values())


def test_products_beyond_64_bits(spark):
    """Counts of a thousand million: 1000000·a·a has more than 64 bits."""
    big = 3_000_000_001
    print_ = "struct(0 as first, {} as words, {}L as address, {}L as mark)"
    parts = "array(" + ", ".join([print_.format(1, 1, 1), print_.format(1, 2, 2).replace("0 as first", "1 as first"), print_.format(2, 3, 3)]) + ")"
    found = spark.sql(f"select 'x' as report_type, 'p q' as phrase, 2 as words, {big}L as a, {parts} as parts")
    frequent = spark.sql(f"select * from values (1L, 1L, {big * 3}L), (2L, 2L, {big * 5 + 1}L), (3L, 3L, {big}L) as t(address, mark, number)")
    totals = spark.sql("select 'x' as report_type, 9L as n")
    row = P._scored(found, frequent, totals).first()
    assert row["score"] == 1000000 * big * big // (big * 3 * (big * 5 + 1)) and (row["l"], row["r"]) == (big * 3, big * 5 + 1)


def test_a_third_of_all_rows_is_one_report(spark):
    rows = sentences(5, 60) + [(None, "near_miss", "hot work permit issued")] * 60
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [("A", "x", None)], [("A", "x", "one")]])
def test_nothing_to_find(spark, rows):
    assert mined(spark, rows) == []
