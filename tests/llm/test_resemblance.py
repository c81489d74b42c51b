import random

import corpus_pipeline as CP
from riskloom.llm.resemblance import resembling
from tests.llm.helpers import AWKWARD, reports, rows_of
from tests.llm.test_pipeline import documents
from tests.llm.test_simhash import brute_components


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(pairs, seed=1):
    """Texts of random words and copies with some words changed, at 5-word similarities from 0.6 to 1."""
    draw, rows = random.Random(seed), []
    for k in range(pairs):
        words = [f"w{draw.randrange(50_000)}" for _ in range(draw.choice((60, 120, 400)))]
        other = list(words)
        for at in draw.sample(range(len(words)), draw.randrange(1, max(2, len(words) // 30))):
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return rows


def test_near_stage_drops_copies_from_eight_tenths(spark, tmp_path):
    rows = planted(200)
    sims = {k: jaccard(grams(rows[2 * k][1]), grams(rows[2 * k + 1][1])) for k in range(200)}
    assert sum(0.8 <= s <= 0.95 for s in sims.values()) > 60 and sum(s < 0.8 for s in sims.values()) > 20
    left = {r.doc_id for r in CP.near(spark, documents(spark, [(i, t, "en", "a") for i, t in rows]), str(tmp_path)).collect()}
    assert left == {2 * k for k in sims} | {2 * k + 1 for k, s in sims.items() if s < 0.8}


def test_components_equal_brute_force_in_crowded_buckets(spark):
    draw = random.Random(4)
    base, rows = [f"w{k}" for k in range(80)], []
    for k in range(120):
        words = list(base)
        for at in draw.sample(range(80), draw.randrange(0, 5)):
            words[at] = f"x{draw.randrange(6)}"
        rows.append((k, " ".join(words)))
    sets = dict((i, grams(t)) for i, t in rows)
    want = brute_components(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    for block in (512, 16):
        assert dict(rows_of(resembling(reports(spark, rows), block=block), "report_id", "component_id")) == want
    assert len(set(want.values())) > 2


def test_awkward_rows(spark):
    got = rows_of(resembling(reports(spark, AWKWARD)), "report_id", "component_id")
    assert got == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 5), (7, 7), (7, 7), (None, 1), (None, 2)]
    assert rows_of(resembling(reports(spark, []))) == []
