import random

import pytest
import xxhash

from riskloom.functions.graph import components
from riskloom.llm.simhash import fingerprint, links, near_copies
from tests.llm.helpers import AWKWARD, reports, rows_of


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_of_each_length():
    for text in (None, "", "  ", "One", "one TWO", "a b c", "a b c d", "Ä b  c\n d a b c d", "x " * 70000):
        assert fingerprint(text) == brute_print(text)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20 + k, f"crew lifted load {k} over the walkway " + "while the banksman stood below and waved " * 12) for k in range(30)]
    got = rows_of(near_copies(reports(spark, rows)), "report_id", "fingerprint", "component_id")
    prints = {}
    for r in rows:
        prints.setdefault(brute_print(r[1]), []).append(r[0])
    parts = brute_components(list(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for p, root in parts.items():
        ids = [i for i in prints[p] if i is not None]
        least[root] = min([*ids, *([least[root]] if root in least else [])], default=None)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    want = [(r[0], signed(brute_print(r[1])), least[parts[brute_print(r[1])]]) for r in rows]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_join_all_within_three_bits(spark, crowd):
    draw = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(40):  # chains of near values, some within one half only
        x = draw.getrandbits(64)
        for _ in range(12):
            values.add(x)
            for _ in range(draw.randint(1, 4)):
                x ^= 1 << draw.choice([draw.randrange(64), draw.randrange(32)])
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long").repartition(3)
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in (tuple(r) for r in links(frame, 3, crowd).collect())]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    pairs = set(found) | {(b, a) for a, b in found}
    by_links = brute_components(sorted(values), lambda a, b: (a, b) in pairs)
    assert by_links == brute_components(sorted(values), lambda a, b: (a ^ b).bit_count() <= 3)


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long").repartition(3)), "node", "root"))
    for group in (range(41), range(100, 160), (300, 301)):
        assert len({got[n] for n in group}) == 1
    assert len(set(got.values())) == 3
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


def test_empty_table(spark):
    assert rows_of(near_copies(reports(spark, []))) == []
