import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.lattice import near_vectors, nearest, roots
from tests.llm.helpers import rows_of

SHAPE = "report_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(report_id, n_links, component_id) by all pairs."""
    unit, root = {}, {k: k for k in range(len(rows))}
    for k, (i, v, label) in enumerate(rows):
        x = np.array([np.nan if e is None else e for e in v], dtype=np.float32).astype(float) if v is not None else np.array([np.nan])
        if label is not None and np.isfinite(x).all() and (x != 0).any():
            unit[k] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = dict.fromkeys(range(len(rows)), 0)
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for k in unit:
        least[find(k)] = min((i for i in (rows[k][0], least.get(find(k))) if i is not None), default=None)
    return [(r[0], links[k], least[find(k)] if k in unit else r[0]) for k, r in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("bucket", "class_id", "group", "copies", "size", "n")}).repartition(3)


def clouds(seed, groups, size, noise, dims=64):
    draw, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = draw.normal(size=dims)
        for _ in range(size):
            v = centre + noise * draw.normal(size=dims) * draw.uniform(0, 1)
            rows.append((len(rows), (v / np.linalg.norm(v)).tolist(), g % 3))
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_recall_at_the_threshold(spark, block):
    rows = clouds(1, 40, 12, 0.45)
    got = {r[0]: r for r in rows_of(near_vectors(table(spark, rows), block=block), "report_id", "n_links", "component_id")}
    want = {r[0]: r for r in brute(rows)}
    found, there = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert there > 1000 and found >= 0.9 * there
    assert all(got[i][1] <= want[i][1] for i in want) and len(got) == len(rows)


@pytest.mark.parametrize("block", [2048, 10])
def test_close_copies_are_all_found(spark, block):
    rows = clouds(2, 3, 40, 0.15) + clouds(3, 50, 1, 0)
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(30)]  # equal vectors
    assert rows_of(near_vectors(table(spark, rows), block=block), "report_id", "n_links", "component_id") == sorted(brute(rows))


def test_awkward_rows(spark):
    v = [1.0] * 8
    rows = [
        (1, v, 0), (2, v, 0), (3, v, None), (4, v, None), (5, None, 0), (6, [0.0] * 8, 0), (7, [float("nan")] + v[1:], 0), (8, [None] + v[1:], 0),
        (9, [float("inf")] + v[1:], 0), (10, [2.0] * 8, 0), (11, v, 1), (12, [1.0] * 4, 0), (13, [], 0), (14, [1e30] * 8, 0), (15, [-0.0] + v[1:], 2),
        (16, [0.0] + v[1:], 2), (1, v, 0), (17, [1e-38] * 8, 0),
    ]
    assert rows_of(near_vectors(table(spark, rows)), "report_id", "n_links", "component_id") == sorted(brute(rows))
    assert rows_of(near_vectors(table(spark, []))) == []


def test_one_id_on_several_vectors_and_labels(spark):
    """Two vectors of one id are no link between what each of them is near to; neither is an id under two labels."""
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = lambda v: (v + 0.05 * np.eye(8)[5]).tolist()
    rows = [
        (5, a.tolist(), 0), (5, b.tolist(), 0), (1, near(a), 0), (2, near(b), 0), (5, a.tolist(), 1), (7, near(a), 1), (5, a.tolist(), 0),
        (None, a.tolist(), 0), (None, near(b), 2), (None, b.tolist(), 2), (None, (-a).tolist(), 0), (None, None, 0), (9, near(a), 2),
    ]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    for block in (2048, 1):
        got = rows_of(near_vectors(table(spark, rows), block=block), "report_id", "n_links", "component_id")
        assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_nearest_lattice_points():
    steps, draw = roots(), np.random.default_rng(0)
    x = draw.normal(size=(500, 8)) * 2
    point = nearest(x)
    doubled = np.rint(2 * point)
    assert np.allclose(doubled, 2 * point)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1)).all() and (point.sum(axis=1) % 2 == 0).all()
    own = ((x - point) ** 2).sum(axis=1)
    others = ((x[:, None] - point[:, None] - steps[None]) ** 2).sum(axis=2).min(axis=1)
    assert (own <= others + 1e-9).all() and (own <= 1 + 1e-9).all()
