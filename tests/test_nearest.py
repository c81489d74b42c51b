import numpy as np

from riskloom.operators import similar as SIM


def test_neighbours_are_found_without_copies_of_vectors(spark, monkeypatch):
    """Vectors in no blocks, copies, a zero vector, a null number as id (it differs from itself), and some that do not count as neighbours; blocks in several pieces."""
    monkeypatch.setattr(SIM, "BLOCK_ROWS", 25)
    draw = np.random.default_rng(4).normal(size=(300, 16)).astype(np.float32)
    draw[7], draw[50], draw[51] = 0, draw[5], 2 * draw[5]
    ids = [None if k == 9 else k + 1000 for k in range(300)]
    rows = [(i, v.tolist(), k, k % 3 > 0) for k, (i, v) in enumerate(zip(ids, draw))]
    vectors = spark.createDataFrame(rows, "vid long, vec array<float>, first long, high boolean")
    wide = draw.astype(np.float64)
    unit = wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-9)
    product = np.floor(np.abs(unit @ unit.T) * 1e4 + 0.5) * np.sign(unit @ unit.T) / 1e4
    for with_self, only in ((False, None), (True, None), (False, "high")):
        found = SIM.nearest(vectors, 4, 0.3, 20, with_self, only)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Union" not in plan
        want = {}
        for k in range(300):
            near = sorted((-product[k, j], j) for j in range(300) if product[k, j] >= 0.3 and (with_self or j != k or k == 9) and (only is None or j % 3))[:4]
            if near:
                want[ids[k]] = [(ids[j], j, -s) for s, j in near]
        got = {}
        for r in found.orderBy("vid", "rank").collect():
            got.setdefault(r.vid, []).append((r.other, r.other_first, r.similarity))
        assert got.keys() == want.keys() and len(want) > 250
        for i in want:
            assert [x[:2] for x in got[i]] == [x[:2] for x in want[i]] and np.allclose([x[2] for x in got[i]], [x[2] for x in want[i]])


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([(1, [0.0, 0.0], 1)], "vid long, vec array<double>, first long")
    assert SIM.nearest(none, 3, 0.5).count() == 0 and SIM.nearest(none.limit(0), 3, 0.5).count() == 0
    one = spark.createDataFrame([(1, [0.0, 2.0], 1)], "vid long, vec array<double>, first long")
    assert [tuple(r) for r in SIM.nearest(one, 3, 0.5, with_self=True).collect()] == [(1, 1, 1, 1.0, 1)]
