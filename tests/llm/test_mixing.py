import pytest

from riskloom.llm.mixing import mix_sources, rates, repeated
from tests.llm.helpers import AWKWARD, reports, rows_of


def dealt(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by dealing the excess again until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target = {s: weights[k % len(weights)] for k, s in enumerate(names)}, {}
    left, free = share * sum(sizes.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 1000, None: 50}, {"a": 1, "B": 1, "é": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 9, "c": 1, "d": 200, "e": 3, "f": 3, "g": 3}, {"x": 5},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in rates(table, (3, 1, 2), 1.5, 2.0).collect()}
    want = dealt(sizes)
    for s in sizes:
        assert got[s].target == pytest.approx(want[s]) and got[s].rate * sizes[s] == pytest.approx(want[s])


def test_copies_come_near_the_target_and_agree(spark):
    rows = [(k, "word " * (1 + k % 9), f"s{k % 50 % 7}" if k % 3 else "hot") for k in range(6000)]
    mixed = mix_sources(reports(spark, rows))
    got = rows_of(mixed, "report_id", "source", "size", "target", "copies")
    assert got == rows_of(mix_sources(reports(spark, rows)), "report_id", "source", "size", "target", "copies")
    taken, target = {}, {}
    for _, source, size, aim, copies in got:
        assert copies in (0, 1, 2)
        taken[source], target[source] = taken.get(source, 0) + size * copies, aim
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)
    assert repeated(mixed).count() == sum(r[4] for r in got)


def test_no_python_in_the_plan(spark):
    plan = mix_sources(reports(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_rows(spark):
    got = rows_of(mix_sources(reports(spark, AWKWARD)), "report_id", "source", "size", "source_size", "copies")
    assert len(got) == len(AWKWARD) and {r[2] for r in got if r[0] in (2, 3, 4)} == {0}
    assert rows_of(mix_sources(reports(spark, []))) == []
