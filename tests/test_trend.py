import random
from datetime import datetime, timedelta

from riskloom.operators import patterns as PT


def brute(times):
    dated = sorted(t for t in times if t)
    if not dated:
        return "stable"
    low, high = dated[0], dated[-1]
    if len(dated) <= 2 or (high - low).days == 0:
        return "isolated"
    first = sum(t - low <= high - t for t in dated)
    return "increasing" if len(dated) - first > first else "decreasing" if len(dated) - first < first else "stable"


def test_halves_from_days_equal_halves_from_moments(spark):
    """Groups whose reports crowd around the midpoint, also on its day and at its very moment; groups of a day; without dates."""
    draw, rows = random.Random(5), []
    for g in range(40):
        days = draw.choice([0, 1, 2, 9])
        ends = [datetime(2024, 3, 1, 6), datetime(2024, 3, 1, 6) + timedelta(days=days, hours=draw.choice([0, 5]))]
        middle = ends[0] + (ends[1] - ends[0]) / 2
        for t in [*ends, *(middle + timedelta(minutes=draw.choice([-700, -1, 0, 0, 1, 400])) for _ in range(draw.randint(0, 9)))]:
            rows.append((f"g{g}", min(max(t, ends[0]), ends[1])))
    rows += [("none", None), ("none", None), ("one", datetime(2024, 1, 1)), ("one", None)]
    table = spark.createDataFrame(rows, "cluster string, created_at timestamp")
    got = {r.cluster: (r.trend_direction, sum((r.date_counts or {}).values())) for r in PT.trend(table).collect()}
    groups = {g: [t for c, t in rows if c == g] for g, _ in rows}
    assert got == {g: (brute(ts), sum(t is not None for t in ts)) for g, ts in groups.items()}
    assert len({d for d, _ in got.values()}) == 4
