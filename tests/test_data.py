import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import patterns as PT
from riskloom.operators import quality as Q
from riskloom.operators import similar as SIM
from riskloom.operators import splits as SP

DDL = "report_id string, pos long, report_text string"


def reports(spark, *texts):
    return spark.createDataFrame([(f"R{i}", i, t) for i, t in enumerate(texts)], DDL)


def test_neighbours_leave_out_the_report_itself(spark):
    rows = reports(spark, "pump leak seen", "pump leak seen", "office tea", "pump leak seen again", "")
    got = {}
    for r in SIM.similar_reports(rows, k=2, threshold=0.5, block_rows=2).collect():
        got.setdefault(r.report_id, []).append((r.rank, r.similar_id))
    assert sorted(got["R0"]) == [(1, "R1"), (2, "R3")] and sorted(got["R1"]) == [(1, "R0"), (2, "R3")]
    assert "R4" not in got and all(i != r for r, v in got.items() for _, i in v)


def test_small_and_large_blocks_agree(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("pump valve leak crane fire gas tank road".split()) for _ in range(4)) for _ in range(60)]
    rows = reports(spark, *texts)
    a = SIM.similar_reports(rows, k=3, block_rows=7).orderBy("report_id", "rank").collect()
    b = SIM.similar_reports(rows, k=3, block_rows=1000).orderBy("report_id", "rank").collect()
    assert a == b and a


def test_recurrence_leaves_out_the_report_itself(spark):
    rows = reports(spark, "pump leak seen", "office tea")
    signal = {r.report_id: r.recurrence_signal for r in SIM.recurrence(rows, rows.filter("report_id = 'R0'")).collect()}
    assert signal["R0"] == 0.0 and signal["R1"] < 1.0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.id: r.component for r in PT.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_forest_keeps_the_components(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("pump valve leak crane fire gas tank road".split()) for _ in range(3)) for _ in range(80)]
    rows = reports(spark, *texts)
    few = {(r.report_id, r.cluster_first) for r in PT.members(rows, PT.text_clusters(rows, 0.7, block_rows=9)).collect()}
    one = {(r.report_id, r.cluster_first) for r in PT.members(rows, PT.text_clusters(rows, 0.7)).collect()}
    assert few == one and len({c for _, c in one}) > 1


def test_trend_directions(spark):
    day = datetime(2024, 1, 11)
    groups = {"up": (-10, -5, -1, -1), "down": (-10, -9, -1), "two": (-3, -1), "same": (0, 0, 0), "even": (-4, -3, -1, 0)}
    rows = spark.createDataFrame([(g, day + timedelta(days=d)) for g, ds in groups.items() for d in ds], "cluster string, created_at timestamp")
    got = {r.cluster: r for r in PT.trend(rows).collect()}
    assert {g: r.trend_direction for g, r in got.items()} == {"up": "increasing", "down": "decreasing", "two": "isolated", "same": "isolated", "even": "stable"}
    assert got["up"].span_days == 9 and got["up"].date_counts["2024-01-10"] == 2


def labelled(spark, ones, zeros):
    return spark.createDataFrame([(i, f"text {i}", int(i < ones)) for i in range(ones + zeros)], "doc_id int, text string, label int")


def test_split_sizes_and_partition(spark):
    rows = labelled(spark, 29, 21)
    out = SP.stratified_split(rows, "label", "doc_id")
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 34, "val": 8, "test": 8}
    assert sorted(r.doc_id for r in out.collect()) == list(range(50))
    assert SP.overlap(out, "text").first().asDict() == {"train_test_text_overlap": 0, "train_val_text_overlap": 0, "val_test_text_overlap": 0}
    again = SP.stratified_split(rows.repartition(3), "label", "doc_id", buckets=5)
    assert {(r.doc_id, r.split) for r in out.collect()} == {(r.doc_id, r.split) for r in again.collect()}


def test_small_class_is_split_without_strata(spark):
    out = SP.stratified_split(labelled(spark, 2, 18), "label", "doc_id")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 14, "val": 3, "test": 3}


def test_metrics_with_empty_denominators(spark):
    rows = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.2)], "t int, p int, s double")
    assert EV.metrics(rows, "t", "p").first().f2_score == 0.0
    assert EV.roc_auc(rows, "t", "s").first().roc_auc is None


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "t int, s double")
    assert EV.roc_auc(rows, "t", "s", ranges=2).first().roc_auc == 0.875


def test_quality_checks(spark):
    rows = spark.createDataFrame(
        [("a", "  Same Text "), ("b", "same text"), ("c", "x" * 80 + "1"), ("d", "x" * 80 + "2"), ("d", None)], "id string, text string")
    assert sorted(r.id for r in Q.exact_duplicates(rows, "text", "id").collect()) == ["a", "b"]
    assert sorted(r.id for r in Q.near_duplicates(rows, "text", "id").collect()) == ["c", "d"]
    assert [r.id for r in Q.duplicate_keys(rows, "id").collect()] == ["d"]
    assert Q.first_ids(rows.filter(F.length("text") < 20), "id").first().ids == ["a", "b"]


def test_pivots_leave_out_pairs_but_no_neighbour(spark):
    rng = random.Random(11)
    words = [[f"w{g}x{i}" for i in range(6)] for g in range(12)]
    texts = [" ".join(rng.choice(words[k % 12]) for _ in range(12)) for k in range(240)]
    vectors = SIM.embedded(SIM.distinct_texts(reports(spark, *texts))).select("vid", "vec", "first")
    n = vectors.count()
    visits = SIM._paired(vectors, 0.9, 20).filter(~F.col("home")).select("vid", "at").distinct().count()
    assert n <= visits < n * 12 * 0.6  # each vector visits few of the twelve blocks
    rows = {r.vid: r.vec for r in vectors.collect()}
    got = {(r.vid, r.other) for r in SIM.nearest(vectors, 1000, 0.9, 20).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(rows[a], rows[b]))
    assert got == {(a, b) for a in rows for b in rows if a != b and round(cosine(a, b) + 1e-12, 4) >= 0.9} and len(got) > 100


def test_released_tables_are_gone(spark):
    from riskloom.functions import lineage

    kept, lineage._made[:] = list(lineage._made), []
    path = lineage.stored(spark.range(3)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and lineage.release(spark) == 1 and not os.path.exists(path)
    lineage._made[:] = kept


def test_point_lookup_reaches_the_scans(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["report_by_id"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(o_orderkey,1234)") >= 2


def test_columns_that_are_missing_and_extra(spark):
    from riskloom.operators import quality as Q

    rows = spark.createDataFrame([("A", 1, None), ("B", None, None)], "report_id string, extra int, other string")
    got = {(r.side, r.name): r.filled for r in Q.column_report(rows, ["report_id", "report_text"]).collect()}
    assert got == {("missing", "report_text"): 0, ("extra", "extra"): 1, ("extra", "other"): 0}
    assert Q.column_report(rows, rows.columns).count() == 0 and Q.column_report(rows.limit(0), ["report_id"]).count() == 2
