"""Queries over all reports against their statements."""

import glob
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import learn as L

FOLDER = "/root/testdata/sf0.001"


def stated(name):
    base = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        base.execute(f"create view {Path(path).stem} as select * from '{path}'")
    found = base.execute(entry.oracle_sql()[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["import_extracted", "train_lr", "predict_lr", "feature_signs", "top_features"])
def test_queries_over_all_reports(spark, name):
    columns, want = stated(name)
    got = entry.queries()[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and want


def test_vectors_hold_the_weights(spark):
    """Sparse vectors written as structs and read back: each weight at its index, an empty one where no term is known."""
    rows = spark.createDataFrame([("a", "gas test gas"), ("b", "valve"), ("c", "!"), ("d", None)], "id string, text string")
    counts = L.terms(rows, "text", "id")
    vocab = L.vocabulary(counts, 4, 3)
    got = {r.id: dict(zip(r.features.indices.tolist(), r.features.values.tolist())) for r in L.features(rows, counts, "id", vocab, 3).collect()}
    want = {r.id: {} for r in rows.collect()}
    for r in L.weigh(counts, vocab, "id").collect():
        want[r.id][r["index"]] = r.weight
    assert got == want and got["c"] == got["d"] == {} and got["a"]


def test_classifier_separates_and_has_no_python(spark):
    texts = ["gas leak at the valve", "fire near the tank", "clean desk today", "lunch was fine", "", None]
    rows = spark.createDataFrame([(f"R{k}", t, int(k % 6 < 2)) for k, t in enumerate(texts * 5)], "report_id string, report_text string, label int")
    model = L.train(rows, "report_text", "label", "report_id")
    found = L.predict(model, rows, "report_text", "report_id")
    assert "Python" not in found._jdf.queryExecution().toString()
    joined = found.join(rows, "report_id")
    assert joined.count() == 20 and joined.filter(F.col("label") != F.col("sif_prediction")).count() == 0
