import pytest
from pyspark.sql import functions as F

from riskloom.functions import vectors as VX
from riskloom.operators import learn as L
from riskloom.operators import models as M
from riskloom.operators import rules as R
from riskloom.operators import similar as SIM
from riskloom.plans import corpus as C
from riskloom.plans.triage import triage

FOLDER = "/root/testdata/sf0.001"


def test_batches_are_bounded_and_ask_once():
    asked = []

    def model(texts):
        asked.append(texts)
        return [len(t) for t in texts]

    texts = ["aaaa", "b", "cc", "b", "d" * 30, "", "cc"]
    assert M.batched(texts, model, chars=5) == [4, 1, 2, 1, 30, 0, 2]
    assert sorted(t for batch in asked for t in batch) == sorted(set(texts)) and all(sum(map(len, b)) <= 5 or len(b) == 1 for b in asked)
    assert M.batched([], model) == []
    with pytest.raises(ValueError):
        M.batched(["a", "b"], lambda texts: [1])


def test_exported_classifier_gives_the_same_probabilities(spark):
    rows = R.match_rules(C.reports(spark, FOLDER)).select("report_id", "report_text", (F.col("overall_severity") >= 3).cast("int").alias("label")).cache()
    model = L.train(rows, "report_text", "label", "report_id")
    scorer = M.text_scorer(M.linear(M.exported(model)), chars=500)
    scored = rows.withColumn("p", scorer(F.col("report_text")))
    known = L.predict(model, rows, "report_text", "report_id").select("report_id", "sif_probability")
    assert scored.join(known, "report_id").filter(F.abs(F.col("p") - F.col("sif_probability")) > 6e-5).isEmpty()
    blank = scored.filter(F.trim(F.regexp_replace("report_text", r"\s", "")) == "")
    assert blank.count() > 0 and blank.filter("p is not null").isEmpty() and known.count() + blank.count() == rows.count()


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    def load():
        (tmp_path / f"load-{__import__('uuid').uuid4()}").touch()
        return lambda texts: [0.5] * len(texts)

    rows = spark.range(4000).repartition(16).select(F.concat(F.lit("report "), "id").alias("t"))
    scored = rows.withColumn("p", M.text_scorer(load)(F.col("t")))
    assert scored.agg(F.sum("p")).first()[0] == 2000 and 1 <= len(list(tmp_path.iterdir())) <= 8


def test_scorer_in_the_triage_and_embedder_in_similarity(spark):
    reports = C.reports(spark, FOLDER).filter("pos < 200")
    sure = M.text_scorer(lambda: lambda texts: [0.9 if "office" in t else 0.01 for t in texts])
    decided = triage(reports, probability=F.coalesce(sure(F.col("report_text")), F.lit(0.0)), explained=False)
    assert decided.filter(F.col("report_text").contains("office") & (F.col("priority") != "HIGH")).isEmpty()
    embed = M.text_embedder(lambda: M.hashed())
    texts = SIM.distinct_texts(reports).filter("trim(text) <> ''")
    both = texts.select(embed(F.col("text")).alias("a"), VX.hash_embedding("text").alias("b"))
    far = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    assert both.filter(far > 1e-12).isEmpty() and both.count() > 100
