import corpus_pipeline as CP
from tests.llm.test_pipeline import documents

A = "The worker entered the vessel without a gas test and nobody stood watch at the open hatch."
B = "Somebody saw the crane lift its load over the walkway while people were standing there."


def left(spark, stage, rows, tmp_path):
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_one_id_with_two_texts(spark, tmp_path):
    assert left(spark, CP.exact, [(5, A), (5, B), (3, A)], tmp_path) == [(3, A), (5, B)]
    assert left(spark, CP.languages, [(5, A), (5, "12345 678"), (3, B)], tmp_path) == [(3, B), (5, A)]
    long = " ".join(f"step {k} of the work" for k in range(100))
    assert left(spark, CP.near, [(5, long + " done"), (5, B), (3, long + " over")], tmp_path) == [(3, long + " over"), (5, B)]


def test_copies_without_an_id_are_dropped(spark, tmp_path):
    assert left(spark, CP.exact, [(None, A), (3, A), (None, B), (None, B)], tmp_path) == [(3, A), (None, B)]
    long = " ".join(f"step {k} of the work" for k in range(100))
    assert left(spark, CP.near, [(None, long + " done"), (None, B), (3, long + " over")], tmp_path) == [(3, long + " over"), (None, B)]
    assert left(spark, CP.languages, [(None, A), (None, "12345 678"), (3, B)], tmp_path) == [(3, B), (None, A)]
