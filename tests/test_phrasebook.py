import random

from pyspark.sql import functions as F

from riskloom.operators import extract as X
from riskloom.operators import phrasebook as PB
from riskloom.operators import rules as R
from riskloom.packs.rules import DEFAULT_RULES
from riskloom.plans import corpus as C

FOLDER = "/root/testdata/sf0.001"


def brute(text, phrases, bounded):
    low, out = PB.folded(text or ""), []
    word = lambda at: 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")
    for entry, phrase in phrases:
        at, size = 0, len(phrase or "")
        while size and (at := low.find(PB.folded(phrase), at)) >= 0:
            if bounded and (word(at - 1) or word(at + size)):
                at += 1
                continue
            out.append((at, -(at + size), entry))
            at += size
    return [(e, s, -b) for s, b, e in sorted(out)]


def test_fifty_thousand_phrases_equal_brute_force(spark):
    """Some thousand phrases are in the texts, alone, within each other and over each other; one automaton or seven shares of it."""
    draw = random.Random(3)
    words = ["gas", "Gas Test", "valve", "a", "aa", "Ärger", "İ", "ß", "tank farm", "x_1", "火", "test"]
    phrases = {" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(3000)} | {f"never {k} there" for k in range(47_500)}
    pack = [(k, p) for k, p in enumerate(sorted(phrases))] + [(-1, None), (-2, "")]
    texts = [" ".join(draw.choices([*words, ".", "aaa", "_a"], k=draw.randint(0, 20))) for _ in range(120)] + [None, "", "  "]
    reports = spark.createDataFrame([("R" if k % 3 else None, t) for k, t in enumerate(texts)], "report_id string, report_text string")
    table = spark.createDataFrame(pack, "entry long, phrase string")
    for bounded, most in ((False, 500_000), (True, 500_000), (True, 8_000)):
        found = PB.phrase_hits(reports, table, bounded=bounded, most=most)
        got = sorted(((r.report_text or "", [tuple(h) for h in r.hits]) for r in found.collect()))
        assert got == sorted((t or "", brute(t, pack, bounded)) for t in texts)
        assert found.columns == ["report_id", "report_text", "hits"]


def test_phrases_that_no_report_can_hold_are_not_searched_for(spark):
    """Of 60,000 phrases some dozens stand in the reports: one small automaton, where eight shares would have been searched for."""
    draw = random.Random(5)
    words = ["gas", "Gas Test", "a", "aa", "Ärger", "İ", "ß", "火", "ΑΣ", "y" * 31, "z" * 70]
    phrases = {" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(500)} | {f"never {k} there" for k in range(60_000)}
    pack = [*enumerate(sorted(phrases)), (-1, None), (-2, ""), (-3, "GAS"), (-4, "gas")]
    texts = [" ".join(draw.choices([*words, ".", "aaa"], k=draw.randint(0, 12))) for _ in range(60)] + [None, "", "A"]
    ids = [None if k % 9 == 0 else "twice" if k % 9 == 1 else f"R{k}" for k in range(len(texts))]
    reports = spark.createDataFrame([*zip(ids, texts)], "report_id string, report_text string")
    table = spark.createDataFrame(pack, "entry long, phrase string")
    found = PB.phrase_hits(reports, table, most=8_000)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    hits = [(i, entry) for i, t in zip(ids, texts) for entry, _, _ in brute(t, [p for p in pack if p[0] < 0 or not p[1].startswith("never")], False)]
    wanted = {e: (len({i for i, x in hits if x == e}), sum(x == e for _, x in hits)) for e in {x for _, x in hits}}
    for most in (8_000, 40):
        got = {r.entry: (r.reports, r.occurrences) for r in PB.phrase_totals(reports, table, most=most).collect()}
        assert got == wanted and {-3, -4} <= set(got) and len(got) > 100


def test_plan_does_not_grow_with_the_pack(spark):
    reports = spark.createDataFrame([("A", "gas")], "report_id string, report_text string")
    sizes = []
    for n in (10, 20_000):
        table = spark.range(n).select(F.col("id").alias("entry"), F.concat(F.lit("phrase "), "id").alias("phrase"))
        sizes.append(len(PB.phrase_hits(reports, table)._jdf.queryExecution().toString()))
    assert abs(sizes[0] - sizes[1]) < 200


def test_rules_equal_those_of_the_plan(spark):
    reports = C.reports(spark, FOLDER)
    table = spark.createDataFrame(PB.rule_table(DEFAULT_RULES), "rule_pos int, rule_id string, severity int, signals array<string>")
    got = {(r.report_id, r.rule_id, r.severity, tuple(r.signals)) for r in PB.match_rule_table(reports, table).collect()}
    planned = R.match_rules(reports).select("report_id", F.explode("matched_rules").alias("m")).select("report_id", "m.*").collect()
    assert got == {(r.report_id, r.rule_id, r.severity, tuple(r.signals)) for r in planned} and len(got) > 500


def test_gazetteers_equal_those_of_the_plan(spark):
    reports = C.reports(spark, FOLDER)
    table = X.gazetteer_table(spark)
    got = {tuple(r) for r in PB.match_alias_table(reports, table, most=100).select("report_id", "kind", "canonical", "start", "end").collect()}
    planned = X.match_gazetteers(reports, "report_text", X.DEFAULT_GAZETTEERS).select("report_id", F.explode("gazetteer_entities").alias("e")).select(
        "report_id", "e.entity_type", "e.normalized_value", "e.start", "e.end")
    assert got == {tuple(r) for r in planned.collect()} and len(got) > 1000


def test_empty_packs_and_tables(spark):
    reports = spark.createDataFrame([("A", "gas")], "report_id string, report_text string")
    none = spark.createDataFrame([], "entry long, phrase string")
    assert PB.phrase_hits(reports, none).first().hits == []
    assert PB.phrase_hits(reports.limit(0), none).count() == 0
    rules = spark.createDataFrame([], "rule_pos int, rule_id string, severity int, signals array<string>")
    assert PB.match_rule_table(reports, rules).count() == 0
