"""The triage plan: reports in, decisions out, in one projection-only stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import text as tx
from riskloom.operators import explain as E
from riskloom.operators import extract as X
from riskloom.operators import rules as R
from riskloom.operators import score as SC
from riskloom.packs.rules import DEFAULT_RULES, Rule
from riskloom.packs.scoring import DEFAULT_SCORING, ScoringPack

# Spans at least this sure count as evidence.
EVIDENCE_CONFIDENCE = 0.85
# With all four of these given, nothing is extracted.
REQUIRED = ("activity", "hazard", "barrier", "barrier_status")


def evidence() -> Column:
    """Rule signals, then confident span texts; distinct, in order of first appearance."""
    confident = F.transform(
        F.filter("entities", lambda e: e["confidence"] >= EVIDENCE_CONFIDENCE), lambda e: e["text"]
    )
    return F.array_distinct(F.concat(F.col("rule_signals"), confident))


def prefer_given(extracted: DataFrame, given: Mapping[str, Column]) -> DataFrame:
    """Values the caller supplies win over extracted ones, field by field."""
    supplied = {f"__given_{k}": tx.non_empty(v.cast("string")) for k, v in given.items()}
    staged = extracted.withColumns(supplied)
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & (F.col(f"__given_{name}").isNotNull() if name in given else F.lit(False))
    staged = staged.withColumn("__complete", complete)
    chosen = {}
    for name in (*REQUIRED, "extracted_location", "equipment"):
        found = F.when(~F.col("__complete"), F.col(name))
        chosen[name] = F.coalesce(F.col(f"__given_{name}"), found) if name in given else found
    empty = F.array().cast(X.ENTITIES)
    chosen["entities"] = F.when(F.col("__complete"), empty).otherwise(F.col("entities"))
    return staged.withColumns(chosen).drop("__complete", *supplied)


def triage(
    reports: DataFrame,
    text: str = "report_text",
    rules: Sequence[Rule] = DEFAULT_RULES,
    extraction: X.ExtractionPack = X.DEFAULT_EXTRACTION,
    scoring: ScoringPack = DEFAULT_SCORING,
    probability: Column | None = None,
    recurrence: Column | None = None,
    given: Mapping[str, Column] | None = None,
    use_patterns: bool = True,
    explained: bool = True,
) -> DataFrame:
    """Match rules, extract entities, score, prioritise and explain a table of reports.

    Row-wise throughout: no shuffle, no Python, the same for a batch and for a stream.
    """
    analysed = X.extract(R.roll_up(R.match_rules(reports, rules, text), text), text, extraction, use_patterns)
    if given:
        analysed = prefer_given(analysed, given)
    analysed = analysed.withColumn("evidence", evidence())
    scored = SC.score(analysed, text, probability, recurrence, scoring)
    return E.explain(scored) if explained else scored
