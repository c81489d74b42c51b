"""Scoring: classifier fallback, factor scores, weighted composite, escalation and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import text as tx
from riskloom.functions.plan import settled
from riskloom.packs import scoring as S
from riskloom.packs import wording as W
from riskloom.functions.wording import fill


def unit(value: Column) -> Column:
    """Clamp to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double"))))


def fallback_probability(severity: Column, text: Column) -> Column:
    """Probability assumed from rule severity when no classifier is plugged in; 0 for blank text."""
    estimate = F.least(F.lit(S.FALLBACK_CAP), severity / 4.0 * S.FALLBACK_SLOPE + S.FALLBACK_BASE)
    return (
        F.when(tx.is_blank(text), 0.0).when(severity > 0, estimate).otherwise(S.FALLBACK_QUIET)
    )


def probability_label(probability: Column) -> Column:
    label = F.when(F.lit(False), "")
    for floor, name in S.PROBABILITY_LABELS[:-1]:
        label = label.when(probability >= floor, name)
    return F.when(probability.isNotNull(), label.otherwise(S.PROBABILITY_LABELS[-1][1]))


def factors(
    probability: Column,
    severity: Column,
    barrier_status: Column,
    hazard: Column,
    activity: Column,
    recurrence: Column,
    pack: S.ScoringPack = S.DEFAULT_SCORING,
) -> dict[str, Column]:
    """The six factors, each in [0, 1]; recurrence is null when unknown."""
    return {
        "model_probability": unit(probability),
        "rule_severity": unit(severity / 4.0),
        "barrier_failure": tx.lookup(barrier_status, pack.barriers, pack.unlisted),
        "critical_hazard": tx.lookup(hazard, pack.hazards, pack.unlisted),
        "critical_activity": tx.lookup(activity, pack.activities, pack.unlisted),
        "recurring_pattern": unit(recurrence),
    }


def composite(f: dict[str, Column], pack: S.ScoringPack = S.DEFAULT_SCORING) -> Column:
    """Weighted sum, clamped to [0, 1].

    Without a recurrence signal the other weights are scaled to sum to one; with one they are used as
    they are, so the weights then sum to 1.10 and only the clamp bounds the score.
    """
    core = [k for k in pack.weights if k != "recurring_pattern"]
    total = sum(pack.weights[k] for k in core)

    def weighted(scale: float) -> Column:
        terms = [F.lit(pack.weights[k] / scale) * f[k] for k in core]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    with_recurrence = weighted(1.0) + F.lit(pack.weights["recurring_pattern"]) * f["recurring_pattern"]
    return unit(F.when(f["recurring_pattern"].isNull(), weighted(total)).otherwise(with_recurrence))


def score(
    analysed: DataFrame,
    text: str = "report_text",
    probability: Column | None = None,
    recurrence: Column | None = None,
    pack: S.ScoringPack = S.DEFAULT_SCORING,
) -> DataFrame:
    """Add probability, factor scores, composite, priority and escalation to analysed reports.

    ``probability`` is any double column, for instance a classifier's output or a pandas UDF over the
    text; where it is null, or when none is given, the fallback applies.
    """
    fallback = fallback_probability(F.col("overall_severity"), F.col(text))
    staged = analysed.withColumns(
        {
            "raw_probability": fallback if probability is None else F.coalesce(probability.cast("double"), fallback),
            "recurrence": (F.lit(None) if recurrence is None else recurrence).cast("double"),
        }
    )
    parts = factors(
        F.col("raw_probability"), F.col("overall_severity"), F.col("barrier_status"), F.col("hazard"),
        F.col("activity"), F.col("recurrence"), pack,
    )
    staged = staged.withColumns({f"__f_{k}": v for k, v in parts.items()})
    named = {k: F.col(f"__f_{k}") for k in parts}
    staged = staged.withColumn("composite_score", composite(named, pack))
    staged = staged.withColumn(
        "factor_scores", F.struct(*[F.round(c, 4).alias(k) for k, c in named.items()])
    ).drop(*[f"__f_{k}" for k in parts])
    return settled(analysed, prioritise(staged, pack))


def prioritise(scored: DataFrame, pack: S.ScoringPack = S.DEFAULT_SCORING) -> DataFrame:
    """Apply the escalation policies, then the bands."""
    status = F.col("barrier_status")
    by_rule = F.lit(pack.escalate_on_critical_rule) & (F.col("overall_severity") >= pack.critical_severity)
    # An unlisted hazard never escalates, although it scores the default multiplier.
    by_barrier = (
        F.lit(pack.escalate_on_critical_barrier)
        & (tx.lookup(F.col("hazard"), pack.hazards, 0.0) >= pack.critical_hazard)
        & F.coalesce(status.isin(*S.COMPROMISED), F.lit(False))
    )
    staged = scored.withColumns({"__by_rule": by_rule, "__by_barrier": by_barrier})
    escalated = F.col("__by_rule") | F.col("__by_barrier")
    raw, base = F.col("raw_probability"), F.col("composite_score")
    priority = (
        F.when(escalated | (base >= pack.high) | (raw >= pack.model_high), "HIGH")
        .when((base >= pack.medium) | (raw >= pack.model_medium), "MEDIUM")
        .otherwise("LOW")
    )
    final = F.when(escalated, F.greatest(base, F.lit(pack.high + pack.escalation_margin))).otherwise(base)
    reason = F.when(F.col("__by_rule"), W.ESCALATION_RULE).when(
        F.col("__by_barrier"), fill(W.ESCALATION_BARRIER, hazard=F.col("hazard"), status=status)
    )
    return staged.withColumns(
        {
            "priority": priority,
            "priority_score": F.round(final, 4),
            "escalated": escalated,
            "escalation_reason": reason,
            "sif_probability": F.round(raw, 4),
        }
    ).drop("__by_rule", "__by_barrier")


def legacy_score(matched: DataFrame, text: str = "report_text") -> DataFrame:
    """The older two-factor score with four bands, its word count and explanation."""
    base = F.round(
        S.LEGACY_RULE_WEIGHT * F.col("rule_severity_score")
        + S.LEGACY_MODEL_WEIGHT * S.LEGACY_MODEL_CONFIDENCE,
        4,
    )
    trimmed = tx.strip(F.coalesce(F.col(text), F.lit("")))
    staged = matched.withColumns(
        {
            "legacy_score": F.when(F.col("flagged"), F.greatest(base, F.lit(S.LEGACY_FLAG_FLOOR))).otherwise(base),
            "word_count": F.when(trimmed == "", 0).otherwise(
                F.size(F.split(trimmed, tx.FLAGS + r"\s+"))
            ),
        }
    )
    band = F.when(F.lit(False), "")
    for floor, name in S.LEGACY_BANDS[:-1]:
        band = band.when(F.col("legacy_score") >= floor, name)
    fired = fill(
        W.LEGACY_FIRED,
        count=F.size("matched_rules").cast("string"),
        rules=F.array_join(F.transform("matched_rules", lambda r: r["rule_name"]), ", "),
        categories=F.array_join("triggered_categories", ", "),
        label=F.col("overall_severity_label"),
        score=F.format_string("%.2f", F.col("legacy_score")),
    )
    nothing = fill(W.LEGACY_NOTHING, words=F.col("word_count").cast("string"))
    return staged.withColumns(
        {
            "legacy_band": band.otherwise(S.LEGACY_BANDS[-1][1]),
            "legacy_explanation": F.when(F.size("matched_rules") > 0, fired).otherwise(nothing),
        }
    )
