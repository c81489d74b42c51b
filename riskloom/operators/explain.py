"""Explanations: itemised reasons for a priority, and a check that they do not contradict it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import text as tx
from riskloom.functions.plan import settled
from riskloom.functions.wording import fill
from riskloom.packs import wording as W
from riskloom.packs.rules import FLAG_SEVERITY
from riskloom.packs.scoring import COMPROMISED


def _lines(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def explain(scored: DataFrame) -> DataFrame:
    """Add ``structured_explanation`` (a struct) and the full ``explanation`` text."""
    activity, hazard = F.col("activity"), F.col("hazard")
    barrier, status = F.col("barrier"), F.col("barrier_status")
    raw, priority = F.col("raw_probability"), F.col("priority")
    rules, evidence = F.col("matched_rules"), F.col("evidence")
    reason, escalated = F.col("escalation_reason"), F.col("escalated")
    recurrent = F.col("recurrence") >= W.RECURRENCE_SHOWN_FROM

    staged = scored.withColumns(
        {"__pct": tx.percent(raw), "__recurrence": F.when(recurrent, F.format_string("%.2f", F.col("recurrence")))}
    )
    pct, shown = F.col("__pct"), F.col("__recurrence")
    values = dict(
        activity=activity, hazard=hazard, barrier=barrier, status=status, pct=pct, recurrence=shown, reason=reason
    )

    def say(templates: dict, key: str, **more: Column) -> Column:
        return fill(templates[key], **(values | more))

    def barrier_line(templates: dict, **more: Column) -> Column:
        line = F.when(barrier.isNotNull() & status.isNotNull(), say(templates, "barrier_and_status", **more))
        if "status_only" in templates:
            line = line.when(status.isNotNull(), say(templates, "status_only", **more))
        return line.when(barrier.isNotNull(), say(templates, "barrier_only", **more))

    def by_probability(templates: dict) -> Column:
        return (
            F.when(raw >= W.STRONG_PROBABILITY, say(templates, "probability_high"))
            .when(raw >= W.MODERATE_PROBABILITY, say(templates, "probability_medium"))
            .otherwise(say(templates, "probability_low"))
        )

    def rule_lines(template: str) -> Column:
        return F.transform(rules, lambda r: fill(template, rule=r["rule_name"], label=r["severity_label"]))

    has_rules, has_evidence = F.size(rules) > 0, F.size(evidence) > 0
    signals = _lines(
        say(W.SIGNALS, "activity"),
        say(W.SIGNALS, "hazard"),
        barrier_line(W.SIGNALS),
        by_probability(W.SIGNALS),
        say(W.SIGNALS, "recurrence"),
        F.when(has_evidence, say(W.SIGNALS, "evidence", evidence=F.array_join(F.slice(evidence, 1, 3), ", "))),
    )

    reason_text = (
        F.when(escalated & reason.isNotNull(), reason)
        .when(
            priority == "HIGH",
            F.when(has_rules & (raw >= W.RULE_REASON_PROBABILITY), say(W.REASONS, "high_rules_and_probability"))
            .when(has_rules, say(W.REASONS, "high_rules"))
            .when(status.isin(*COMPROMISED), say(W.REASONS, "high_barrier"))
            .otherwise(say(W.REASONS, "high_probability")),
        )
        .when(
            priority == "MEDIUM",
            F.when(has_rules, say(W.REASONS, "medium_rules"))
            .when(raw >= W.MODERATE_PROBABILITY, say(W.REASONS, "medium_probability"))
            .when(hazard.isNotNull(), say(W.REASONS, "medium_hazard"))
            .otherwise(say(W.REASONS, "medium_other")),
        )
        .otherwise(say(W.REASONS, "low"))
    )

    lower_status = {"status": F.lower(status)}
    names_rule = F.exists(rules, lambda r: reason.contains(r["rule_name"]))
    high = F.concat(
        _lines(say(W.WHY_HIGH, "activity"), say(W.WHY_HIGH, "hazard"), barrier_line(W.WHY_HIGH, **lower_status)),
        rule_lines(W.WHY_HIGH["rule"]),
        _lines(
            F.when(raw >= W.STRONG_PROBABILITY, say(W.WHY_HIGH, "probability")),
            say(W.WHY_HIGH, "recurrence"),
            F.when(escalated & reason.isNotNull() & ~names_rule, say(W.WHY_HIGH, "override")),
        ),
    )
    medium = F.concat(
        _lines(say(W.WHY_MEDIUM, "activity"), say(W.WHY_MEDIUM, "hazard"), barrier_line(W.WHY_MEDIUM)),
        F.when(has_rules, rule_lines(W.WHY_MEDIUM["rule"])).otherwise(
            F.array(F.lit(W.WHY_MEDIUM["no_rule"]))
        ),
        _lines(
            F.when(raw >= W.MODERATE_PROBABILITY, say(W.WHY_MEDIUM, "probability")),
            say(W.WHY_MEDIUM, "recurrence"),
        ),
    )
    sound = barrier.isNotNull() & F.lower(status).isin(*W.SOUND_STATES)
    low = _lines(
        say(W.WHY_LOW, "activity"),
        say(W.WHY_LOW, "hazard"),
        F.when(sound, say(W.WHY_LOW, "barrier_sound", **lower_status)).otherwise(W.WHY_LOW["controls"]),
        F.lit(W.WHY_LOW["no_rule"]),
        say(W.WHY_LOW, "probability"),
    )
    why = F.when(priority == "HIGH", high).when(priority == "MEDIUM", medium).otherwise(low)

    names = F.array_join(F.transform(F.slice(rules, 1, 2), lambda r: r["rule_name"]), ", ")
    # Rules are ordered by severity, so the first one tells whether any is severe.
    first = F.get(rules, F.lit(0))
    drivers = _lines(
        by_probability(W.DRIVERS),
        F.when(
            first["severity"] >= FLAG_SEVERITY,
            say(W.DRIVERS, "rules_severe", rules=names, label=first["severity_label"]),
        )
        .when(has_rules, say(W.DRIVERS, "rules_other", rules=names))
        .otherwise(W.DRIVERS["no_rules"]),
        F.when(
            barrier.isNotNull() & status.isNotNull(),
            F.concat(
                say(W.DRIVERS, "barrier"),
                F.coalesce(say(W.DRIVERS, "barrier_hazard"), F.lit("")),
                F.coalesce(say(W.DRIVERS, "barrier_activity"), F.lit("")),
            ),
        ).otherwise(say(W.DRIVERS, "hazard")),
        say(W.DRIVERS, "recurrence"),
        F.when(escalated, say(W.DRIVERS, "override")),
    )

    staged = staged.withColumns(
        {
            "__signals": signals,
            "__bullets": why,
            "__drivers": drivers,
            "__reason": reason_text,
        }
    )
    bullets = F.col("__bullets")
    staged = staged.withColumn(
        "__why", F.when(F.size(bullets) > 0, bullets).otherwise(F.array(say(W.WHY_HIGH, "nothing")))
    )
    staged = staged.withColumn(
        "__headline", fill(W.HEADLINE, priority=priority, why=F.array_join("__why", "\n- "))
    )
    numbered = F.array_join(
        F.transform("__drivers", lambda d, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), d)), "; "
    )
    full = F.concat_ws(
        " ",
        F.col("__headline"),
        fill(W.DRIVER_LINE, drivers=numbered),
        F.when(has_evidence, fill(W.EVIDENCE_LINE, evidence=F.array_join(F.slice(evidence, 1, 4), ", "))),
        F.lit(W.CLOSING_LINE),
    )
    told = staged.withColumns(
        {
            "explanation": full,
            "structured_explanation": F.struct(
                priority.alias("priority"),
                F.col("__signals").alias("important_detected_signals"),
                rule_lines(W.RULE_LINE).alias("triggered_safety_rules"),
                hazard.alias("extracted_hazard"),
                activity.alias("extracted_activity"),
                barrier_line(W.BARRIER_LINES).alias("barrier_control_status"),
                F.round(raw, 4).alias("model_probability"),
                pct.alias("model_probability_percent"),
                F.col("__reason").alias("reason_for_final_priority"),
                F.col("__why").alias("why"),
                F.col("__headline").alias("formatted_text"),
            ),
        }
    ).drop("__pct", "__recurrence", "__signals", "__bullets", "__why", "__drivers", "__reason", "__headline")
    return settled(scored, told)


def violations(explained: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per contradiction between an explanation and its priority; empty when all is well."""
    said = F.lower(F.array_join("structured_explanation.why", " "))
    priority = F.col("structured_explanation.priority")
    checks = [
        F.when((priority == level) & said.contains(phrase), F.lit(f"{level}: {phrase}"))
        for level, phrases in W.CONTRADICTIONS.items()
        for phrase in phrases
    ]
    unfounded = (F.size("structured_explanation.triggered_safety_rules") == 0) & F.exists(
        "structured_explanation.why", lambda w: F.lower(w).contains(W.RULE_CLAIM)
    )
    checks.append(F.when(unfounded, F.lit(f"no rule: {W.RULE_CLAIM}")))
    return explained.select(key, F.explode(F.array_compact(F.array(*checks))).alias("violation"))
