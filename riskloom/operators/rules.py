"""Rule matching: which signal phrases of which rules occur in a report, and what they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import text as tx
from riskloom.functions.plan import in_parts, settled
from riskloom.packs.rules import (
    BLANK_SUMMARY,
    DEFAULT_RULES,
    FLAG_SEVERITY,
    NO_SIGNAL_SUMMARY,
    SEVERITY_LABELS,
    Rule,
)


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    """Most severe first; pack order among equals. Known before any data is read."""
    return sorted(rules, key=lambda r: -r.severity)


def _column(rule: Rule) -> str:
    return f"__signals_{rule.id}"


def match_rules(reports: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "report_text") -> DataFrame:
    """Add ``matched_rules`` (an array of structs, most severe first) and ``overall_severity``.

    All phrases are tested in one pass per report: reports are neither exploded nor shuffled. A phrase is tested in
    reports that hold a word of it, which several phrases share.
    """
    ordered = ranked(rules)
    lowered = F.col("__lowered")
    staged = reports.withColumn("__lowered", F.lower(F.col(text)))
    stem = tx.stems(s.lower() for r in ordered for s in r.signals)
    place = {w: i for i, w in enumerate(dict.fromkeys(stem.values()))}
    held = lambda phrase: F.get("__held", F.lit(place[stem[phrase.lower()]]))
    # Blank and null texts hold nothing. The tests stay out of whole-stage code, where they would be one method too long to compile.
    searched = in_parts(lowered != "")
    staged = staged.withColumn("__held", F.when(searched, F.array(*[lowered.contains(w) for w in place]).cast("array<boolean>")))
    staged = staged.withColumns(
        {f"{_column(r)}_joined": F.when(searched, tx.phrases_in(lowered, r.signals, held)) for r in ordered}
    )
    staged = staged.withColumns({_column(r): tx.cut_phrases(F.col(f"{_column(r)}_joined")) for r in ordered})
    fired = [
        F.when(
            F.size(_column(r)) > 0,
            F.struct(
                F.lit(r.id).alias("rule_id"),
                F.lit(r.name).alias("rule_name"),
                F.lit(r.category).alias("category"),
                F.lit(r.severity).alias("severity"),
                F.lit(SEVERITY_LABELS[r.severity]).alias("severity_label"),
                F.col(_column(r)).alias("signals"),
                F.lit(r.explanation).alias("explanation"),
                F.array(*[F.lit(c) for c in r.conditions]).cast("array<string>").alias("conditions"),
                F.lit(r.reference).alias("reference"),
            ),
        )
        for r in ordered
    ]
    severity = F.greatest(
        F.lit(0), F.lit(0), *[F.when(F.size(_column(r)) > 0, r.severity).otherwise(0) for r in ordered]
    )
    done = staged.withColumns(
        {
            # Null text has no lowered form and no signals; it fires nothing.
            "matched_rules": F.array_compact(F.array(*fired)),
            "overall_severity": severity,
        }
    ).drop("__lowered", "__held", *[_column(r) + c for r in ordered for c in ("", "_joined")])
    return settled(reports, done)


def severity_label(severity: Column) -> Column:
    return tx.lookup(severity, SEVERITY_LABELS)


def rule_score(severity: Column) -> Column:
    return F.round(severity / 4.0, 4)


def roll_up(matched: DataFrame, text: str = "report_text") -> DataFrame:
    """Report-level totals over ``matched_rules``: label, flag, score, categories, evidence line."""
    rules = F.col("matched_rules")
    line = F.array_join(
        F.transform(
            rules,
            lambda r: F.concat(
                r["rule_name"], F.lit(" ("), r["severity_label"], F.lit('): triggered by "'),
                F.array_join(r["signals"], '", "'), F.lit('"'),
            ),
        ),
        " | ",
    )
    return matched.withColumns(
        {
            "overall_severity_label": severity_label(F.col("overall_severity")),
            "flagged": F.col("overall_severity") >= FLAG_SEVERITY,
            "rule_severity_score": rule_score(F.col("overall_severity")),
            "triggered_categories": F.array_distinct(F.transform(rules, lambda r: r["category"])),
            "rule_signals": F.flatten(F.transform(rules, lambda r: r["signals"])),
            "evidence_summary": F.when(F.size(rules) > 0, line)
            .when(tx.is_blank(F.col(text)), BLANK_SUMMARY)
            .otherwise(NO_SIGNAL_SUMMARY),
        }
    )


def rule_rows(matched: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per fired rule, each with the signals of that rule."""
    return matched.select(key, F.explode("matched_rules").alias("rule")).select(key, "rule.*")


def signal_rows(matched: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per fired rule and signal."""
    return rule_rows(matched, key).select(
        key, "rule_id", "category", "severity", F.posexplode("signals").alias("signal_pos", "signal")
    )


RULE_SCHEMA = (
    "pos int, id string, name string, category string, severity int, conditions array<string>, "
    "signals array<string>, explanation string, reference string"
)


def rule_table(spark: SparkSession, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The pack as a table, in load order."""
    rows = [
        (i, r.id, r.name, r.category, r.severity, list(r.conditions), list(r.signals), r.explanation, r.reference)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from a JSON file {"rules": [...]}, in the order of the file; absent fields are null."""
    fields = ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in RULE_SCHEMA.split(", ")[1:])
    raw = spark.read.schema(f"rules array<struct<{fields}>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode("rules").alias("pos", "r")).select("pos", "r.*")


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table without violations, ready for matching; a pack is small."""
    broken = rule_violations(table).limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"rule {r['id'] or r['pos']}: {r['violation']}" for r in broken))
    return [
        Rule(r["id"], r["name"], r["category"], r["severity"], tuple(r["signals"]), r["explanation"], tuple(r["conditions"] or ()), r["reference"] or "")
        for r in table.orderBy("pos").collect()
    ]


def rule_violations(rules: DataFrame) -> DataFrame:
    """Rows of a rule table that break a pack requirement, with the requirement each breaks."""
    absent = [
        F.when(F.col(c).isNull(), F.lit(f"missing {c}"))
        for c in ("id", "name", "category", "severity", "signals", "explanation")
    ]
    checks = absent + [
        F.when(~F.col("severity").between(1, 4), "severity outside 1-4"),
        F.when(F.size("signals") == 0, "no signals"),
    ]
    return rules.select(
        "pos", "id", F.explode(F.array_compact(F.array(*checks))).alias("violation")
    )


def catalogue(rules: DataFrame) -> DataFrame:
    """One row: number of rules, their ids and distinct categories in load order."""
    in_order = F.sort_array(F.collect_list(F.struct("pos", "id", "category")))
    return rules.agg(F.count("*").alias("rule_count"), in_order.alias("r")).select(
        "rule_count",
        F.transform("r", lambda r: r["id"]).alias("rule_ids"),
        F.array_distinct(F.transform("r", lambda r: r["category"])).alias("categories"),
    )
