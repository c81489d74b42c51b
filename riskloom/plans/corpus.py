"""Input tables: reports, reviews and action events read off the business tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import text as tx
from riskloom.packs.gazetteer import DEFAULT_GAZETTEERS
from riskloom.packs.patterns import BARRIER_NOUNS, STATUS_WORDS
from riskloom.packs.rules import DEFAULT_RULES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out evenly before work that costs far more a row than their shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def order_key(report_id: str) -> int | None:
    """The order behind a report id, so that a test on the id reaches the scan; None if there is none."""
    number = report_id.removeprefix("REP-")
    return int(number) if report_id.startswith("REP-") and number.isdigit() else None


def _of_order(orders: DataFrame, report_id: str | None) -> DataFrame:
    return orders if report_id is None else orders.filter(F.col("o_orderkey") == F.lit(order_key(report_id)))


# Sentence parts by order number; their counts (9, 7, 11) share no factor, so all combinations occur.
TASKS = (
    "Pump maintenance began", "A welder started hot work", "Crew performed a vessel entry",
    "Two riggers guided a crane lift", "An electrician opened energized equipment",
    "A painter was working at height", "Routine inspection took place", "Housekeeping was finished",
    "A toolbox meeting was held",
)
PLACES = (
    "at the tank farm", "near the wellhead", "in the pump room", "by the flare stack", "at the pipe yard",
    "in the office block", "on the site road",
)
STATES = (
    "without verified isolation", "with lockout applied", "and no gas test was recorded",
    "while the harness was not worn", "with the fire watch present", "and the guardrail was missing",
    "with a person under the load", "with no permit", "and the barricade was missing",
    "and the ventilation failed", "and everything was in order",
)


def phrases() -> tuple[str, ...]:
    """Every alias, every signal, every state word beside a barrier on either side, and what the other patterns look for."""
    aliases = [a for g in DEFAULT_GAZETTEERS for t in g.terms for a in t.aliases]
    signals = [s for r in DEFAULT_RULES for s in r.signals]
    nouns = [noun for _, forms in BARRIER_NOUNS for noun in forms]
    words = [w for _, group in STATUS_WORDS for w in group]
    prefixed = [f"{w} {nouns[k % len(nouns)]}" for k, w in enumerate(words)]
    postfixed = [f"{nouns[(k * 5 + 2) % len(nouns)]} was {w}" for k, w in enumerate(words)]
    return (*aliases, *signals, *prefixed, *postfixed, *EXAMPLES)


# One sentence part for each activity, equipment and location pattern.
EXAMPLES = (
    "maintenance commenced", "welding operation", "cutting activity", "a crane lift was in progress", "technician entered storage tank",
    "found working at height", "pipeline inspection", "offloading of chemical drums", "operator observed using mobile phone while driving",
    "toolbox meeting was conducted", "painter reported a smell", "H2S alarm was triggered and all were evacuated", "servicing the main pump",
    "repairing mud separator", "a 12-metre scaffold", "inside the north tank farm", "near wellhead 7 flare stack", "into the old pipe yard",
)
# Every so many orders a report is made of two phrases instead of sentence parts.
VARIED, VARIED_AT = 16, 3
#: Reports without words.
BLANKS = ("", "   ", " \t\n ")


def varied_text(number: Column) -> Column:
    """Two phrases, some in capitals or with other blanks between words; every fiftieth text is blank."""
    known = phrases()
    array = tx.text_array(known)
    one = F.get(array, (number % len(known)).cast("int"))
    other = F.get(array, ((number * 7 + 3) % len(known)).cast("int"))
    text = F.concat(F.lit("Crew noted "), one, F.lit(" and "), other, F.lit("."))
    shaped = F.when(number % 5 == 0, F.upper(text)).when(number % 7 == 1, F.replace(text, F.lit("Crew "), F.lit("Crew \t "))).otherwise(text)
    return F.when(number % 50 == 9, F.get(tx.text_array(BLANKS), (number % len(BLANKS)).cast("int"))).otherwise(shaped)


def _part(parts: tuple[str, ...]):
    key = F.col("o_orderkey")
    return F.get(F.array(*[F.lit(p) for p in parts]), (key % len(parts)).cast("int"))


def _report_id():
    return F.concat(F.lit("REP-"), F.col("o_orderkey").cast("string"))


def reports(spark: SparkSession, folder: str, report_id: str | None = None) -> DataFrame:
    """One safety report per order, or the one of an id."""
    orders = _of_order(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), report_id)
    return dealt(orders).select(
        _report_id().alias("report_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderkey") % VARIED == VARIED_AT, varied_text(F.floor(F.col("o_orderkey") / VARIED)))
        .otherwise(F.concat(F.concat_ws(" ", _part(TASKS), _part(PLACES), _part(STATES)), F.lit("."))).alias("report_text"),
        F.lit("near_miss").alias("report_type"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("box-"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".txt"))).alias("source_file_name"),
    )


def reviews(spark: SparkSession, folder: str, report_id: str | None = None) -> DataFrame:
    """Reviews of finished orders; every tenth gets a second, later one."""
    done = _of_order(table(spark, folder, "orders"), report_id).filter(F.col("o_orderstatus") == "F")
    key = F.col("o_orderkey")
    urgency = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM")
        .otherwise("LOW")
    )
    # One pass over the orders: a row yields its review and, for some, the second one.
    first = F.struct(
        F.concat(F.lit("HSE-"), (F.col("o_custkey") % 20).cast("string")).alias("reviewer_id"),
        F.when(key % 3 == 0, "confirmed").when(key % 3 == 1, "corrected").otherwise("rejected").alias("decision"),
        F.when(key % 3 == 1, urgency).alias("corrected_priority"),
        F.when((key % 3 == 1) & (key % 4 == 0), "Hot Work").alias("corrected_activity"),
        F.when((key % 3 == 1) & (key % 5 == 0), "Struck-By").alias("corrected_hazard"),
        F.when((key % 3 == 1) & (key % 7 == 0), "PPE").alias("corrected_barrier"),
        F.when(key % 2 == 0, "checked on site").alias("comments"),
        (F.col("o_orderdate") + F.expr("interval 2 days")).alias("reviewed_at"),
    )
    second = F.struct(
        F.lit("HSE-LEAD").alias("reviewer_id"),
        F.lit("confirmed").alias("decision"),
        *[F.lit(None).cast("string").alias(f"corrected_{c}") for c in ("priority", "activity", "hazard", "barrier")],
        F.lit(None).cast("string").alias("comments"),
        (F.col("o_orderdate") + F.expr("interval 5 days")).alias("reviewed_at"),
    )
    both = F.when(key % 10 == 0, F.array(first, second)).otherwise(F.array(first))
    return done.select(_report_id().alias("report_id"), F.explode(both).alias("r")).select("report_id", "r.*")


FEEDBACK_TYPES = {"error": "false_positive", "purchase": "false_negative", "click": "label_correction"}


def feedback(spark: SparkSession, folder: str, report_id: str | None = None) -> DataFrame:
    """One feedback entry per event, on every second report; later events name reports that do not exist."""
    events = table(spark, folder, "events")
    if report_id is not None:
        key = order_key(report_id)
        events = events.filter(F.col("event_id") == F.lit(None if key is None or key % 2 else key // 2))
    kind = F.lit("general_feedback")
    for event, name in FEEDBACK_TYPES.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return events.select(
        F.concat(F.lit("FB-"), F.col("event_id").cast("string")).alias("feedback_id"),
        F.concat(F.lit("REP-"), (F.col("event_id") * 2).cast("string")).alias("report_id"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("U-"), F.col("user_id").cast("string"))).alias("user_id"),
        kind.alias("feedback_type"),
        F.when(F.col("event_type") == "error", "LOW").alias("user_suggested_priority"),
        F.col("props").alias("notes"),
        F.col("ts").alias("created_at"),
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving report texts, several per id, for known and for new ids."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("REP-"), (F.col("user_id") * 100).cast("string")).alias("report_id"),
        F.concat(F.col("event_type"), F.lit(" noted in step "), F.col("event_id").cast("string")).alias("report_text"),
        F.concat(F.lit("Unit "), (F.col("event_id") % 9).cast("string")).alias("location"),
        F.lit("near_miss").alias("report_type"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


ACTION_STATES = {"view": "Open", "click": "Assigned", "signup": "In Progress", "purchase": "Verification", "error": "Closed"}


def action_events(spark: SparkSession, folder: str) -> DataFrame:
    """State changes of actions; only an assignment names an assignee."""
    state = F.lit("Open")
    for event, name in ACTION_STATES.items():
        state = F.when(F.col("event_type") == event, name).otherwise(state)
    return table(spark, folder, "events").select(
        F.concat(F.lit("ACT-REP-"), F.col("user_id").cast("string")).alias("action_id"),
        F.col("event_id").alias("seq"),
        state.alias("status"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("HSE-"), (F.col("event_id") % 20).cast("string"))).alias("assigned_to"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality label, as labelled reports."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return documents.join(labels.select("doc_id", "quality"), "doc_id").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("report_id"),
        F.col("text").alias("report_text"),
        F.col("quality").cast("int").alias("sif_precursor"),
        F.lit("Inspection & Audit").alias("activity"),
        F.when(F.col("doc_id") % 3 != 0, "Fire / Explosion").alias("hazard"),
        F.lit("PPE").alias("barrier"),
        F.col("lang").alias("location"),
        F.get(F.array(*[F.lit(s) for s in ("low", "medium", "high", "severe")]), (F.col("doc_id") % 4).cast("int")).alias("severity"),
        F.col("source").alias("source"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Label, probability and prediction per labelled document."""
    probability = (F.col("doc_id") * 37) % 101 / F.lit(100.0)
    return table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("y_true"), probability.alias("y_prob"),
        (probability >= 0.5).cast("int").alias("y_pred"),
    )
