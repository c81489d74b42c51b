"""Classifier evaluation: confusion counts, metrics, ROC-AUC, reports, comparison, weights, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from riskloom.functions.lineage import stored

METRICS = ("precision", "recall", "f1_score", "f2_score")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 on an empty denominator."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The 2x2 counts, always all four."""
    t, p = F.col(truth), F.col(predicted)
    return rows.agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def _f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return _ratio(F.lit(1 + b2) * precision * recall, F.lit(b2) * precision + recall)


def metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion counts with precision, recall, F1 and F2 to four decimals."""
    c = confusion(rows, truth, predicted)
    c = c.withColumns(
        {"__p": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "__r": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    p, r = F.col("__p"), F.col("__r")
    return c.select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_samples"), "tn", "fp", "fn", "tp",
        F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(_f_beta(p, r, 1), 4).alias("f1_score"), F.round(_f_beta(p, r, 2), 4).alias("f2_score"),
    )


def roc_auc(rows: DataFrame, truth: str, probability: str, ranges: int = 256) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when only one class occurs.

    Equal scores are merged first. Negatives below a score are those in lower ranges (a table of at most
    ``ranges`` rows) plus those below it inside its own range, so no task orders all scores. The ranges are cut at
    quantiles of the scores, so that they hold about as many each, however the scores crowd.
    """
    scores = stored(rows.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    ))
    # A few hundred numbers, whatever the number of scores.
    cuts = scores.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first()["cuts"] or []
    below = F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c <= F.col("score"))
    scores = scores.withColumn("range", F.size(below))
    totals = scores.groupBy("range").agg(F.sum("neg").alias("range_neg"))
    before = Win.partitionBy().orderBy("range").rowsBetween(Win.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("range_neg").over(before), F.lit(0)).alias("lower"))
    inside = Win.partitionBy("range").orderBy("score").rowsBetween(Win.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    wins = (
        scores.withColumn("below", below).join(F.broadcast(offsets), "range")
        .withColumn("wins", F.col("pos") * (F.col("below") + F.col("lower") + F.col("neg") / 2.0))
    )
    return wins.agg(
        F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    ).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("w") / (F.col("p") * F.col("n")), 4)).alias("roc_auc")
    )


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    c = confusion(rows, truth, predicted)
    one = lambda name, tp, fp, fn: F.struct(
        F.lit(name).alias("label"), _ratio(tp, tp + fp).alias("p"), _ratio(tp, tp + fn).alias("r"), (tp + fn).alias("support")
    )
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    classes = c.select(F.explode(F.array(one("0", tn, fn, fp), one("1", tp, fp, fn))).alias("c")).select("c.*")
    classes = classes.withColumn("f1", _f_beta(F.col("p"), F.col("r"), 1))
    # Two rows from here on.
    weights = F.sum("support")
    averages = classes.agg(
        F.array(
            F.struct(F.lit("macro avg").alias("label"), F.avg("p").alias("p"), F.avg("r").alias("r"),
                     weights.alias("support"), F.avg("f1").alias("f1")),
            F.struct(F.lit("weighted avg").alias("label"),
                     _ratio(F.sum(F.col("p") * F.col("support")), weights).alias("p"),
                     _ratio(F.sum(F.col("r") * F.col("support")), weights).alias("r"),
                     weights.alias("support"),
                     _ratio(F.sum(F.col("f1") * F.col("support")), weights).alias("f1")),
        ).alias("a")
    ).select(F.explode("a").alias("a")).select("a.*")
    return classes.unionByName(averages).select(
        "label", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"),
        F.round("f1", 4).alias("f1_score"), "support",
    )


def compare(baseline: DataFrame, candidate: DataFrame, names: tuple[str, str] = ("Baseline", "Candidate")) -> DataFrame:
    """Per metric: both values, the difference and the winner. Both inputs are (metric, value)."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    c = candidate.select("metric", F.col("value").alias("candidate"))
    delta = F.round(F.col("candidate") - F.col("baseline"), 4)
    return b.join(c, "metric").select(
        "metric", "baseline", "candidate", delta.alias("delta"),
        F.when(F.col("candidate") > F.col("baseline"), names[1])
        .when(F.col("candidate") == F.col("baseline"), "Tie").otherwise(names[0]).alias("winner"),
    )


def as_metric_rows(wide: DataFrame, columns: Sequence[str] = METRICS) -> DataFrame:
    """One row of metrics as (metric, value) rows."""
    return wide.unpivot([], [F.col(c) for c in columns], "metric", "value")


def class_weights(rows: DataFrame, label: str, classes: int = 2) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Win.partitionBy())
    return counts.withColumn("weight", F.round(total / (F.lit(float(classes)) * F.col("rows")), 6))


def threshold_sweep(rows: DataFrame, truth: str, probability: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts when p >= t is called positive, for several t in one pass."""
    t = F.col(truth)
    counts = []
    for i, cut in enumerate(thresholds):
        hit = F.col(probability) >= cut
        counts += [
            F.count_if((t == 1) & hit).alias(f"tp{i}"), F.count_if((t == 0) & hit).alias(f"fp{i}"),
            F.count_if((t == 1) & ~hit).alias(f"fn{i}"), F.count_if((t == 0) & ~hit).alias(f"tn{i}"),
        ]
    row = F.array(
        *[
            F.struct(F.lit(float(cut)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")])
            for i, cut in enumerate(thresholds)
        ]
    )
    return rows.agg(*counts).select(F.explode(row).alias("s")).select("s.*")


def early_stop(log: DataFrame, run: str, epoch: str, score: str, patience: int = 3) -> DataFrame:
    """Per training run: best epoch, its score and the epoch at which training stops for lack of progress.

    Progress is a strictly better score than all before. Epochs are numbered 1, 2, 3, ...
    """
    order = Win.partitionBy(run).orderBy(epoch)
    so_far = F.max(score).over(order.rowsBetween(Win.unboundedPreceding, -1))
    staged = log.withColumn("better", F.col(score) > F.coalesce(so_far, F.lit(-1.0)))
    last_best = F.max(F.when(F.col("better"), F.col(epoch))).over(order.rowsBetween(Win.unboundedPreceding, 0))
    staged = staged.withColumn("last_best", F.coalesce(last_best, F.lit(0)))
    staged = staged.withColumn("stopped", F.when(F.col(epoch) - F.col("last_best") >= patience, F.col(epoch)))
    stop = staged.withColumn("stop_epoch", F.min("stopped").over(Win.partitionBy(run)))
    ran = stop.filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    best = F.struct(F.col(score), -F.col(epoch))
    return ran.groupBy(run).agg(
        F.max_by(epoch, best).alias("best_epoch"), F.max(score).alias("best_score"),
        F.max(epoch).alias("epochs_run"), F.max("stop_epoch").isNotNull().alias("stopped_early"),
    )
