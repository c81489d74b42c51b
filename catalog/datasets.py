"""Reading, data quality, splitting, evaluation and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import shared as S
from oracles.base import sql
from riskloom.functions import text as tx
from riskloom.functions.lineage import scratch, stored
from riskloom.operators import evaluate as EV
from riskloom.operators import learn as L
from riskloom.operators import quality as Q
from riskloom.operators import splits as SP
from riskloom.plans import corpus as C
from riskloom.sources import readers as RD
from riskloom.sources import writers as WR

# ------------------------------------------------------------------ reading


@query("scan_labelled", sql("""
select report_id, md5(report_text) as text_digest, sif_precursor, hazard, location, severity, source from labelled"""))
def scan_labelled(spark, folder):
    """Labelled reports written as CSV and read back by column name."""
    path = f"{scratch(spark)}/labelled"
    WR.write_csv(C.labelled(spark, folder), path)
    rows = RD.read_labelled(spark, path, quoted=True)
    return rows.select("report_id", F.md5(F.col("report_text").cast("binary")).alias("text_digest"), "sif_precursor", "hazard",
                       "location", "severity", "source")


_BULK = """
select case when doc_id % 4 = 0 then 'REP-' || upper(substring(md5(text), 1, 16)) else 'DOC-' || doc_id::varchar end as report_id,
  md5(text) as text_digest, lang as location, source, case when doc_id % 3 = 0 then 'high' else 'low' end as severity_self_rated
from documents where doc_id % 10 <> 0 and regexp_matches(text, '\\S')"""


def _bulk_file(spark, folder):
    """Documents as a CSV of bulk reports: every tenth without text, every fourth without an id."""
    path = f"{scratch(spark)}/bulk"
    WR.write_csv(C.table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"))).alias("report_id"),
        F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")).alias("report_text"), F.col("lang").alias("location"), "source",
        F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("severity_self_rated")), path)
    return path


@query("scan_reports", _BULK)
def scan_reports(spark, folder):
    """Bulk scan of a CSV with place, source and self-rating: rows without text are left out, ids are made where there are none."""
    rows = RD.read_reports(spark, _bulk_file(spark, folder), quoted=True)
    return rows.select("report_id", F.md5(F.col("report_text").cast("binary")).alias("text_digest"), "location", "source", "severity_self_rated")


@query("scan_reports_capped", f"select report_id, text_digest from ({_BULK}) order by report_id, text_digest limit 150")
def scan_reports_capped(spark, folder):
    """The same scan with the row cap that is the feature here: the first 150 rows with text in order of their id."""
    rows = RD.read_reports(spark, _bulk_file(spark, folder), quoted=True).withColumn("text_digest", F.md5(F.col("report_text").cast("binary")))
    return RD.first_reports(rows, 150, "text_digest").select("report_id", "text_digest")


@query("import_tabular", """
select p_partkey::varchar as p_partkey, p_name, p_size::varchar as p_size, case when p_size % 4 = 0 then '' else p_brand end as brand from part""")
def import_tabular(spark, folder):
    """Any CSV: here the parts, with empty cells."""
    path = f"{scratch(spark)}/parts"
    WR.write_csv(C.table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_size", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("brand")), path)
    return RD.read_table(spark, path, quoted=True)


@query("import_text_docs", """
select count(*)::bigint as documents, sum(length(body))::bigint as chars, 0::bigint as rejects
from (select conv_id, trim(string_agg(text, ' ' order by turn)) as body from conversations group by 1)""")
def import_text_docs(spark, folder):
    """Conversations written as text files, one file each, and read back as documents."""
    turns = C.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    path = f"{scratch(spark)}/texts"
    body = F.array_join(F.transform("turns", lambda t: t["text"]), " ")
    turns.select("conv_id", body.alias("value")).write.partitionBy("conv_id").mode("overwrite").text(path)
    documents, rejects = RD.read_documents(spark, f"{path}/*/*.txt")
    good = documents.agg(F.count("*").alias("documents"), F.sum(F.length("report_text")).alias("chars"))
    bad = rejects.agg(F.count("*").alias("rejects"))
    return good.withColumn("k", F.lit(1)).join(bad.withColumn("k", F.lit(1)), "k").drop("k")


# ------------------------------------------------------------------ quality


def _documents(spark, folder):
    return C.table(spark, folder, "documents")


@query("dq_columns", """
select 'missing' as side, unnest(['activity', 'barrier', 'hazard', 'location', 'report_id', 'report_text', 'severity', 'sif_precursor']) as name, 0::bigint as filled
union all select 'extra', 'doc_id', count(doc_id) from documents union all select 'extra', 'lang', count(lang) from documents
union all select 'extra', 'n_chars', count(n_chars) from documents union all select 'extra', 'text', count(text) from documents""")
def dq_columns(spark, folder):
    """Columns that the documents lack, and columns beyond those asked for with the number of rows that have them filled."""
    return Q.column_report(_documents(spark, folder))


@query("dq_missing", sql("""
select 'report_id' as column_name, count(*) filter (report_id is null) as missing from labelled
union all select 'report_text', count(*) filter (trim(coalesce(report_text, '')) = '') from labelled
union all select 'sif_precursor', count(*) filter (sif_precursor is null) from labelled
union all select 'hazard', count(*) filter (hazard is null) from labelled
union all select 'severity', count(*) filter (severity is null) from labelled"""))
def dq_missing(spark, folder):
    return Q.missing_values(C.labelled(spark, folder), ["report_id", "report_text", "sif_precursor", "hazard", "severity"], "report_text")


@query("dq_domains", sql("""
select 'severity' as column_name, severity as value, count(*) as rows from labelled
where coalesce(lower(severity) not in ('low', 'medium', 'high', 'critical'), true) group by 2
union all select 'source', source, count(*) from labelled where coalesce(lower(source) not in ('public', 'synthetic', 'anonymized'), true) group by 2
union all select 'sif_precursor', sif_precursor::varchar, count(*) from labelled where coalesce(sif_precursor not in (0, 1), true) group by 2"""))
def dq_domains(spark, folder):
    return Q.domain_violations(C.labelled(spark, folder))


@query("dq_short", "select doc_id, length(text)::int as n_chars from documents where length(text) < 20")
def dq_short(spark, folder):
    return Q.short_texts(_documents(spark, folder), "text", "doc_id")


@query("dq_dup_ids", "select user_id, count(*) as rows from events group by 1 having count(*) > 1")
def dq_dup_ids(spark, folder):
    return Q.duplicate_keys(C.table(spark, folder, "events"), "user_id")


_NORM = r"regexp_replace(regexp_replace(lower(text), '^\s+', ''), '\s+$', '')"


@query("dq_exact_dups", f"select doc_id from documents where {_NORM} in (select {_NORM} from documents group by 1 having count(*) > 1)")
def dq_exact_dups(spark, folder):
    return Q.exact_duplicates(_documents(spark, folder), "text", "doc_id")


@query("dq_near_dups", f"""
select doc_id from (select doc_id, count(*) over (partition by substring({_NORM}, 1, 80)) as heads,
  count(*) over (partition by {_NORM}) as wholes from documents) where heads > 1 and wholes = 1""")
def dq_near_dups(spark, folder):
    return Q.near_duplicates(_documents(spark, folder), "text", "doc_id")


@query("class_dist", "select quality, count(*) as rows, round(count(*) * 100.0::double / sum(count(*)) over (), 1) as percentage from labels group by 1")
def class_dist(spark, folder):
    return Q.distribution(C.table(spark, folder, "labels"), "quality")


@query("source_dist", "select source, count(*) as rows, round(count(*) * 100.0::double / sum(count(*)) over (), 1) as percentage from documents group by 1")
def source_dist(spark, folder):
    return Q.distribution(_documents(spark, folder), "source")


@query("class_warnings", """
select count(*) as classes, round(max(n) / min(n), 1) as imbalance,
  case when count(*) = 1 then 'one class' when count(*) = 2 and max(n) / min(n) > 4 then 'imbalanced' else '' end as warning
from (select toxic, count(*)::double as n from labels group by 1)""")
def class_warnings(spark, folder):
    return Q.class_warnings(C.table(spark, folder, "labels"), "toxic")


@query("dq_overall", sql(f"""
select 2::bigint as files, false as passed from (select count(*) as n from labelled where length(report_text) < 20 or hazard is null) where n > 0
union all select 2, true from (select count(*) as n from labelled where length(report_text) < 20 or hazard is null) where n = 0"""))
def dq_overall(spark, folder):
    """Two files: the labelled reports, and one that does not exist."""
    files = {"labelled.csv": C.labelled(spark, folder), "absent.csv": None}
    return Q.overall(Q.verdicts(files, "report_text", "report_id", ["report_id", "report_text", "hazard", "severity"]))


_GOOD = "hazard is not null and length(report_text) >= 20 and severity is not null"


_FILES = {
    "good_ids": f"select min(report_id) as report_id from labelled where {_GOOD} group by {_NORM.replace('text', 'report_text')}",
    "files": "select 'all.csv' as file, * from labelled union all select 'good.csv', * from labelled where report_id in (select report_id from good_ids)",
}


@query("dq_verdicts", sql(f"""
select file, count(*) as rows, count(*) filter (length(report_text) < 20)::bigint as short, count(*) filter (hazard is null)::bigint as missing,
  bool_and(length(report_text) >= 20 and hazard is not null) and count(*) = count(distinct {_NORM.replace('text', 'report_text')}) as passed
from files group by 1""", _FILES))
def dq_verdicts(spark, folder):
    """Two files, one with faults and one made of its sound rows without copies."""
    rows = C.labelled(spark, folder)
    good = SP.keep_first(rows.filter(_GOOD), "report_text", "report_id")
    verdicts = Q.verdicts({"all.csv": rows, "good.csv": good}, "report_text", "report_id", ["report_id", "report_text", "hazard", "severity"])
    return verdicts.select("file", "rows", "short", "missing", "passed")


# ------------------------------------------------------------------ splits


@query("dedup_first", f"select min(doc_id) as doc_id from documents group by {_NORM}")
def dedup_first(spark, folder):
    return SP.keep_first(_documents(spark, folder), "text", "doc_id").select("doc_id")


def _labelled_first(spark, folder):
    rows = C.table(spark, folder, "documents").join(C.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    return SP.keep_first(rows.select("doc_id", "text", "source", "quality"), "text", "doc_id")


def _apportion(source: str, size: str, name: str, part: str) -> str:
    return f"""
select * exclude (exact_, floor_, draw_), (floor_ + (row_number() over (order by exact_ - floor_ desc, quality) <= draw_ - sum(floor_) over ())::int)::bigint as {name}
from (select *, floor(exact_) as floor_ from (select *, {size} * draw_ / sum({size}) over () as exact_
  from (select *, ceil({part} * sum({size}) over ())::double as draw_ from ({source}))))"""


_SPLIT = {
    "firsts": f"select arg_min(doc_id, doc_id) as doc_id, arg_min(text, doc_id) as text, arg_min(source, doc_id) as source, arg_min(quality, doc_id) as quality from documents join labels using (doc_id) group by {_NORM}",
    "cuts": _apportion("select *, n - n_test as rest from (" + _apportion("select quality::varchar as quality, count(*)::double as n from firsts group by 1", "n", "n_test", "0.15::double") + ")",
                       "rest", "n_val", "(0.15::double / (0.70::double + 0.15::double))"),
    "parts": """
select doc_id, text, source, f.quality as quality, case when rn <= n_test then 'test' when rn <= n_test + n_val then 'val' else 'train' end as split
from (select *, row_number() over (partition by quality order by md5('42|' || doc_id::varchar), doc_id) as rn from firsts) f
join cuts c on c.quality = f.quality::varchar""",
}


def _split(spark, folder):
    return SP.stratified_split(_labelled_first(spark, folder), "quality", "doc_id")


@query("stratified_split", sql("select doc_id, quality, split from parts", _SPLIT))
def stratified_split(spark, folder):
    return _split(spark, folder).select("doc_id", "quality", "split")


@query("splits_written", sql("select split, count(*) as rows, sum(doc_id)::bigint as ids from parts group by 1", _SPLIT))
def splits_written(spark, folder):
    """The parts written to a folder each and read back."""
    path = f"{scratch(spark)}/splits"
    WR.write_splits(_split(spark, folder).select("doc_id", "split"), path)
    return spark.read.schema("doc_id long, split string").parquet(path).groupBy("split").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("split_manifest", sql("""
select split, facet, value, count(*) as rows, round(count(*) * 100.0::double / sum(count(*)) over (partition by facet), 2) as pct
from facets group by split, facet, value""", _SPLIT | {"facets": """
select split, 'total' as facet, '' as value from parts union all select split, 'class', quality::varchar from parts
union all select split, 'source', source from parts"""}))
def split_manifest(spark, folder):
    return SP.manifest(_split(spark, folder), "quality", "source")


@query("split_overlap", sql(f"""
select count(*) filter (a and c) as train_test_text_overlap, count(*) filter (a and b) as train_val_text_overlap,
  count(*) filter (b and c) as val_test_text_overlap
from (select bool_or(split = 'train') as a, bool_or(split = 'val') as b, bool_or(split = 'test') as c from parts group by {_NORM})""", _SPLIT))
def split_overlap(spark, folder):
    return SP.overlap(_split(spark, folder), "text")


# ------------------------------------------------------------------ evaluation

_METRICS = {"counts": """
select count(*) filter (y_true = 0 and y_pred = 0)::double as tn, count(*) filter (y_true = 0 and y_pred = 1)::double as fp,
  count(*) filter (y_true = 1 and y_pred = 0)::double as fn, count(*) filter (y_true = 1 and y_pred = 1)::double as tp from predicted""",
    "rates": "select *, tp / (tp + fp) as p, tp / (tp + fn) as r from counts"}


@query("classifier_metrics", sql("""
select (tn + fp + fn + tp)::bigint as n_samples, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp, round(p, 4) as precision, round(r, 4) as recall,
  round(2 * p * r / (p + r), 4) as f1_score, round(5 * p * r / (4 * p + r), 4) as f2_score from rates""", _METRICS))
def classifier_metrics(spark, folder):
    return EV.metrics(C.predictions(spark, folder), "y_true", "y_pred")


@query("metrics_written", sql("""
select tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp, round(p, 4) as precision, round(r, 4) as recall from rates""", _METRICS))
def metrics_written(spark, folder):
    """The metrics written as JSON and read back."""
    path, rows = f"{scratch(spark)}/metrics", EV.metrics(C.predictions(spark, folder), "y_true", "y_pred")
    WR.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path).select("tn", "fp", "fn", "tp", "precision", "recall")


@query("roc_auc", sql("""
select round(sum(rank) filter (y_true = 1) / (p * n) - (p + 1) / (2.0::double * n), 4) as roc_auc from (
  select y_true, rank() over (order by y_prob) + (count(*) over (partition by y_prob) - 1) / 2.0::double as rank,
    count(*) filter (y_true = 1) over () ::double as p, count(*) filter (y_true = 0) over ()::double as n from predicted)
group by p, n"""))
def roc_auc(spark, folder):
    return EV.roc_auc(C.predictions(spark, folder), "y_true", "y_prob")


@query("class_report", sql("""
select label, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1_score, s::bigint as support from (
  select label, p, r, f, s from classes
  union all select 'macro avg', avg(p), avg(r), avg(f), sum(s) from classes
  union all select 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) from classes)""",
    _METRICS | {"classes": """
select *, 2 * p * r / (p + r) as f from (select '0' as label, tn / (tn + fn) as p, tn / (tn + fp) as r, tn + fp as s from counts
  union all select '1', tp / (tp + fp), tp / (tp + fn), tp + fn from counts)"""}))
def class_report(spark, folder):
    return EV.class_report(C.predictions(spark, folder), "y_true", "y_pred")


@query("compare_models", sql("""
select metric, baseline, candidate, round(candidate - baseline, 4) as delta,
  case when candidate > baseline then 'Candidate' when candidate = baseline then 'Tie' else 'Baseline' end as winner from (
  select unnest(['precision', 'recall', 'f1_score', 'f2_score']) as metric,
    unnest([round(p, 4), round(r, 4), round(2 * p * r / (p + r), 4), round(5 * p * r / (4 * p + r), 4)]) as baseline,
    unnest([round(p2, 4), round(r2, 4), round(2 * p2 * r2 / (p2 + r2), 4), round(5 * p2 * r2 / (4 * p2 + r2), 4)]) as candidate
  from rates, (select sum(y_true)::double / count(*) as p2, 1.0::double as r2 from predicted))""", _METRICS))
def compare_models(spark, folder):
    """The predictions against always saying yes."""
    rows = C.predictions(spark, folder)
    yes = rows.withColumn("y_pred", F.lit(1))
    return EV.compare(EV.as_metric_rows(EV.metrics(rows, "y_true", "y_pred")), EV.as_metric_rows(EV.metrics(yes, "y_true", "y_pred")))


@query("class_weights", "select quality, count(*) as rows, round(sum(count(*)) over () / (2.0::double * count(*)), 6) as weight from labels group by 1")
def class_weights(spark, folder):
    return EV.class_weights(C.table(spark, folder, "labels"), "quality")


@query("threshold_sweep", sql("""
select t as threshold, count(*) filter (y_true = 1 and y_prob >= t) as tp, count(*) filter (y_true = 0 and y_prob >= t) as fp,
  count(*) filter (y_true = 1 and y_prob < t) as fn, count(*) filter (y_true = 0 and y_prob < t) as tn
from predicted, (select unnest([0.3::double, 0.5::double, 0.7::double]) as t) group by t"""))
def threshold_sweep(spark, folder):
    return EV.threshold_sweep(C.predictions(spark, folder), "y_true", "y_prob", (0.3, 0.5, 0.7))


@query("early_stop", sql("""
select user_id, arg_max(epoch, [value, -epoch]) as best_epoch, max(value) as best_score, max(epoch) as epochs_run, bool_or(stop is not null) as stopped_early
from (select *, min(case when epoch - last >= 3 then epoch end) over (partition by user_id) as stop
  from (select *, coalesce(max(case when better then epoch end) over (partition by user_id order by epoch), 0) as last
    from (select *, value > coalesce(max(value) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding), -1) as better from log)))
where stop is null or epoch <= stop group by user_id""", {"log": """
select user_id, value, row_number() over (partition by user_id order by event_id) as epoch from events"""}))
def early_stop(spark, folder):
    """Each user's events as a training run, their values as scores."""
    from pyspark.sql import Window as Win

    log = C.table(spark, folder, "events").select(
        "user_id", "value", F.row_number().over(Win.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("epoch"))
    return EV.early_stop(log, "user_id", "epoch", "value")


# ------------------------------------------------------------------ learning

_TFIDF = {
    "words": r"select report_id, regexp_extract_all(lower(report_text), '\w\w+') as w from reports",
    "grams": "select report_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as term from words",
    "tf": "select report_id, term, count(*)::double as n from grams group by 1, 2",
    "vocab": "select term, ln((1 + (select count(*) from reports)::double) / (1 + count(*))) + 1 as idf, sum(n) as total from tf group by 1 order by total desc, term",
    "raw": "select report_id, term, (1 + ln(n)) * idf as x from tf join vocab using (term)",
}


@query("tfidf_weights", sql("""
select report_id, term, round(x / sqrt(sum(x * x) over (partition by report_id)), 6) as weight from raw""", _TFIDF))
def tfidf_weights(spark, folder):
    rows = L.tfidf(C.reports(spark, folder), "report_text", "report_id")
    return rows.select("report_id", "term", F.round("weight", 6).alias("weight"))


def _model(spark, folder):
    from riskloom.operators import rules as R

    rows = stored(R.match_rules(C.reports(spark, folder)).select(
        "report_id", "report_text", (F.col("overall_severity") >= 3).cast("int").alias("label")))
    return L.train(rows, "report_text", "label", "report_id"), rows


_FLAGGED = {"flagged": """
select report_id, report_text, (severity >= 3)::int as label from reports join rollup on t = report_text"""}
_WORDED = "coalesce(regexp_matches(report_text, '\\S'), false)"
#: What the fitted classifier must reach on the reports it was fitted on; some differ by a word that is too rare to weigh.
GOOD = 0.9


def _predicted(spark, folder):
    """All reports with their label and what the classifier says; a report without text has no prediction."""
    model, rows = _model(spark, folder)
    said = L.predict(model, rows, "report_text", "report_id").join(rows.select("report_id", "label"), "report_id")
    silent = rows.filter(tx.is_blank(F.col("report_text"))).withColumnRenamed("report_text", "text")
    return said.unionByName(silent, allowMissingColumns=True)


@query("train_lr", sql(f"""
select count(*) as n_samples, count(*) filter (label = 0) as negatives, count(*) filter (label = 1) as positives,
  count(*) filter (not {_WORDED}) as without_text, true as precise, true as complete, true as good_f1, true as good_f2, true as better_than_always
from flagged""", _FLAGGED))
def train_lr(spark, folder):
    """How well the fitted classifier repeats the rule flag of all reports: counts, and whether its rates are as good as stated.

    A report without text, of which the classifier says nothing, counts as not flagged.
    """
    scored = _predicted(spark, folder).withColumn("said", F.coalesce("sif_prediction", F.lit(0))).select("label", "sif_prediction", "said")
    scored = stored(scored)
    found = EV.metrics(scored, "label", "said").crossJoin(F.broadcast(scored.agg(F.count_if(F.col("sif_prediction").isNull()).alias("without_text"))))
    negatives, positives = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return found.select(
        "n_samples", negatives.alias("negatives"), positives.alias("positives"), "without_text", (F.col("precision") >= GOOD).alias("precise"),
        (F.col("recall") >= GOOD).alias("complete"), (F.col("f1_score") >= GOOD).alias("good_f1"), (F.col("f2_score") >= GOOD).alias("good_f2"),
        (F.col("precision") > positives / F.col("n_samples")).alias("better_than_always"))


@query("predict_lr", sql(f"""
select report_id, report_text as text, label, case when {_WORDED} then true end as on_its_side, case when {_WORDED} then true end as adds_up
from flagged""", _FLAGGED))
def predict_lr(spark, folder):
    """All reports: the whole text, the rule flag, and whether probabilities and label agree; null where there is no text to predict from."""
    scored = _predicted(spark, folder)
    p, label = F.col("sif_probability"), F.col("sif_prediction")
    # A probability beside one half may be rounded across it.
    on_its_side = ((p >= 0.5) == (label == 1)) | (F.abs(p - 0.5) < 1e-4)
    return scored.select(
        "report_id", "text", "label", on_its_side.alias("on_its_side"), (F.abs(p + F.col("non_sif_probability") - 1) < 2e-4).alias("adds_up"))


_ALL_TERMS = {"known": f"select term from (select term, sum(n) as total from tf group by 1 order by total desc, term limit {L.MAX_FEATURES})"}


@query("feature_signs", sql("""
select term, case when max(label) = 1 then 'positive' else 'negative' end as side
from tf join flagged using (report_id) join known using (term) group by 1 having min(label) = max(label)""", _FLAGGED | _TFIDF | _ALL_TERMS))
def feature_signs(spark, folder):
    """Terms of the vocabulary that occur in one class only: at the optimum their coefficient has the sign of the class."""
    model, rows = _model(spark, folder)
    classes = L.terms(rows, "report_text", "report_id").join(rows.select("report_id", "label"), "report_id").groupBy("term").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low = high")
    return L.coefficients(model).join(classes, "term").select(
        "term", F.when(F.col("coefficient") > 0, "positive").otherwise("negative").alias("side"))


@query("top_features", """
select side, rank, true as on_its_side, true as in_order, true as outermost from (values ('positive'), ('negative')) s(side), (select unnest(range(1, 21)) as rank)""")
def top_features(spark, folder):
    """The leading terms by rank: whether their coefficients have the sign of their side, fall in order, and no other term lies further out."""
    from pyspark.sql import Window as Win

    model = _model(spark, folder)[0]
    out = F.when(F.col("side") == "positive", F.col("coefficient")).otherwise(-F.col("coefficient"))
    order = Win.partitionBy("side").orderBy(F.desc("out"), "term")
    leading = L.top_features(model).withColumn("out", out).withColumn("rank", F.row_number().over(order).cast("bigint"))
    ends = L.coefficients(model).agg(F.max("coefficient").alias("most"), F.min("coefficient").alias("least")).select(F.explode(F.array(
        F.struct(F.lit("positive").alias("side"), F.round("most", 4).alias("end")),
        F.struct(F.lit("negative").alias("side"), F.round(-F.col("least"), 4).alias("end")))).alias("e")).select("e.*")
    return leading.join(F.broadcast(ends), "side").select(
        "side", "rank", (F.col("out") > 0).alias("on_its_side"), F.coalesce(F.col("out") <= F.lag("out").over(order), F.lit(True)).alias("in_order"),
        ((F.col("rank") > 1) | (F.col("out") == F.col("end"))).alias("outermost"))
