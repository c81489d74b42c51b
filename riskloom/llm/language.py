"""Languages of reports: Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from riskloom.functions.lineage import stored
from riskloom.llm.batches import light, parts

#: Labelled reports from which the text model is fitted, about: they are drawn by a hash of their id.
SAMPLE = 8_000
#: Hash buckets of letter trigrams; with the languages they bound the size of the model.
BUCKETS = 1 << 16
#: Neighbouring trigrams overlap, so each counts for a part of its log likelihood.
TEMPER = 0.3
#: Reports that a group's parent counts for when its own share of languages is smoothed.
BACKING = 5.0
#: Posterior of the best language below which a report is rejected.
LEAST = 0.5
#: A text is in none of the languages when it is stranger than this to the one nearest to it: 0 is what texts of the language are on
#: average, 1 a text none of whose trigrams was met in fitting. Texts of few trigrams are given more room: so much by their number.
STRANGE, ROOM = 0.46, 0.6
UNKNOWN = "und"

_DROPPED = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^<>]*>")
_MARKUP = re.compile(r"(?i)<(?:!doctype|html|body|head|p|div)\b")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})(?![a-z])")
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def visible(text: str) -> tuple[str, str | None]:
    """The text without markup, and the language that its markup declares."""
    if not _MARKUP.search(text):
        return text, None
    declared = _DECLARED.search(text)
    plain = html.unescape(_TAG.sub(" ", _DROPPED.sub(" ", text)))
    return plain, declared.group(1).lower() if declared else None


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the letter trigrams of the whole text, in blocks."""
    letters = _LETTER[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    for at in range(0, max(1, len(letters) - 2), 1 << 20):
        part = letters[at : at + (1 << 20) + 2].astype(np.uint32)
        if len(part) < 3:
            return
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        code = code[part[1:-1] > 0]  # a letter in the middle
        yield ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(labelled: DataFrame, languages: Sequence[str], sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities (bucket, language) from ``report_id``, ``report_text`` and ``lang`` of labelled reports.

    About ``sample`` rows are used, whatever the size of the table; more could not change a model of this size
    much. Rows with another or no label are left out.
    """
    usable = labelled.filter(F.col("lang").isin(list(languages)) & F.col("report_text").isNotNull())
    total = usable.count()
    if total > sample:
        usable = usable.filter(F.pmod(F.xxhash64("report_id"), F.lit(1_000_003)) < int(1_000_003 * sample / total))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: np.zeros(BUCKETS, dtype=np.int64) for name in languages}
        for batch in parts(batches):
            for text, name in zip(batch.column("report_text").to_pylist(), batch.column("lang").to_pylist()):
                for code in trigrams(visible(text)[0]):
                    counts[name] += np.bincount(code, minlength=BUCKETS)
        for k, name in enumerate(languages):
            used = np.flatnonzero(counts[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[name][used])],
                names=["language", "bucket", "n"],
            )

    shape = StructType([StructField("language", IntegerType()), StructField("bucket", IntegerType()), StructField("n", LongType())])
    tallies = usable.select("report_text", "lang").mapInArrow(counted, shape).groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages)), 0.5)
    for row in tallies.toLocalIterator():  # at most one row for each bucket and language
        table[row.bucket, row.language] += row.n
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def usual(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a trigram of each language scores under its own model on average, and how much less one scores that was never met."""
    wide = table.astype(np.float64)
    mean = (np.exp(wide) * wide).sum(axis=0)
    return mean, mean - wide.min(axis=0)


def strangeness(total: np.ndarray, n: int, mean: np.ndarray, depth: np.ndarray) -> float | None:
    """How far a text's mean score under its best language is below the usual one, as a share of how far it can be."""
    best = int(total.argmax())
    return None if not n else max(0.0, float((mean[best] - total[best] / n) / depth[best])) if depth[best] > 1e-6 else 0.0


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        mean, depth = usual(table)
        for batch in parts(batches):
            scores, counts, declared, strange = [], [], [], []
            for text in batch.column("report_text").to_pylist():
                plain, said = visible(text or "")
                total, n = np.zeros(table.shape[1]), 0
                for code in trigrams(plain):
                    total += table[code].sum(axis=0, dtype=np.float64)
                    n += len(code)
                scores.append((TEMPER * (total - total.max())).tolist())
                counts.append(n)
                declared.append(said)
                strange.append(strangeness(total, n, mean, depth))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("report_id"), batch.column("host"), pa.array(declared, pa.string()),
                    pa.array(counts, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(strange, pa.float64()),
                ],
                names=["report_id", "host", "declared", "trigrams", "scores", "strange"],
            )

    return run


def host_of(address: Column) -> Column:
    """The host of an address with a scheme, in lower case; null for others."""
    return F.nullif(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def identify(reports: DataFrame, labelled: DataFrame, languages: Sequence[str], sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The language of every report, and whether it is accepted.

    Reads report_id, report_text, source_file_path (an address, may be null) and source of ``reports``, and
    report_id, report_text and lang of ``labelled``. Four kinds of evidence are multiplied:

    * text: naive Bayes over hashed letter trigrams of the whole text, its markup taken off;
    * the language that the markup declares, weighed by how often it agrees with the texts that declare it;
    * the suffix of the address, its domain and its host (without an address, the source), as a prior: the
      shares of languages among the reports of each, smoothed towards those of the level above, up to all
      reports. A report's own share is taken out of every level first.

    All shares are sums of text posteriors by grouped aggregation, reduced before the shuffle, so a host with
    a third of all reports costs a row a task. Returns report_id, lang, confidence (posterior), text_lang,
    declared, host, accepted. A report is rejected when no letter is in its text, its best posterior is below
    ``least``, or its text is in none of the languages: stranger to the nearest one than ``STRANGE``, for the
    posterior is shared among the known languages only. Its lang is then "und". Null or empty texts are rejected. Null addresses and sources use the
    shares of all reports. With no languages given nothing is decided: lang is "und" and accepted is null.
    Rows repeated with one id are judged one by one; other columns are not looked at.
    """
    spark, count, key = reports.sparkSession, len(languages), reports.schema["report_id"]
    light(spark)
    if not count:
        return reports.select(
            "report_id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"),
            F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("boolean").alias("accepted"))
    model = spark.sparkContext.broadcast(fit(labelled, languages, sample))
    shape = StructType([
        key, StructField("host", StringType()), StructField("declared", StringType()), StructField("trigrams", LongType()),
        StructField("scores", ArrayType(DoubleType())), StructField("strange", DoubleType()),
    ])
    host = F.coalesce(host_of(F.col("source_file_path").cast("string")), F.col("source").cast("string"))
    scored = reports.select("report_id", "report_text", host.alias("host")).mapInArrow(_scorer(model), shape)
    each = range(count)
    weight = [F.exp(F.col("scores")[k]) for k in each]
    shares = F.array(*[w / sum(weight[1:], weight[0]) for w in weight])
    label = F.split("host", r"\.")
    seen = stored(scored.select(
        "*", shares.alias("q"),
        F.when(F.size(label) > 1, F.concat_ws(".", F.slice(label, -2, 2))).otherwise(F.col("host")).alias("domain"),
        F.when(F.size(label) > 1, F.element_at(label, -1)).otherwise(F.lit("")).alias("suffix"),
    ))

    def tally(*by: str) -> DataFrame:
        # Texts without letters say nothing, so they add nothing.
        voting = seen.filter("trigrams > 0")
        return voting.groupBy(*by).agg(F.array(*[F.sum(F.col("q")[k]) for k in each]).alias("sums"))

    def total(rows: DataFrame, name: str, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("sums")[k]) for k in each]).alias(name))

    hosts = stored(tally("suffix", "domain", "host"))
    domains, suffixes, every = total(hosts, "of_domain", "suffix", "domain"), total(hosts, "of_suffix", "suffix"), total(hosts, "of_all")
    shares_of = hosts.filter("host is not null").withColumnRenamed("sums", "of_host").join(domains, ["suffix", "domain"]).join(suffixes, "suffix")
    first = every.first()
    of_all = F.array(*[F.lit(float(x or 0.0)) for x in (first.of_all if first else [0.0] * count)])
    # A declared language is two or three letters, which bounds this table.
    spoken = tally("declared").filter("declared is not null").withColumnRenamed("sums", "of_declared").withColumnRenamed("declared", "said")
    spoken = stored(spoken)
    declaring = total(spoken.withColumnRenamed("of_declared", "sums"), "of_declaring").first()
    of_declaring = [float(x or 0.0) for x in (declaring.of_declaring if declaring else [0.0] * count)]
    joined = (
        seen.join(shares_of.select("host", "of_host", "of_domain", "of_suffix"), "host", "left")
        .join(F.broadcast(spoken), F.col("declared") == F.col("said"), "left")
    )
    nothing = F.array(*[F.lit(0.0)] * count)
    own = F.when(F.col("trigrams") > 0, F.col("q")).otherwise(nothing)

    def summed(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)

    def once(value: Column, use) -> Column:
        """``use(value)``, with the value computed once and its expression not copied."""
        return F.transform(F.array(value), use)[0]

    def others(sums: Column) -> Column:
        """The sums without the report itself."""
        return F.zip_with(F.coalesce(sums, own), own, lambda x, y: F.greatest(F.lit(0.0), x - y))

    def level(sums: Column, above: Column) -> Column:
        """Shares at one level, smoothed towards the level above."""
        return once(others(sums), lambda parts: once(
            summed(parts), lambda size: F.zip_with(parts, above, lambda x, up: (x + BACKING * up) / (size + BACKING))))

    prior = once(others(of_all), lambda base: once(summed(base), lambda size: F.transform(base, lambda x: (x + 1.0) / (size + count))))
    for name in ("of_suffix", "of_domain", "of_host"):
        prior = level(F.col(name), prior)
    agree = F.zip_with(others(F.col("of_declared")), others(F.array(*[F.lit(x) for x in of_declaring])),
                       lambda x, size: F.log((x + 0.5) / (size + 0.5 * (count + 1))))
    says = F.when(F.col("declared").isNull(), nothing).otherwise(agree)
    evidence = F.zip_with(F.col("scores"), F.zip_with(says, prior, lambda x, p: x + F.log(p)), lambda x, y: x + y)
    names = F.array(*[F.lit(x) for x in languages])

    def decided(points: Column) -> Column:
        return once(F.array_max(points), lambda top: F.struct(
            F.element_at(names, F.array_position(points, top).cast("int")).alias("best"),
            (1.0 / summed(F.transform(points, lambda x: F.exp(x - top)))).alias("confidence"),
        ))

    rows = joined.select(
        "report_id", "trigrams", "strange", "declared", "host", once(evidence, decided).alias("d"),
        F.element_at(names, F.array_position("scores", F.array_max("scores")).cast("int")).alias("by_text"),
    )
    known = F.col("strange") <= STRANGE + ROOM / F.greatest("trigrams", F.lit(1))
    accepted = (F.col("trigrams") > 0) & (F.col("d.confidence") >= least) & known
    return rows.select(
        "report_id", F.when(accepted, F.col("d.best")).otherwise(F.lit(UNKNOWN)).alias("lang"), F.col("d.confidence").alias("confidence"),
        F.when(F.col("trigrams") > 0, F.col("by_text")).alias("text_lang"), "declared", "host", accepted.alias("accepted"),
    )
