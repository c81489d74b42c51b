"""Near copies of report texts: five-word shingles, MinHash bands for candidates, whole texts compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from riskloom.functions.graph import components
from riskloom.functions.lineage import stored
from riskloom.llm.batches import light, parts

WORDS = 5
#: Share of common shingles from which two texts are near copies.
LEAST = 0.8
#: Bands of minima and minima a band: at a share of 0.8 all bands miss a pair in 3 of a million cases.
BANDS, ROWS = 24, 4
SEED = 42
#: Texts of a bucket that are compared in one task, and those that stand in every part of a larger bucket.
BLOCK, PIVOTS = 512, 8

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; a text of fewer words is one shingle, also one without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))).tolist()
    starts = [0, *[e + 1 for e in ends[: len(tokens) - words]]]
    found = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])), np.uint64, len(starts))
    return np.unique(found)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def bands(found: np.ndarray) -> list[int]:
    """A signed hash for each band of minima, different bands told apart."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):  # a very long text takes no more memory than this many shingles
        part = found[at : at + 4096]
        mixed = (part ^ (part >> np.uint64(29)))[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        keys = [bands(shingles(t)) for t in batch.column("report_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("report_id"), batch.column("digest"), pa.array(keys, pa.list_(pa.int64()))], names=["report_id", "digest", "bands"])


def _forest(digests: list[bytes], sets: list[np.ndarray], least: float) -> list[tuple[bytes, bytes]]:
    """Links that join what is joined among some texts: a text is compared with those not reached yet."""
    links, rest, wave = [], list(range(1, len(sets))), [0]
    while rest:
        if not wave:
            wave.append(rest.pop(0))
            continue
        x, left = wave.pop(), []
        for y in rest:
            # Sizes alone bound the similarity.
            few, many = sorted((len(sets[x]), len(sets[y])))
            if few >= least * many and similarity(sets[x], sets[y]) >= least:
                links.append((digests[x], digests[y]))
                wave.append(y)
            else:
                left.append(y)
        rest = left
    return links


def _linker(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, digests, sets = None, [], []

        def out() -> pa.RecordBatch:
            links = _forest(digests, sets, least)
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"])

        for batch in parts(batches):
            for key, digest, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "digest", "report_text"))):
                if key != unit:
                    if len(sets) > 1:
                        yield out()
                    unit, digests, sets = key, [], []
                digests.append(digest)
                sets.append(shingles(text))
        if len(sets) > 1:
            yield out()

    return run


_LINKS = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def _compared(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links within the texts that stand in one unit."""
    return members.select("unit", "digest").distinct().join(texts, "digest").select("unit", "digest", "report_text") \
        .repartition("unit").sortWithinPartitions("unit").mapInArrow(_linker(least), _LINKS)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def resembling(reports: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Reports whose texts have ``least`` of their five-word shingles in common, directly or by way of others.

    Words are what white space separates, with A to Z lower-cased; shingles count once (Jaccard similarity). Texts
    that agree in a band of MinHash values are candidates, and of those the whole texts are compared: no pair below
    ``least`` is linked, and of those at 0.8 or more all but about 3 in a million are candidates. Buckets with the
    same members in several bands are compared once. A bucket of more than ``block`` texts is compared in parts that
    share some pivots, which settles copies of one text; where parts remain unlinked all pairs of parts are compared.

    Returns one row per input row: report_id, component_id (the smallest report_id that links reach, its own
    included). A null text counts as empty; texts without words are near copies of each other. Rows with a null
    id take part; a group in which no row has an id has a null component_id. Other columns are not looked at.
    """
    light(reports.sparkSession)
    rows = reports.select("report_id", "report_text", text_digest(F.col("report_text")).alias("digest"))
    shape = StructType([reports.schema["report_id"], StructField("digest", BinaryType()), StructField("bands", ArrayType(LongType()))])
    seen = stored(rows.select("report_id", "report_text", "digest").mapInArrow(_sketches, shape))
    texts = stored(seen.groupBy("digest").agg(F.min("report_id").alias("first_id"), F.first("bands").alias("bands")))
    filed = texts.select("digest", F.explode("bands").alias("bucket"))
    same = [F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"x{k}") for k in range(2)]
    buckets = filed.groupBy("bucket").agg(F.count("*").alias("n"), *same).filter("n > 1").groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    members = stored(filed.join(buckets.select("bucket", "n"), "bucket"))
    wanted = members.select("digest").distinct()
    held = stored(rows.select("digest", "report_text").join(wanted, "digest", "left_semi").dropDuplicates(["digest"]))
    # Parts of about a block by hash; the pivots stand in every part.
    count = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("digest", F.lit(7)), count).cast("int")
    crowd = stored(members.filter(F.col("n") > block).withColumns({"count": count, "part": part}))
    small = members.filter(F.col("n") <= block).select(F.col("bucket").alias("unit"), "digest")
    if crowd.isEmpty():
        links = _compared(small, held, least)
    else:
        pivots = crowd.groupBy("bucket", "count").agg(*[F.min(F.struct(F.xxhash64("digest", F.lit(100 + k)).alias("h"), "digest")).alias(f"p{k}") for k in range(PIVOTS)])
        unit = F.xxhash64("bucket", "part", F.lit(0)).alias("unit")
        shared = pivots.select("bucket", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("part"), F.array(*[F.col(f"p{k}.digest") for k in range(PIVOTS)]).alias("ps"))
        parted = crowd.select(unit, "digest").unionByName(shared.select(unit, F.explode("ps").alias("digest")))
        links = stored(_compared(small.unionByName(parted), held, least))
        found = components(links).withColumnRenamed("node", "digest")
        placed = stored(crowd.join(found, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
        # Where a bucket is in one piece, no comparison can add to it.
        apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
        others = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda k: F.xxhash64("bucket", F.least(k, "part"), F.greatest(k, "part"), F.lit(1)))
        pairs = placed.join(apart, "bucket", "left_semi").select(F.explode(others).alias("unit"), "digest")
        links = links.unionByName(_compared(pairs, held, least))
    rooted = components(links).withColumnRenamed("node", "digest")
    joined = texts.select("digest", "first_id").join(rooted, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(smallest, "root").select("digest", "component_id")
    return seen.select("report_id", "digest").join(named, "digest").select("report_id", "component_id")
