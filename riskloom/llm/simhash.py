"""Near copies of report texts: 64-bit SimHash fingerprints linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskloom.functions.graph import components
from riskloom.functions.lineage import stored
from riskloom.llm.batches import light, parts

WORDS = 3
SEED = 42
#: Fingerprints that share a 32-bit half, above which a bucket is cut by the bytes of the other half.
CROWD = 4096
_HALF = (1 << 32) - 1


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))).tolist()
    starts = [0, *[e + 1 for e in ends[: len(tokens) - words]]]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, total, 1 << 16):  # a very long text takes no more memory than this many shingles
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at + words - 1 :])]
        raw = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        values = np.array([fingerprint(t) for t in batch.column("report_text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("report_id"), pa.array(values.view(np.int64))], names=["report_id", "fingerprint"]
        )


def fingerprints(reports: DataFrame) -> DataFrame:
    """report_id and fingerprint (a long that holds the 64 bits) of every report."""
    light(reports.sparkSession)
    shape = StructType([reports.schema["report_id"], StructField("fingerprint", LongType())])
    return reports.select("report_id", "report_text").mapInArrow(_fingerprints, shape)


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is joined in one bucket: a vertex is compared with those not reached yet."""
    links, rest, wave = [], prints[1:], [prints[0]]
    while len(rest):
        if not wave:
            wave, rest = [rest[0]], rest[1:]
            continue
        x = wave.pop()
        near = np.bitwise_count(rest ^ x) <= bits
        if near.any():
            found = rest[near]
            links += [(x, y) for y in found]
            wave += list(found)
            rest = rest[~near]
    return links


def _linker(bits: int):
    def linked(key: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links within whole buckets, given in order of their key."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        full = (sizes > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
        twos = starts[full & (sizes == 2)]
        x, y = prints[twos], prints[twos + 1]
        near = np.bitwise_count(x ^ y) <= bits
        ones, others = [x[near]], [y[near]]
        many = full & (sizes > 2)
        for at, n in zip(starts[many].tolist(), sizes[many].tolist()):
            links = np.array(_forest(np.unique(prints[at : at + n]), bits), dtype=np.uint64).reshape(-1, 2)
            ones.append(links[:, 0])
            others.append(links[:, 1])
        return np.concatenate(ones), np.concatenate(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints, home = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)

        def out(upto: int) -> pa.RecordBatch:
            a, b = linked(key[:upto], prints[:upto], home[:upto])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = np.r_[key, batch.column("bucket").to_numpy()]
            prints = np.r_[prints, batch.column("fingerprint").to_numpy().view(np.uint64)]
            home = np.r_[home, batch.column("home").to_numpy(zero_copy_only=False)]
            if not len(key) or key[0] == key[-1]:
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            yield out(cut)
            key, prints, home = key[cut:], prints[cut:], home[cut:]
        if len(key):
            yield out(len(key))

    return run


def links(prints: DataFrame, bits: int = 3, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the distinct values of ``fingerprint`` that join all those within ``bits`` (3 at most) of each other.

    Two values that differ in at most three bits differ in at most one bit of one half. Every value is filed
    under both halves and looks up all halves within one bit of its own; in a bucket the complete distances
    are checked and a spanning forest of its links is returned, never all pairs. Where more than ``crowd``
    values share a half, that bucket and its neighbours are cut by the bytes of the other half, of which one
    at least must be equal: no link is lost.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves with a ball of one bit find distances up to 3")
    value = F.col("fingerprint")
    high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(_HALF))
    homes = prints.select("fingerprint", F.explode(F.array(high, low + F.lit(1 << 32))).alias("bucket"))
    flip = F.expr("shiftleft(1L, cast(k % 32 as int))")
    near = prints.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        "fingerprint", F.when(F.col("k") < 32, high.bitwiseXOR(flip)).otherwise(low.bitwiseXOR(flip) + F.lit(1 << 32)).alias("bucket"))
    filed = homes.select("bucket", "fingerprint", F.lit(True).alias("home")).unionByName(
        near.select("bucket", "fingerprint", F.lit(False).alias("home")))
    crowded = stored(homes.groupBy("bucket").count().filter(F.col("count") > crowd).select("bucket"))
    if not crowded.isEmpty():
        around = crowded.select(F.explode(F.concat(F.array("bucket"), F.transform(
            F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).bitwiseXOR(F.col("bucket"))
        ))).alias("bucket")).distinct().withColumn("crowded", F.lit(True))
        other = F.when(F.col("bucket") < F.lit(1 << 32), low).otherwise(high)
        cuts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (
            (F.col("bucket") + F.lit(1 << 34)) * 1024 + k * 256
            + F.call_function("shiftright", other, (k * 8).cast("int")).bitwiseAND(F.lit(255))))
        filed = filed.join(around, "bucket", "left").select(
            F.explode(F.when(F.col("crowded"), cuts).otherwise(F.array("bucket"))).alias("bucket"), "fingerprint", "home")
    shape = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linker(bits), shape)


def near_copies(reports: DataFrame, bits: int = 3, crowd: int = CROWD) -> DataFrame:
    """Reports whose fingerprints are linked, directly or by way of others.

    Words are what white space separates in the text with A to Z lower-cased; the hashes of all three-word
    shingles, repeats included, vote on each bit. Returns one row per input row: report_id, fingerprint (long),
    component_id (the smallest report_id that links reach, its own included). Equal fingerprints are reduced
    to one before the search, so exact copies cost nothing there. A null text counts as empty; texts without
    words have the fingerprint 0 and are linked like any others. Rows with a null id take part; a group in
    which no row has an id has a null component_id. An empty table gives an empty result. Other columns are
    not looked at.
    """
    seen = stored(fingerprints(reports))
    least = stored(seen.groupBy("fingerprint").agg(F.min("report_id").alias("first_id")))
    rooted = components(links(least.select("fingerprint"), bits, crowd)).withColumnRenamed("node", "fingerprint")
    joined = least.join(rooted, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(smallest, "root").select("fingerprint", "component_id")
    return seen.join(named, "fingerprint").select("report_id", "fingerprint", "component_id")
