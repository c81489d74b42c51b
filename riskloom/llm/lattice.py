"""Near copies of embedded reports: E8 lattice hashing of random projections, verified by cosine."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from riskloom.functions.graph import components
from riskloom.functions.lineage import stored

THRESHOLD = 0.93
#: Tables, lattice points a cell is made of, width of the projections, neighbouring cells that are probed.
TABLES, LATTICES, WIDTH, PROBES = 8, 3, 0.4, 6
#: Members of a bucket or component that one task compares with each other; larger ones are cut into blocks.
BLOCK = 512
SEED = 2024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: from a point of the lattice they lead to its neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.vstack([*out, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    rest = x - near
    worst = np.abs(rest).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(rest, worst, -1) >= 0, 1.0, -1.0)
    other = near.copy()
    np.put_along_axis(other, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return np.where((near.sum(axis=-1) % 2 != 0)[..., None], other, near)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half in every direction."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=-1) <= ((x - half) ** 2).sum(axis=-1)
    return np.where(closer[..., None], whole, half)


def _hashed(cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 62-bit number for each row of small integers, in the order of ``salt``'s other axis."""
    out = salt.astype(np.uint64)
    for column in cell.reshape(len(cell), -1).T:
        out = (out ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(2)).astype(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int, lattices: int, width: float, probes: int, seed: int) -> Iterator[tuple[np.ndarray, bool]]:
    """For each table the home cell of every vector and its nearest neighbouring cells, with label and table hashed in."""
    rng, steps = np.random.default_rng(seed), roots()
    n, size = unit.shape
    rows = np.arange(n)
    for t in range(tables):
        projection = rng.normal(size=(size, 8 * lattices)) * width
        x = (unit @ projection + rng.uniform(0, 4, 8 * lattices)).reshape(n, lattices, 8)
        home = nearest(x)
        salt = label.astype(np.int64) * tables + t
        yield _hashed(np.rint(2 * home), salt), True
        gain = ((x - home) @ steps.T).reshape(n, -1)
        best = np.argpartition(-gain, min(probes, gain.shape[1] - 1), axis=1)[:, :probes]
        for p in range(best.shape[1]):
            moved = home.copy()
            moved[rows, best[:, p] // len(steps)] += steps[best[:, p] % len(steps)]
            yield _hashed(np.rint(2 * moved), salt), False


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one batch as rows of length 1, in double precision; they have the same number of components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _filer(tables: int, lattices: int, width: float, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy()) if batch.num_rows else np.empty(0)
            for size in np.unique(sizes):  # vectors of another size are in other cells
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64) * 1_000_003 + int(size)
                for bucket, home in cells(_unit(part.column("embedding")), label, tables, lattices, width, probes, seed + int(size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), part.column("class_id"), pa.array(np.full(len(rows), home))],
                        names=["bucket", "class_id", "home"],
                    )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the buckets that hold two vectors or more, one at home; rows come in order of their bucket."""
    bucket, owner, home = np.empty(0, np.int64), None, np.empty(0, bool)

    def out(upto: int) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, bucket[1:upto] != bucket[: upto - 1]])
        sizes = np.diff(np.r_[starts, upto])
        used = (sizes > 1) & (np.add.reduceat(home[:upto].astype(np.int64), starts) > 0)
        rows, size = np.flatnonzero(np.repeat(used, sizes)), np.repeat(sizes, sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[rows]), owner.take(pa.array(rows)), pa.array(size[rows])], names=["group", "class_id", "size"])

    for batch in batches:
        bucket = np.r_[bucket, batch.column("bucket").to_numpy()]
        owner = batch.column("class_id") if owner is None else pa.concat_arrays([owner, batch.column("class_id")])
        home = np.r_[home, batch.column("home").to_numpy(zero_copy_only=False)]
        if not len(bucket) or bucket[0] == bucket[-1]:
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        yield out(cut)
        bucket, owner, home = bucket[cut:], owner.slice(cut), home[cut:]
    if len(bucket):
        yield out(len(bucket))


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Rows of each group dealt into pairs of blocks (one, other), so that any two meet in exactly one task.

    ``group`` and ``size`` say where a row belongs and how many there are. A group of up to ``block`` rows is one
    block; the blocks of a larger one are met pair by pair, each of them by as many tasks as there are blocks.
    """
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("class_id", F.lit("block")), blocks).cast("int")
    met = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.select(*rows.columns, "own", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"))


def _in_groups(use, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``use`` on the rows of each (group, one, other), which come in that order."""
    held: list[pa.RecordBatch] = []

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("group", "one", "other")], axis=1)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = keys(batch)
        if (last[0] == last[-1]).all() and len(held) > 1 and (keys(held[0])[0] == last[-1]).all():
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = keys(table)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for at, to in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield from use(table.slice(at, to - at))
        held = [table.slice(int(starts[-1]))]
    if held:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = keys(table)
        starts = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]), len(key)]
        for at, to in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield from use(table.slice(at, to - at))


def _joiner(threshold: float):
    """Links that join what a bucket's links join: a member is compared with those not reached yet."""

    def forest(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit = _unit(group.column("embedding"))
        rest, wave, ones, others = np.arange(1, len(unit)), [0], [], []
        while len(rest):
            if not wave:
                wave, rest = [int(rest[0])], rest[1:]
                continue
            x = wave.pop()
            near = unit[rest] @ unit[x] >= threshold
            if near.any():
                found = rest[near]
                ones += [x] * len(found)
                others += found.tolist()
                wave += found.tolist()
                rest = rest[~near]
        if ones:
            owner = group.column("class_id")
            yield pa.RecordBatch.from_arrays([owner.take(pa.array(ones)), owner.take(pa.array(others))], names=["a", "b"])

    return lambda batches: _in_groups(forest, batches)


def _counter(threshold: float):
    """For each member of a block, how many vectors of the other block it is linked with."""

    def count(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit, copies = _unit(group.column("embedding")), group.column("copies").to_numpy()
        own, one = group.column("own").to_numpy(), group.column("one")[0].as_py()
        same = one == group.column("other")[0].as_py()
        left = np.arange(len(unit)) if same else np.flatnonzero(own == one)
        right = left if same else np.flatnonzero(own != one)
        total = np.zeros(len(unit), dtype=np.int64)
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            near = unit[part] @ unit[right].T >= threshold
            if same:
                near[np.arange(len(part)), np.arange(at, at + len(part))] = False
            total[part] += near @ copies[right]
            if not same:
                total[right] += near.T @ copies[part]
        yield pa.RecordBatch.from_arrays([group.column("class_id"), pa.array(total)], names=["class_id", "n"])

    return lambda batches: _in_groups(count, batches)


def comparable(vector: Column) -> Column:
    """True for a vector without null or non-finite components that is not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, lattices: int = LATTICES,
    width: float = WIDTH, probes: int = PROBES, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """Reports whose embeddings have a cosine of ``threshold`` or more, among those with the same label.

    Reads report_id, embedding (array of numbers) and label (an integer). In each of several tables a vector is
    projected at random to ``lattices`` times 8 dimensions and filed under the nearest points of the E8 lattice;
    it also looks into the ``probes`` neighbouring cells nearest to it. What meets is compared in double
    precision. Ids alone are shuffled by cell; vectors follow only to cells where something meets.

    Vectors that are equal count as one until the end. Of a cell's links a spanning forest is kept; its
    components are then compared in full, in blocks of ``block`` a task, so that links are counted but pairs never
    written. The search finds a share of links that ``tests`` measure against brute force; none found is wrong.
    A larger ``lattices`` or ``width`` makes cells finer, for more vectors, and asks for more tables.

    Returns a row per input row: report_id, n_links (other rows linked with it), component_id (the smallest
    report_id that links reach, itself included). Null labels and vectors that are null, zero, or hold null or
    non-finite components link with nothing; vectors of different length neither. Rows repeated with one id are
    rows of their own, whether their vectors and labels are equal or not. Rows without an id link as others; the
    component of none but such rows is null. Other columns are not looked at. An empty table gives an empty result.
    """
    key = LongType()
    rows = embeddings.select("report_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = comparable(F.col("embedding")) & F.col("label").isNotNull()
    # -0.0 and 0.0 are equal numbers but not equal bytes.
    rows = stored(rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).withColumn("usable", usable))
    linked = rows.filter("usable")
    # A class is one vector under one label. Its number is given once, when the table of classes is written.
    classes = linked.groupBy("label", "embedding").agg(F.min("report_id").alias("least_id"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("class_id", F.monotonically_increasing_id()))
    shape = StructType([StructField("bucket", LongType()), StructField("class_id", key), StructField("home", BooleanType())])
    filed = classes.select("class_id", "label", "embedding").mapInArrow(_filer(tables, lattices, width, probes, seed), shape)
    shape = StructType([StructField("group", LongType()), StructField("class_id", key), StructField("size", LongType())])
    meeting = stored(filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, shape))

    def together(members: DataFrame) -> DataFrame:
        met = _blocked(members, block).join(classes.select("class_id", "copies", "embedding"), "class_id")
        place = ["group", "one", "other"]
        return met.select(*place, "own", "class_id", "copies", "embedding").repartition(*place).sortWithinPartitions(*place)

    pair = StructType([StructField("a", key), StructField("b", key)])
    rooted = stored(components(together(meeting).mapInArrow(_joiner(threshold), pair)))
    named = rooted.join(classes.select(F.col("class_id").alias("node"), "least_id"), "node")
    sizes = named.groupBy("root").agg(F.count("*").alias("size"), F.min("least_id").alias("component_id"))
    members = stored(rooted.join(sizes, "root").select(
        F.xxhash64("root").alias("group"), F.col("node").alias("class_id"), "size", "component_id"))
    tally = StructType([StructField("class_id", key), StructField("n", LongType())])
    counted = together(members.drop("component_id")).mapInArrow(_counter(threshold), tally).groupBy("class_id").agg(F.sum("n").alias("n"))
    of_class = classes.join(counted, "class_id", "left").join(members.select("class_id", "component_id", "size"), "class_id", "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("size").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    met = linked.join(of_class, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
    alone = rows.filter("not usable").select("report_id", F.lit(0).cast("long").alias("n_links"), F.col("report_id").alias("component_id"))
    return met.select("report_id", "n_links", "component_id").unionByName(alone)
