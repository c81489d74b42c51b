"""Similarity over vectors: exact neighbours, recurrence against known high-risk reports, exact edges.

Every pair that can reach the threshold is compared, exactly, and no other need be: vectors are placed with
the nearest of a few pivots, and by the triangle inequality on angles a vector can only be similar to members of
those blocks whose pivot is within the block's radius and the threshold's angle of it. Equal texts are compared
once. What leaves a task is small by construction: a few neighbours per row, or a spanning forest of the similar
pairs, never the pairs themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window as Win, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from riskloom.functions import text as tx
from riskloom.functions import vectors as V
from riskloom.functions.lineage import stored

# Rows per block: two blocks of 384 doubles are some 25 MB.
BLOCK_ROWS = 4096
# Pivots at most: their vectors (1.5 MB) and radii go to every task.
PIVOTS = 512
# Rows of the product held at a time.
SLICE_ROWS = 512
# Rows that a task looks for neighbours of at a time.
ROWS_IN_HAND = 65_536
# Angles are widened by this much, so that rounding loses no pair.
SLACK = 1e-6


def distinct_texts(reports: DataFrame, text: str = "report_text", key: str = "report_id", order: str = "pos") -> DataFrame:
    """One row per text: digest, text, first position and number of copies. Copies are merged before the shuffle."""
    return (
        reports.groupBy(F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("vid"))
        .agg(F.min_by(text, order).alias("text"), F.min(order).alias("first"), F.count("*").alias("copies"))
    )


def embedded(texts: DataFrame, embedding: Column | None = None) -> DataFrame:
    """Add ``vec``: the hashed embedding, or any array column or pandas UDF the caller supplies."""
    return texts.withColumn("vec", V.hash_embedding("text") if embedding is None else embedding)


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    m = np.array(pdf["vec"].tolist(), dtype=np.float64)
    if m.ndim != 2:
        return np.zeros((len(pdf), 1))
    return _scaled(m)


def _scaled(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    # Zero vectors stay zero and so are similar to nothing.
    return m / np.where(norms < V.TINY, 1.0, norms)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _far_apart(unit: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` rows, each the one farthest from those before it."""
    chosen = [0] if len(unit) else []
    closest = unit @ unit[0] if len(unit) else np.empty(0)
    while len(chosen) < min(wanted, len(unit)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    return unit[chosen]


def reach_of(threshold: float) -> float:
    """The angle within which vectors can be similar; thresholds are tested after rounding to four decimals."""
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed to leave pairs out")
    return float(np.arccos(min(1.0, threshold - 1e-4))) + SLACK


def far_pivots(real: DataFrame, wanted: int) -> np.ndarray:
    """Up to ``wanted`` and :data:`PIVOTS` unit vectors, far apart, from the rows that come first by hash."""
    wanted = min(PIVOTS, wanted)
    return _far_apart(_unit(real.select("vec").orderBy(F.xxhash64("vid")).limit(4 * wanted).toPandas()), wanted)


def _shape(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``block``, the number of the nearest pivot, and ``angle``, how far away it is."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                angle = _angles(_unit(pdf), pivots)
                yield pdf.assign(block=angle.argmin(axis=1).astype("int32"), angle=angle.min(axis=1))

    return rows.mapInPandas(near, f"{_shape(rows)}, block int, angle double")


def visit(rows: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float) -> DataFrame:
    """Add ``visited``, the blocks that can hold a vector within ``reach``; ``radius`` is that of each block, -inf if it is empty."""
    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = _angles(_unit(pdf), pivots) <= radius + reach + SLACK
                yield pdf.assign(visited=[np.flatnonzero(row).astype("int32") for row in near])

    return rows.mapInPandas(met, f"{_shape(rows)}, visited array<int>")


def _paired(vectors: DataFrame, threshold: float, block_rows: int, only: str | None = None) -> DataFrame:
    """Rows beside all those they can be similar to: tagged with the group in which they meet them.

    A row is ``home`` in the groups of its own block and a column (``beside``) in every group it may be similar to a member of;
    for each home row the columns of its groups hold all that can reach the threshold, each once. ``only`` names a
    boolean column: just those rows become columns. Blocks of more than ``block_rows`` rows are cut, and so are the columns beside a
    block, which are as many as visit it, at :data:`BLOCK_ROWS` or ``block_rows`` if that is more.
    Zero vectors, which are similar to nothing, drop out. The pivots are taken, far apart, from the rows that come first by hash.
    """
    reach = reach_of(threshold)
    real = vectors.filter(F.exists("vec", lambda x: x != 0))
    pivots = far_pivots(real, max(1, -(-real.count() // block_rows)))
    kept = [c for c in ("vid", "vec", "first", only) if c]
    placed = stored(place(real.select(*kept), pivots))
    # A row per pivot.
    sizes = {r["block"]: r for r in placed.groupBy("block").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([sizes[b]["radius"] if b in sizes else -np.inf for b in range(len(pivots))])
    met = stored(visit(placed.select(*kept, "block"), pivots, radius, reach))
    beside = met.filter(only) if only else met
    # A row per pivot.
    visitors = {r["at"]: r["count"] for r in beside.select(F.explode("visited").alias("at")).groupBy("at").count().collect()}

    def cut(counts: dict[int, int], most: int) -> tuple[Column, Column]:
        parts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(b, 0) // most))) for b in range(max(1, len(pivots)))]), F.col("at") + 1)
        return F.pmod(F.xxhash64("vid"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)

    row, rows = cut({b: r["n"] for b, r in sizes.items()}, block_rows)
    column, columns = cut(visitors, max(block_rows, BLOCK_ROWS))
    homes = met.withColumn("at", F.col("block")).select(
        *kept, "at", F.lit(True).alias("home"), row.alias("row_part"), F.explode(columns).alias("column_part"))
    asked = beside.select(*kept, F.explode("visited").alias("at")).select(
        *kept, "at", F.lit(False).alias("home"), column.alias("column_part"), F.explode(rows).alias("row_part"))
    return homes.unionByName(asked)


_GROUP = ("at", "row_part", "column_part")


def _products(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(a), SLICE_ROWS):
        yield at, np.clip(a[at : at + SLICE_ROWS] @ b.T, -1.0, 1.0)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    scale = 10.0**digits
    return np.floor(np.abs(x) * scale + 0.5) * np.sign(x) / scale


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it; a single slash after the scheme is a local path."""
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _rows_of(column: pa.Array) -> np.ndarray:
    """Values of an array, with None for its nulls."""
    return column.to_numpy(zero_copy_only=False) if not column.null_count else np.array([*column.to_pylist(), None], dtype=object)[:-1]


def _differ(a: np.ndarray, b: np.ndarray, text: bool) -> np.ndarray:
    """Which ids differ. Numbers that are null differ from all, texts that are null do not differ from each other."""
    out = np.asarray(a != b, dtype=bool)
    return out if text or a.dtype != object else out | np.array([x is None for x in a], dtype=bool)


#: A first position that is null comes last.
_LAST = np.iinfo(np.int64).max


class _Piece:
    """Vectors of one block, as :func:`_packed` writes them in one row."""

    def __init__(self, row: pa.RecordBatch, at: int, dtype):
        self.block, data = row.column("block")[at].as_py(), row.column("data")[at].as_py()
        self.ids, self.met = _rows_of(row.column("ids")[at].values), row.column("met")[at].values.to_numpy(zero_copy_only=False)
        self.firsts = row.column("firsts")[at].values.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.shown = row.column("shown")[at].values.to_numpy(zero_copy_only=False)
        self.unit = _scaled(np.frombuffer(data, dtype).reshape(len(self.ids), -1).astype(np.float64))


def _packed(real: DataFrame, pivots: np.ndarray, radius: np.ndarray, sizes: dict[int, int], reach: float, most: int, only: str | None) -> DataFrame:
    """Blocks in pieces of some ``most`` vectors, a row each; ``met`` are the blocks to which one of its vectors may have a neighbour."""
    parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(b, 0) // most))) for b in range(max(1, len(pivots)))]), F.col("block") + 1)
    single = real.schema["vec"].dataType.elementType.simpleString() == "float"

    def pack(rows: pa.Table) -> pa.Table:
        vec = rows.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        if len(set(pc.list_value_length(vec).to_pylist())) > 1:
            raise ValueError("vectors differ in length")
        flat = vec.flatten().cast(pa.float32() if single else pa.float64())
        m = (flat.fill_null(np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        shown = rows.column(only).fill_null(False).to_numpy() if only else np.ones(rows.num_rows, bool)
        near = _angles(_scaled(m[shown].astype(np.float64)), pivots) <= radius + reach + SLACK
        ids, firsts = (pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in ("vid", "first"))
        return pa.table({
            "block": rows.column("block").slice(0, 1), "met": pa.array([np.flatnonzero(near.any(axis=0)).tolist()], pa.list_(pa.int32())), "ids": ids,
            "firsts": firsts.cast(pa.list_(pa.int64())), "shown": pa.array([shown.tolist()], pa.list_(pa.bool_())), "data": pa.array([m.tobytes()], pa.binary())})

    vid = real.schema["vid"].dataType.simpleString()
    kept = place(real, pivots).drop("angle").withColumn("part", F.pmod(F.xxhash64("vid"), parts).cast("int"))
    return kept.groupBy("block", "part").applyInArrow(pack, f"block int, met array<int>, ids array<{vid}>, firsts array<bigint>, shown array<boolean>, data binary")


def _best(k: int, *found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of (row, similarity, first, id) the k best of each row: the most similar, of equal ones those that come first."""
    row, similarity, first, ids = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, -similarity, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    order = order[rank < k]
    return row[rank < k], similarity[order], first[order], ids[order]


def nearest(
    vectors: DataFrame, k: int, threshold: float, block_rows: int = BLOCK_ROWS, with_self: bool = False, only: str | None = None,
) -> DataFrame:
    """Per vector (vid, vec, first) its k most similar ones: (vid, other, other_first, similarity).

    Cosines are rounded to four decimals before the threshold; equal ones are ordered by ``first``. With ``only``, a
    boolean column, just the rows where it is true count as neighbours.

    Every vector is compared with all those of :func:`_paired`, but no copies of vectors are written or shuffled: blocks are written once, and a
    task reads them piece by piece from the shared folder, through Arrow's file systems, beside the blocks it has in hand, and keeps k
    neighbours a row. What is read follows the number of tasks, what is compared the square of vectors that lie in no blocks.
    """
    spark, reach = vectors.sparkSession, reach_of(threshold)
    real = vectors.filter(F.exists("vec", lambda x: x != 0)).select(*[c for c in ("vid", "vec", "first", only) if c])
    n = real.count()
    pivots = far_pivots(real, max(1, -(-n // block_rows)))
    # A row per pivot.
    found = {r["block"]: r for r in place(real.select("vid", "vec"), pivots).groupBy("block").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([found[b]["radius"] if b in found else -np.inf for b in range(len(pivots))])
    pieces = stored(_packed(real, pivots, radius, {b: r["n"] for b, r in found.items()}, reach, max(block_rows, BLOCK_ROWS), only))
    files = sorted(pieces.inputFiles())
    tasks = max(1, min(n // 64, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_IN_HAND))))
    dtype = np.float32 if real.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
    id_type = real.schema["vid"].dataType
    arrow_id, vid, text = to_arrow_type(id_type), id_type.simpleString(), isinstance(id_type, StringType)

    def rows() -> Iterator[tuple[pa.RecordBatch, int]]:
        for path in files:
            system, name = opened(path)
            with system.open_input_file(name) as f:
                for batch in pq.ParquetFile(f, pre_buffer=False).iter_batches(batch_size=4):
                    yield from ((batch, at) for at in range(batch.num_rows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {x for batch in batches for x in batch.column(0).to_pylist()}
        own = [_Piece(row, at, dtype) for number, (row, at) in enumerate(rows()) if number % tasks in numbers]
        blocks = sorted({p.block for p in own})
        empty = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, object))
        kept, bound = [empty for _ in own], [np.full(len(p.ids), threshold - 1e-4) for p in own]
        for row, at in rows() if own else ():
            if not np.isin(blocks, row.column("met")[at].values.to_numpy(zero_copy_only=False)).any():
                continue
            b = _Piece(row, at, dtype)
            # As in visit(), for the blocks in hand.
            near = (_angles(b.unit, pivots[blocks]) <= radius[blocks] + reach + SLACK) & b.shown[:, None]
            for number, a in enumerate(own):
                columns = np.flatnonzero(near[:, blocks.index(a.block)])
                if not len(columns):
                    continue
                new = []
                for start, product in _products(a.unit, b.unit[columns]):
                    i, j = np.nonzero(product >= bound[number][start : start + len(product), None])
                    similarity = _half_up(product[i, j], 4)
                    i, j = i + start, columns[j]
                    ok = similarity >= threshold
                    if not with_self:
                        ok &= _differ(a.ids[i], b.ids[j], text)
                    new.append((i[ok], similarity[ok], b.firsts[j[ok]], b.ids[j[ok]].astype(object)))
                if any(len(x[0]) for x in new):
                    kept[number] = _best(k, kept[number], *new)
                    i, similarity = kept[number][:2]
                    full = np.flatnonzero(np.bincount(i, minlength=len(a.ids)) == k)
                    # Of k neighbours in order the last is the least; one that is as similar may still come before it.
                    bound[number][full] = similarity[np.searchsorted(i, full, "right") - 1] - 1e-4
        for a, (i, similarity, first, other) in zip(own, kept):
            for part in range(0, len(i), 10_000):
                cut = slice(part, part + 10_000)
                firsts = pa.array(first[cut], mask=first[cut] == _LAST)
                ids = [pa.array(x.astype(object).tolist(), arrow_id) for x in (a.ids[i[cut]], other[cut])]
                yield pa.RecordBatch.from_arrays([*ids, firsts, pa.array(similarity[cut])], names=["vid", "other", "other_first", "similarity"])

    best = spark.range(0, tasks, 1, tasks).mapInArrow(search, f"vid {vid}, other {vid}, other_first bigint, similarity double")
    order = Win.partitionBy("vid").orderBy(F.desc("similarity"), "other_first")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_reports(
    reports: DataFrame, k: int = 5, threshold: float = 0.5, text: str = "report_text", key: str = "report_id",
    order: str = "pos", embedding: Column | None = None, block_rows: int = BLOCK_ROWS, salts: int = 16,
) -> DataFrame:
    """Per report its k most similar other reports: (report_id, similar_id, similarity, rank).

    Works on distinct texts. The k+1 best reports of a text are among the first k+1 reports of its k+1
    best texts; leaving out the report itself costs at most one of them. So copies cost nothing extra.
    """
    texts = stored(embedded(distinct_texts(reports, text, key, order), embedding))
    best = nearest(texts.select("vid", "vec", "first"), k + 1, threshold, block_rows, with_self=True)
    slim = reports.select(
        F.col(key).alias("id"), F.col(order).alias("at"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("vid")
    )
    # The rank filter is applied in every task before the shuffle.
    first = (
        slim.withColumn("n", F.row_number().over(Win.partitionBy("vid").orderBy("at")))
        .filter(F.col("n") <= k + 1)
        .select(F.col("vid").alias("other"), F.col("id").alias("similar_id"), F.col("at").alias("similar_at"))
    )
    per_text = Win.partitionBy("vid").orderBy(F.desc("similarity"), "similar_at")
    # At most k + 1 entries per text.
    offers = (
        best.join(first, "other")
        .withColumn("n", F.row_number().over(per_text))
        .filter(F.col("n") <= k + 1)
        .groupBy("vid")
        .agg(F.sort_array(F.collect_list(F.struct("n", "similarity", "similar_id"))).alias("offers"))
    )
    # Salted, because one text may stand behind a large part of the reports.
    salted = offers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = slim.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    others = F.slice(F.filter("offers", lambda o: o["similar_id"] != F.col("id")), 1, k)
    return (
        asked.join(salted, ["vid", "salt"])
        .select(F.col("id").alias(key), F.posexplode(others).alias("i", "o"))
        .select(key, F.col("o.similar_id").alias("similar_id"), F.col("o.similarity").alias("similarity"),
                (F.col("i") + 1).alias("rank"))
    )


def mean_similarity(neighbours: DataFrame, key: str = "report_id") -> DataFrame:
    """Mean similarity of each report's neighbour list."""
    return neighbours.groupBy(key).agg(F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.count("*").alias("neighbours"))


def recurrence(
    reports: DataFrame, high_risk: DataFrame, text: str = "report_text", key: str = "report_id", order: str = "pos",
    embedding: Column | None = None, least: float = 0.35, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Recurrence signal of each report against all high-risk reports, its own id left out.

    ``high_risk`` names them by ``key`` and has their text. Below ``least`` the signal is 0 and so is the similarity shown. Works on
    distinct texts: the best other high-risk text, and the text itself if another high-risk report has it.
    """
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("vid")
    high = stored(high_risk.select(digest, F.col(key).alias("high_id")))
    known = high.groupBy("vid").agg(F.count("*").alias("known"), F.min("high_id").alias("one"))
    texts = embedded(distinct_texts(reports, text, key, order), embedding).join(known, "vid", "left")
    # A zero vector is not even similar to its own copies.
    flagged = stored(texts.select("vid", "vec", "first", "known", "one", F.col("known").isNotNull().alias("high"), F.exists("vec", lambda x: x != 0).alias("real")))
    best = nearest(flagged.select("vid", "vec", "first", "high"), 1, least, block_rows, only="high")
    signals = stored(flagged.filter("real").join(best.select("vid", "similarity"), "vid", "left").filter("similarity is not null or known is not null").select(
        "vid", F.coalesce("similarity", F.lit(0.0)).alias("elsewhere"), F.coalesce("known", F.lit(0)).alias("known"), "one"))
    asked = reports.withColumn("vid", digest)
    # Another report with this text is high-risk: there are two, or the only one is another report.
    again = (F.col("known") > 1) | ((F.col("known") == 1) & (F.col("one") != F.col(key)))
    similarity = F.when(again, F.lit(1.0)).otherwise(F.coalesce("elsewhere", F.lit(0.0)))
    joined = asked.join(signals, "vid", "left").withColumn("max_similarity", similarity)
    return joined.withColumn("recurrence_signal", rescale(F.col("max_similarity"))).drop("vid", "elsewhere", "known", "one")


def rescale(similarity: Column) -> Column:
    """1 from .70 up, 0 below .35, linear (three decimals) in between."""
    return (
        F.when(similarity >= 0.70, 1.0)
        .when(similarity >= 0.35, F.round((similarity - 0.35) / 0.35, 3))
        .otherwise(0.0)
    )


def _forests(paired: DataFrame, threshold: float) -> DataFrame:
    """A spanning forest of the similar pairs of each group: fewer edges than rows, however many pairs there are."""

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["home"]], pdf[~pdf["home"]]
        # A row may stand on both sides: it is one vertex.
        ids, vertex = np.unique(np.concatenate([a["vid"].to_numpy(), b["vid"].to_numpy()]), return_inverse=True)
        row_vertex, column_vertex = vertex[: len(a)], vertex[len(a) :]
        group = np.arange(len(ids))
        kept = []
        if not a.empty and not b.empty:
            for at, product in _products(_unit(a), _unit(b)):
                for i, row in enumerate(product):
                    near = column_vertex[row >= threshold]
                    own = group[row_vertex[at + i]]
                    # One neighbour per group not yet joined; every such edge merges two groups.
                    groups, first = np.unique(group[near], return_index=True)
                    other = groups != own
                    if other.any():
                        kept += [(ids[row_vertex[at + i]], ids[j]) for j in near[first[other]]]
                        joined = np.append(groups[other], own)
                        group[np.isin(group, joined)] = joined.min()
        return pd.DataFrame(kept, columns=["src", "dst"])

    vid = paired.schema["vid"].dataType.simpleString()
    return paired.groupBy(*_GROUP).applyInPandas(forest, f"src {vid}, dst {vid}")


def edges(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges that connect exactly what the pairs with cosine >= threshold connect.

    Each group returns a spanning forest of its own similar pairs. The union of the forests has the same components as all pairs together.
    """
    return _forests(_paired(vectors, threshold, block_rows), threshold)


def edges_between(met: DataFrame, known: DataFrame, sizes: dict[int, int], threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges from new vectors to the groups of known ones that have a vector with cosine >= threshold.

    ``met`` has vid, vec and the blocks ``visited``; ``known`` has vid, vec, ``block`` and ``grp``, with ``sizes`` rows a block. What an edge
    ends in is the group, so a task returns one edge from a vector to a group at most. Large blocks are cut on both sides.
    """
    asking = stored(met.select("vid", "vec", F.explode("visited").alias("at")))
    # A row per block.
    asked = {r["at"]: r["count"] for r in asking.groupBy("at").count().collect()}

    def cut(counts: dict[int, int], side: str) -> tuple[Column, Column]:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, n in counts.items() for x in (b, -(-n // block_rows))]), F.col("at")), F.lit(1)) if counts else F.lit(1)
        return F.pmod(F.xxhash64("vid"), parts).cast("int").alias(side), F.sequence(F.lit(0), parts - 1)

    row, rows = cut(asked, "row_part")
    column, columns = cut({b: n for b, n in sizes.items() if b in asked}, "column_part")
    homes = asking.select("vid", "vec", "at", F.lit(True).alias("home"), row, F.explode(columns).alias("column_part"))
    beside = known.filter(F.col("block").isin(list(asked))).withColumn("at", F.col("block")).select(
        F.col("grp").alias("vid"), "vec", "at", F.lit(False).alias("home"), F.explode(rows).alias("row_part"), column)
    return _forests(homes.unionByName(beside), threshold)
