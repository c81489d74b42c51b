"""Phrases of report texts that occur more often than their parts suggest, found by Rabin-Karp fingerprints."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.lineage import stored
from riskloom.llm.batches import light, own

#: Words of a phrase at most, occurrences of a candidate at least, and phrases reported of each kind of report.
WORDS, LEAST, FIRST = 3, 10, 2000
#: A longer candidate with at least this per cent of a phrase's occurrences takes its place.
ABSORBED = 50
#: Kind of reports that have none.
UNKNOWN = "und"
#: Bases of the two prefix polynomials, modulo 2**64 and modulo a prime: an odd number, and any. A width in bits that addresses are cut to.
ODD_BASE, BASE, PRIME, WIDTH = 0xD1342543DE82EF95, 911382323, 2147483647, 64
#: Bytes of text that are numbers at a time.
SLICE = 900_000
#: Bits of the table that tells which shorter phrases may be frequent: 4 MB whatever the data. A full table only prunes less.
TABLE = 25
#: Steps of the score for each doubling, by which candidates are counted before they are ranked.
STEPS = 16
#: A pointer is 33 bits of a report's digest and the number of a word in it.
PLACE = 30

# What ends a piece of a text, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2

_COUNTED = "report_type string, address long, mark long, number long, pointer long"
_FOUND = "report_type string, phrase string, words int, a long, parts array<struct<first:int,words:int,address:long,mark:long>>"


class Words:
    """The words of a column of texts: where they stand, which follow each other within a piece, and their bytes with single blanks between."""

    def __init__(self, texts: pa.Array):
        texts = own(texts.fill_null("").cast(pa.large_string()))
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        low = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[low]
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = kind == 0
        # A word ends where a text does, also when the next one starts with a letter.
        starts = inside[1:-1] & ~inside[:-2]
        edge = offsets[(offsets > 0) & (offsets < len(low))]
        starts[edge] = inside[edge + 1]
        stops = inside[1:-1] & ~inside[2:]
        stops[edge - 1] = inside[edge]
        self.start, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.length = stop - self.start
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        ends = np.cumsum(kind == 2, dtype=np.int32 if len(low) < 1 << 31 else np.int64)[self.start]
        #: Whether the next word follows within the same piece.
        self.linked = (np.diff(ends) == 0) & (np.diff(self.row) == 0)
        first = np.searchsorted(self.row, np.arange(len(texts)))
        #: The number of each word in its text, and of each text's first word.
        self.at, self.first = np.arange(len(self.row)) - first[self.row], first
        self.count = np.bincount(self.row, minlength=len(texts))
        self._low = low

    def slices(self, words: int, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of words with about ``size`` bytes: first and last start of a phrase, bytes with single blanks, and each word's place in them.

        A run holds ``words`` - 1 further words, so that phrases over its end are whole.
        """
        ends = np.cumsum(self.length + 1)
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size)))
            span = slice(at, min(to + words - 1, len(ends)))
            length = self.length[span]
            place = np.cumsum(length + 1) - length - 1
            line = np.full(int(place[-1] + length[-1] + 1), 32, np.uint8)
            taken = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            line[np.repeat(place, length) + taken] = self._low[np.repeat(self.start[span], length) + taken]
            yield at, min(to, len(ends)), line, place
            at = to


@functools.lru_cache(maxsize=8)
def _powers(base: int, prime: int, size: int) -> np.ndarray:
    """The powers of ``base`` from 0 to ``size`` - 1, doubled up; modulo 2**64 where ``prime`` is 0."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        step = np.uint64(pow(base, len(out), prime or 1 << 64))
        out = np.concatenate([out, out * step % np.uint64(prime) if prime else out * step])
    return out[:size]


def _mixed(h: np.ndarray) -> np.ndarray:
    """The same number for the same number, with all bits spread over all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


class Prints:
    """Prefix polynomials of a run of bytes; any span's fingerprints follow from two of their values."""

    def __init__(self, line: np.ndarray, width: int = WIDTH):
        # Tables have a power of two of entries, so that few are made.
        self.room, self.width = 1 << max(int(len(line)).bit_length(), 12), width
        wide, none = line.astype(np.uint64), np.zeros(1, np.uint64)
        self.wrapped = np.concatenate([none, np.cumsum(wide * _powers(ODD_BASE, 0, self.room)[: len(line)])])
        # A byte times a power has 39 bits, so that 2**24 of them add up below 2**63; longer runs are reduced on the way.
        terms = wide * _powers(BASE, PRIME, self.room)[: len(line)]
        self.modular = np.concatenate([none, np.cumsum(terms if len(line) <= 1 << 24 else terms % np.uint64(PRIME))])

    def address(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The address of the bytes from ``start`` to ``end``, under the salt of the kind of report."""
        back = _powers(pow(ODD_BASE, -1, 1 << 64), 0, self.room)
        found = _mixed((self.wrapped[end] - self.wrapped[start]) * back[start] + salt)
        return found if self.width == 64 else found & ((1 << self.width) - 1)

    def mark(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """A check that is independent of the address. Its length tells spans apart that differ by zero bytes at the end only."""
        back, p = _powers(pow(BASE, -1, PRIME), PRIME, self.room), np.uint64(PRIME)
        h = ((self.modular[end] - self.modular[start]) % p * back[start] + (salt >> np.uint64(8))) % p
        return ((h << np.uint64(20)) ^ (end - start).astype(np.uint64)).astype(np.int64)


def _salts(kinds: pa.Array) -> np.ndarray:
    """A number for each kind of report: a fingerprint of its bytes."""
    coded = kinds.dictionary_encode()
    prints = [int.from_bytes(hashlib.blake2b(k.encode(), digest_size=7).digest(), "little") for k in coded.dictionary.to_pylist()]
    return np.array(prints, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(kinds) else np.empty(0, np.uint64)


def _places(address):
    """The bit of the table of frequent shorter phrases that belongs to an address: of a column or of an array."""
    return address.bitwiseAND((1 << TABLE) - 1) if isinstance(address, Column) else address & ((1 << TABLE) - 1)


def _counts(n: int, table: bytes | None, width: int):
    """Counts of the phrases of ``n`` words in each slice whose two parts of ``n`` - 1 words may both be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table, np.uint8)

        def maybe(address: np.ndarray) -> np.ndarray:
            place = _places(address)
            return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        for batch in _pieces(batches):
            words = Words(batch.column("report_text"))
            salts, kinds = _salts(batch.column("report_type")), batch.column("report_type")
            base = batch.column("doc").to_numpy() << PLACE
            if n == 1:
                # How many words each kind of report has: rows without an address.
                totals = pa.table({"k": kinds, "n": words.count}).group_by("k").aggregate([("n", "sum")])
                none = np.full(len(totals), -1)
                yield _counted(totals["k"].combine_chunks(), none, none, totals["n_sum"].to_numpy(), none)
            for low, high, line, place in words.slices(n):
                size = min(high - low, len(place) - n + 1)
                start = np.arange(max(size, 0))
                whole = np.ones(len(start), bool)
                for k in range(n - 1):
                    whole &= words.linked[low + k : low + k + len(start)]
                start = start[whole]
                if not len(start):
                    continue
                prints, end = Prints(line, width), place + words.length[low : low + len(place)]
                if n > 1:
                    # A part that goes over the end of a piece is in no phrase; its bit is not looked at.
                    parts_ = np.arange(len(place) - n + 2)
                    likely = maybe(prints.address(place[parts_], end[parts_ + n - 2], salts[words.row[low + parts_]]))
                    start = start[likely[start] & likely[start + 1]]
                row = words.row[low + start]
                address = prints.address(place[start], end[start + n - 1], salts[row])
                order = np.argsort(address)
                start, address, pointer = start[order], address[order], (base[row] + words.at[low + start])[order]
                mark = prints.mark(place[start], end[start + n - 1], salts[row[order]])
                new = np.flatnonzero(np.r_[True, (np.diff(address) != 0) | (np.diff(mark) != 0)][: len(order)])
                number = np.diff(np.r_[new, len(order)])
                yield _counted(None, address[new], mark[new], number, np.minimum.reduceat(pointer, new) if len(new) else new)

    return run


def _counted(kinds: pa.Array | None, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = pa.nulls(len(columns[0]), pa.string()) if kinds is None else kinds.cast(pa.string())
    return pa.RecordBatch.from_arrays([kinds, *[pa.array(c, pa.int64()) for c in columns]], names=["report_type", "address", "mark", "number", "pointer"])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few bytes of text, a row at least."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            sizes = np.array(pc.binary_length(part.column("report_text")).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            group = np.cumsum(sizes) // (2 * SLICE)
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield part.slice(a, b - a)
    pa.default_memory_pool().release_unused()


_PART = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("address", pa.int64()), ("mark", pa.int64())])


def _phrases(width: int):
    """The texts of phrases at their pointers, once their fingerprints are found there again, with the fingerprints of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            words, kinds = Words(batch.column("report_text")), batch.column("report_type")
            salts, wanted = _salts(kinds), batch.column("wanted")
            row = np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy())
            shown = {f.name: c.to_numpy() for f, c in zip(wanted.type.value_type, wanted.flatten().flatten())}
            start = words.first[row] + shown["at"]
            whole = shown["at"] + shown["words"] <= words.count[row]
            for low, high, line, place in words.slices(int(shown["words"].max(initial=1))):
                prints, end = Prints(line, width), place + words.length[low : low + len(place)]
                for n in np.unique(shown["words"]):
                    mine = np.flatnonzero(whole & (shown["words"] == n) & (start >= low) & (start < high))
                    for k in range(n - 1):
                        mine = mine[words.linked[start[mine] + k]]
                    first, size = np.array([(i, m) for m in range(1, n + 1) for i in range(n - m + 1)]).T
                    at = start[mine, None] - low + first
                    salt = np.broadcast_to(salts[row[mine], None], at.shape)
                    address, mark = prints.address(place[at], end[at + size - 1], salt), prints.mark(place[at], end[at + size - 1], salt)
                    # Another report with the same digest may be meant.
                    met = (address[:, -1] == shown["address"][mine]) & (mark[:, -1] == shown["mark"][mine])
                    mine, at, address, mark = mine[met], at[met], address[met], mark[met]
                    parts = pa.StructArray.from_arrays(
                        [pa.array(c.ravel(), t.type) for c, t in zip((np.broadcast_to(first, at.shape), np.broadcast_to(size, at.shape), address, mark), _PART)],
                        fields=list(_PART))
                    texts = [line[x:y].tobytes() for x, y in zip(place[at[:, 0]], end[at[:, 0] + n - 1])]
                    yield pa.RecordBatch.from_arrays(
                        [kinds.take(pa.array(row[mine])), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.full(len(mine), n), pa.int32()),
                         pa.array(shown["a"][mine], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * len(first), pa.int32()), parts)],
                        names=["report_type", "phrase", "words", "a", "parts"])

    return run


def _table_of(frequent: DataFrame) -> bytes:
    """A bit for every place of a frequent phrase. The driver holds the table, whose size is fixed, not the phrases."""
    rows = frequent.select(_places(F.col("address")).alias("place")).selectExpr(
        "shiftright(place, 6) as at", "shiftleft(1L, cast(place % 64 as int)) as bit")
    words = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE - 6), np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def mine_phrases(
    reports: DataFrame, kind: str = "report_type", longest: int = WORDS, least: int = LEAST, first: int = FIRST, absorbed: int = ABSORBED,
    width: int = WIDTH,
) -> DataFrame:
    """The phrases of each kind of report whose words stand together most exclusively.

    ``reports`` has report_id, report_text and ``kind`` (here report_type; null counts as ``und``). Texts are lower-cased (A-Z) and split
    at ``.,;:!?`` and line ends into pieces, those into words at blanks and tabs. All counts are of one kind of report. A candidate has 2 to
    ``longest`` words and a = at least ``least`` occurrences within pieces, overlapping ones included. A cut after its first words has the
    score floor(1000000·a·a / (l·r)) with the occurrences l and r of both parts; the lowest score counts, ties go to the earliest cut. A
    candidate within a longer one that has ``absorbed`` per cent of its occurrences is left out.

    Result: report_type, rank, phrase, a, l, r, n (words of the kind), score; the ``first`` of each kind by score, a and phrase.

    Numpy prefix polynomials give every phrase two independent fingerprints, an address of 64 bits and a check of 31, so phrases that
    share an address are told apart. Tasks count their phrases; the shuffle adds counts up and keeps one pointer (report, word). Longer phrases
    are counted only where both parts one word shorter may be frequent, by a bit table of fixed size. Frequent phrases alone are
    read at their pointers: the fingerprints must come out again there, and the text is the phrase from then on.

    Null and empty texts have no words. Rows that repeat count each time, ids may be null or repeated. Other columns are ignored. Reports
    without words or an empty table give an empty result.
    """
    light(reports.sparkSession)
    texts = reports.select(
        F.coalesce(F.col(kind).cast("string"), F.lit(UNKNOWN)).alias("report_type"), F.make_valid_utf8("report_text").alias("report_text"),
        F.shiftrightunsigned(F.xxhash64("report_id", kind, "report_text"), 64 - 33).alias("doc"))
    table, levels = None, []
    for n in range(1, longest + 1):
        rows = texts.mapInArrow(_counts(n, table, width), _COUNTED)
        added = rows.groupBy("report_type", "address", "mark").agg(F.sum("number").alias("number"), F.min("pointer").alias("pointer"))
        levels.append(stored(added.filter((F.col("number") >= least) | F.col("report_type").isNotNull()).withColumn("words", F.lit(n))))
        if n < longest:
            table = _table_of(levels[-1].filter("report_type is null"))
    totals = levels[0].filter("report_type is not null").select("report_type", F.col("number").alias("n"))
    frequent = functools.reduce(DataFrame.unionByName, levels).filter("report_type is null").drop("report_type")
    found = stored(_materialised(texts, frequent.filter("words > 1"), width))
    return _ranked(_scored(found, frequent, totals), found, first, absorbed)


def _materialised(texts: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """Candidates with their text, read where the pointers show."""
    wanted = candidates.select(
        F.shiftrightunsigned("pointer", PLACE).alias("doc"),
        F.struct("words", "address", "mark", F.col("number").alias("a"), F.col("pointer").bitwiseAND((1 << PLACE) - 1).cast("int").alias("at")).alias("w"))
    # At most one row a phrase of the report.
    of_doc = wanted.groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    read = texts.join(of_doc, "doc").select("report_type", "report_text", "wanted").mapInArrow(_phrases(width), _FOUND)
    # Equal reports give equal rows.
    return read.groupBy("report_type", "phrase", "words").agg(F.max("a").alias("a"), F.first("parts").alias("parts"))


def _scored(found: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest score and its cut."""
    def part(first: Column, words: Column) -> Column:
        return F.filter("parts", lambda p: (p["first"] == first) & (p["words"] == words))[0]

    cuts = found.select("report_type", "phrase", "a", "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("report_type", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), part(F.lit(0), F.col("k")).alias("p")),
        F.struct(F.lit("r").alias("side"), part(F.col("k"), F.col("words") - F.col("k")).alias("p")))).alias("s"))
    sides = sides.select("report_type", "phrase", "a", "k", "s.side", "s.p.address", "s.p.mark")
    known = frequent.select("address", "mark", F.col("number").alias("f"))
    # A part may be in as many candidates as a share of its occurrences: the few that are common are sent to every task.
    most = frequent.agg(F.sum("number").alias("n")).first()["n"] or 0
    common = F.col("f") * 1000 >= most
    few = sides.join(F.broadcast(known.filter(common).withColumnRenamed("f", "c")), ["address", "mark"], "left")
    names = ("report_type", "phrase", "a", "k", "side", "f")
    rest = few.filter("c is null").drop("c").join(known.filter(~common), ["address", "mark"]).select(*names)
    counted = few.filter("c is not null").withColumnRenamed("c", "f").select(*names).unionByName(rest)
    pairs = counted.groupBy("report_type", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    # Exact: products of counts below 10**16 have 32 digits, and six more.
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    pairs = pairs.withColumns({"up": wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)"), "down": wide("l") * wide("r")})
    pairs = pairs.withColumn("score", F.expr("up div down"))
    lowest = pairs.groupBy("report_type", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("report_type", "phrase", "a", "m.l", "m.r", "m.score").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "report_type")


def _ranked(scored: DataFrame, found: DataFrame, first: int, absorbed: int) -> DataFrame:
    """The first candidates of each kind that are in no longer one of about their number."""
    inner = found.select("report_type", "phrase", "a", "words", F.explode("parts").alias("p")).filter("p.words > 1 and p.words < words")
    longer = inner.groupBy("report_type", F.col("p.address").alias("address"), F.col("p.mark").alias("mark")).agg(F.max("a").alias("longer"))
    own_print = F.filter("parts", lambda p: p["words"] == F.col("words"))[0]
    covered = found.select("report_type", "phrase", "a", own_print.alias("o")).select(
        "report_type", "phrase", "a", F.col("o.address").alias("address"), F.col("o.mark").alias("mark")
    ).join(longer, ["report_type", "address", "mark"]).filter(F.col("longer") * 100 >= F.col("a") * absorbed)
    left = stored(scored.join(covered.select("report_type", "phrase"), ["report_type", "phrase"], "left_anti"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A kind may have most candidates. Its first ones lie above a step of the score that is found from counts by step, a few hundred a kind.
    left = left.withColumn("step", F.floor(F.log2(F.col("score") + 1) * STEPS))
    steps = left.groupBy("report_type", "step").agg(F.count("*").alias("number"))
    above = F.sum("number").over(Window.partitionBy("report_type").orderBy(F.desc("step"))) - F.col("number")
    ends = steps.withColumn("above", above).filter(F.col("above") < first).groupBy("report_type").agg(F.min("step").alias("end"))
    within = left.join(ends, "report_type").filter("step >= end")
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("report_type").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("report_type", "rank", "phrase", "a", "l", "r", "n", "score")
