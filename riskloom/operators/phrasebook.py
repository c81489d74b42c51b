"""Rules and gazetteers as tables of any size: an automaton over their phrases finds all of them in one pass over each report.

The packs of :mod:`riskloom.operators.rules` and :mod:`riskloom.operators.extract` are part of the plan, which suits some hundreds of
phrases. Here a pack is data: the plan is the same for ten phrases and for a million.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from riskloom.functions.lineage import stored

#: Phrases of one automaton; a larger pack is searched share by share.
PHRASES = 500_000
#: Reports that are Python objects at a time.
ROWS = 512
#: Phrases that are sent to every task as they are; of more, those that cannot stand in any report are left out first.
FEW = 50_000
#: Bytes of the pieces by which a phrase is known: the first and the last ones of the greatest width that it has.
WIDTHS = (1, 2, 4, 8, 16, 32)
#: Bits of the table of all pieces of the reports: 8 MB whatever the data. A full table only leaves out less.
TABLE = 26

_HIT = StructType([StructField("entry", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
_automata: dict[str, tuple] = {}


def folded(text: str) -> str:
    """The text in small letters, letter by letter, so that places in it stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _automaton(name: str, shared: Broadcast):
    """Entries by phrase, and the automaton over the phrases; built once in a Python worker for each share."""
    if name not in _automata:
        import ahocorasick

        entries: dict[str, list[int]] = {}
        for entry, phrase in zip(*shared.value):
            entries.setdefault(folded(phrase), []).append(entry)
        entries.pop("", None)
        found = ahocorasick.Automaton()
        for phrase, numbers in entries.items():
            found.add_word(phrase, (len(phrase), numbers))
        found.make_automaton()
        while len(_automata) > 1:
            _automata.pop(next(iter(_automata)))
        _automata[name] = (found, bool(entries))
    return _automata[name]


def spans_of(text: str, automaton, bounded: bool) -> list[tuple[int, int, int]]:
    """(entry, start, end) of all occurrences in the order of their ends; those of one phrase do not overlap each other."""
    low, out, last = folded(text), [], {}
    word = lambda at: 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")
    for end, (size, entries) in automaton.iter(low):
        start, end = end + 1 - size, end + 1
        if start < last.get(entries[0], 0) or (bounded and (word(start - 1) or word(end))):
            continue
        last[entries[0]] = end
        out += [(entry, start, end) for entry in entries]
    return out


def _finder(shared: Broadcast, text: str, bounded: bool, name: str):
    share = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, any_phrase = _automaton(share, shared)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                flat, ends = [], [0]
                for v in batch.column(text).to_pylist():
                    if v and any_phrase:
                        flat += spans_of(v, automaton, bounded)
                    ends.append(len(flat))
                fields = zip(*flat) if flat else ((), (), ())
                spans = pa.StructArray.from_arrays(
                    [pa.array(f, t) for f, t in zip(fields, (pa.int64(), pa.int32(), pa.int32()))], names=["entry", "start", "end"])
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return run


def _bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.empty(0, np.uint8)
    return flat, places - places[0]


def _folded_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after the other in UTF-8, and where each begins and the last one ends."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    flat, places = _bytes(texts)
    if (flat > 127).any():
        return _bytes(pa.array([folded(v) for v in texts.to_pylist()], pa.large_string()))
    return flat + 32 * ((flat >= 65) & (flat <= 90)).astype(np.uint8), places


def _pieces(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each width the bits in the table of the pieces that begin at every byte; a piece is hashed from its halves."""
    with np.errstate(over="ignore"):
        code = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(32)
        for width in WIDTHS:
            if width > 1:
                half = width // 2
                code = code[: max(0, len(code) - half)] * np.uint64(0xD6E8FEB86659FD93) + code[half:]
                code ^= code >> np.uint64(29)
            yield width, ((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task's table of pieces that are not empty: (at, bits)."""
    seen = np.zeros(1 << TABLE, bool)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            flat, places = _folded_bytes(whole.column(0).slice(at, ROWS))
            left = np.repeat(places[1:], np.diff(places)) - np.arange(len(flat))
            for width, bits in _pieces(flat):
                seen[bits[left[: len(bits)] >= width]] = True
    words = np.packbits(seen, bitorder="little").view(np.int64)
    at = np.flatnonzero(words)
    for k in range(0, len(at), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 10_000]), pa.array(words[at[k : k + 10_000]])], names=["at", "bits"])


def _possible(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        held = lambda bits: (table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
        for whole in batches:
            for at in range(0, whole.num_rows, 8 * ROWS):
                batch = whole.slice(at, 8 * ROWS)
                flat, places = _folded_bytes(batch.column("phrase"))
                first, last = places[:-1], places[1:]
                size, keep = last - first, np.zeros(batch.num_rows, bool)
                for width, bits in _pieces(flat):
                    own = np.flatnonzero((size >= width) & ((size < 2 * width) | (width == WIDTHS[-1])))
                    keep[own] = held(bits[first[own]]) & held(bits[last[own] - width])
                yield batch.filter(pa.array(keep))

    return run


def possible_phrases(reports: DataFrame, phrases: DataFrame, text: str = "report_text") -> DataFrame:
    """Those of ``phrases`` (entry, phrase; no empty ones) that may stand in a report; none that does is left out.

    A phrase that stands in a text begins and ends with pieces of it. A bit table of fixed size tells which pieces the texts have, so
    phrases are not compared with texts, and what is left of them follows the hits rather than the pack. The texts are read once more.
    """
    words = reports.select(text).mapInArrow(_marked, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE - 6), np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    shared = reports.sparkSession.sparkContext.broadcast(table.tobytes())
    return phrases.mapInArrow(_possible(shared), phrases.schema)


def _shares(reports: DataFrame, phrases: DataFrame, text: str, most: int) -> list[Broadcast]:
    """Entries and phrases, at most some ``most`` of them together; those that no report can hold are left out of a large pack."""
    pack = phrases.filter(F.col("phrase").isNotNull() & (F.col("phrase") != "")).select("entry", "phrase")
    size = pack.count()
    if size > FEW and not reports.isStreaming:
        pack = stored(possible_phrases(reports, pack, text))
        size = pack.count()
    shares = max(1, -(-size // most))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    tables = (pack.filter(share == k).toArrow() for k in range(shares))
    return [reports.sparkSession.sparkContext.broadcast((t["entry"].to_pylist(), t["phrase"].to_pylist())) for t in tables]


def phrase_hits(reports: DataFrame, phrases: DataFrame, text: str = "report_text", bounded: bool = False, most: int = PHRASES) -> DataFrame:
    """Reports with ``hits``: all occurrences of the phrases in their text (entry, start, end; characters from 0), in reading order.

    ``phrases`` has entry (a number of its own for each row) and phrase. Capitals do not matter. With ``bounded`` no letter, digit or
    underscore stands next to a hit. Occurrences of different phrases may overlap. Up to ``most`` phrases go to every task at once, as a
    table of that size at most; more are searched in so many passes over the text, which stay in one stage. From more than :data:`FEW`
    phrases those that no report can hold are left out before, for which the reports are read once more. Null and empty texts and
    phrases have no hits. Rows of reports stay as they are, ids repeated or null included.
    """
    out, names = reports, []
    for k, shared in enumerate(_shares(reports, phrases, text, most)):
        names.append(f"__hits_{k}")
        shape = StructType([*out.schema.fields, StructField(names[-1], ArrayType(_HIT))])
        out = out.mapInArrow(_finder(shared, text, bounded, names[-1]), shape)
    place = lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h["entry"].alias("entry"))
    ordered = F.sort_array(F.transform(F.concat(*names), place))
    hits = F.transform(ordered, lambda h: F.struct(h["entry"].alias("entry"), h["start"].alias("start"), (-h["back"]).alias("end")))
    return out.withColumn("hits", hits).drop(*names)


def _counter(shared: Broadcast):
    share = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, any_phrase = _automaton(share, shared)
        reports, occurrences, entries_of = Counter(), Counter(), {}
        for whole in batches if any_phrase else ():
            for at in range(0, whole.num_rows, ROWS):
                for v in whole.column("report_text").slice(at, ROWS).to_pylist():
                    # As in spans_of, without the places.
                    last: dict[int, int] = {}
                    for end, (size, entries) in automaton.iter(folded(v)) if v else ():
                        first = entries[0]
                        if end + 1 - size >= last.get(first, 0):
                            if first not in last:
                                entries_of[first] = entries
                            last[first] = end + 1
                            occurrences[first] += 1
                    reports.update(last.keys())
        rows = [(entry, n, occurrences[first]) for first, n in reports.items() for entry in entries_of[first]]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in zip(*rows[k : k + 10_000])], names=["entry", "reports", "occurrences"])

    return run


def phrase_totals(reports: DataFrame, phrases: DataFrame, key: str = "report_id", text: str = "report_text", most: int = PHRASES) -> DataFrame:
    """(entry, reports, occurrences): in how many reports, told apart by ``key``, a phrase stands and how often; phrases without a hit are left out.

    A report of one row is counted where it is read, so that what is shuffled is a row per phrase and task. Only of reports whose key
    stands on several rows are the hits themselves brought together; a null key is a key like others.
    """
    slim = reports.select(F.col(key).alias("key"), F.col(text).alias("report_text"))
    again = stored(slim.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("again")))
    repeated = not again.isEmpty()
    same, tasks = F.col("key").eqNullSafe(F.col("again")), int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = slim.join(again, same, "left_anti").repartition(tasks) if repeated else slim
    counted = [once.select("report_text").mapInArrow(_counter(s), "entry long, reports long, occurrences long") for s in _shares(once, phrases, "report_text", most)]
    if repeated:
        more = phrase_hits(slim.join(again, same, "left_semi").repartition(tasks), phrases, most=most)
        entries = more.select("key", F.explode(F.transform("hits", lambda h: h["entry"])).alias("entry"))
        counted.append(entries.groupBy("key", "entry").agg(F.lit(1).cast("long").alias("reports"), F.count("*").alias("occurrences")).drop("key"))
    counts = functools.reduce(DataFrame.unionByName, counted)
    return counts.groupBy("entry").agg(F.sum("reports").alias("reports"), F.sum("occurrences").alias("occurrences"))


def rule_table(rules) -> list[tuple]:
    """Rows of a rule table (rule_pos, rule_id, severity, signals) for a pack of :class:`riskloom.packs.rules.Rule`."""
    return [(k, r.id, r.severity, list(r.signals)) for k, r in enumerate(rules)]


def match_rule_table(reports: DataFrame, rules: DataFrame, key: str = "report_id", text: str = "report_text", most: int = PHRASES) -> DataFrame:
    """(key, rule_pos, rule_id, severity, signals) for every rule with a signal in a report; signals in the order of the rule.

    ``rules`` has rule_pos (its place in the pack), rule_id, severity and signals (array). A signal is a substring of the text, as in
    :func:`riskloom.operators.rules.match_rules`. Reports are told apart by ``key``. Hits alone are shuffled.
    """
    signals = rules.select("rule_pos", F.posexplode("signals").alias("signal_pos", "signal")).filter("signal is not null")
    # A phrase that several rules list is searched once.
    known = _entries(signals.select(F.lower("signal").alias("phrase")).distinct())
    hits = phrase_hits(reports.select(key, F.col(text).alias("report_text")), known, most=most)
    found = hits.select(key, F.explode(F.array_distinct(F.transform("hits", lambda h: h["entry"]))).alias("entry"))
    pairs = found.join(known, "entry").join(signals.withColumn("phrase", F.lower("signal")), "phrase")
    # At most as many as the rule has signals.
    fired = pairs.groupBy(key, "rule_pos").agg(F.sort_array(F.collect_set(F.struct("signal_pos", "signal"))).alias("s"))
    return fired.join(rules.select("rule_pos", "rule_id", "severity"), "rule_pos").select(
        key, "rule_pos", "rule_id", "severity", F.transform("s", lambda s: s["signal"]).alias("signals"))


def _entries(phrases: DataFrame) -> DataFrame:
    """Distinct phrases with a number each; written once, so that it is the same in every use."""
    return stored(phrases.withColumn("entry", F.monotonically_increasing_id()))


def match_alias_table(reports: DataFrame, aliases: DataFrame, key: str = "report_id", text: str = "report_text", most: int = PHRASES) -> DataFrame:
    """(key, kind, canonical, category, text, start, end): of each kind the leftmost aliases of a report, the longest of those that start together.

    ``aliases`` has kind, alias_pos (its place in the kind), canonical, category and alias. An alias that several terms of a kind list
    belongs to the first. Hits stand between other characters than letters, digits and underscores.
    """
    lowered = aliases.withColumn("phrase", F.lower("alias"))
    owner = lowered.groupBy("kind", "phrase").agg(F.min_by(F.struct("canonical", "category"), "alias_pos").alias("term"))
    known = _entries(lowered.select("phrase").distinct())
    hits = phrase_hits(reports.select(key, F.col(text).alias("report_text")), known, bounded=True, most=most).filter(F.size("hits") > 0)
    each = hits.select(key, "report_text", F.explode("hits").alias("h")).select(
        key, "h.*", F.expr("substring(report_text, h.start + 1, h.end - h.start)").alias("text"))
    named = each.join(known, "entry").join(owner, "phrase")
    # The hits of one kind in one report.
    gathered = named.groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct(
        "start", (-F.col("end")).alias("back"), "end", "text", "term.canonical", "term.category"))).alias("spans"))
    return gathered.select(key, "kind", F.explode(_leftmost(F.col("spans"))).alias("s")).select(
        key, "kind", "s.canonical", "s.category", "s.text", "s.start", "s.end")


def _leftmost(spans: Column) -> Column:
    """Spans in order of start, without those that begin before the one kept last has ended."""
    last = lambda kept: F.coalesce(F.element_at(F.transform(kept, lambda k: k["end"]), -1), F.lit(0))
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda kept, s: F.when(s["start"] >= F.when(F.size(kept) > 0, last(kept)).otherwise(0), F.concat(kept, F.array(s))).otherwise(kept))
