"""Licence notices in report texts: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from riskloom.llm.batches import light, parts
from riskloom.llm.signatures import CONFIDENCE, WORD, Rule, rules

#: Phrases that always count, wherever their words stand one after the other, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What a place of a base phrase counts for in the score.
BASE_CONFIDENCE = 0.5

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


@functools.lru_cache(maxsize=1)
def _prepared() -> tuple[ahocorasick.Automaton, list[tuple[Rule, re.Pattern[bytes]]]]:
    """The keyword automaton, whose values are numbers of rules; built once in a Python worker."""
    known = [(rule, rule.compiled()) for rule in rules()]
    # Keywords are looked up in a text whose separators are single blanks.
    by_keyword: dict[str, list[int]] = {}
    for k, (rule, _) in enumerate(known):
        for keyword in rule.keyword.split("|"):
            by_keyword.setdefault(_spaced(keyword), []).append(k)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        automaton.add_word(keyword, tuple(numbers))
    automaton.make_automaton()
    return automaton, known


def _spaced(text: str) -> str:
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text).strip() or text


@functools.lru_cache(maxsize=8)
def _phrases(base: tuple[tuple[str, str], ...]) -> list[tuple[bytes, re.Pattern[bytes], str]]:
    """First word, pattern and label of each base phrase; the look-ahead also finds places that overlap."""
    out = []
    for phrase, label in base:
        words = [re.escape(w.encode()) for w in phrase.split(" ")]
        out.append((words[0], re.compile(
            rb"(?<![" + WORD + rb"])(?=(" + (rb"[^" + WORD + rb"]+").join(words) + rb")(?![" + WORD + rb"]))"), label))
    return out


def outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, number) of the (priority, start, end, number) that do not lie within another that goes before.

    Smaller priorities go first, then what is longer, then the smaller number. What lies within a suppressed
    detection lies within the one that suppressed it, so a sweep by place for each priority is enough.
    """
    kept: list[tuple[int, int, int]] = []
    for _, level in itertools.groupby(sorted(found), key=lambda d: d[0]):
        places = [(a, -b, 0, n) for a, b, n in kept] + [(a, -b, 1, n) for _, a, b, n in level]
        reach = -1
        for start, minus_end, new, number in sorted(places):
            if new and -minus_end > reach:
                kept.append((start, -minus_end, number))
            reach = max(reach, -minus_end)
    return kept


def detect(text: str | None, base: Mapping[str, str] = BASE) -> tuple[int, list[dict]]:
    """Number of words of a text and its detections, in order of their place."""
    raw = (text or "").encode("utf-8", "replace").lower()
    kinds = _IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
    opens = np.flatnonzero(kinds & ~np.r_[False, kinds[:-1]])
    automaton, known = _prepared()
    plain = b" ".join(raw.translate(_BLANKS).split()).decode("utf-8", "replace")
    fired = {number for _, numbers in automaton.iter(plain) for number in numbers}
    found = []
    for number in sorted(fired):
        rule, pattern = known[number]
        found += [(rule.priority, m.start(), m.end(), number) for m in pattern.finditer(raw) if m.end() > m.start()]
    detections = [
        (start, end, known[number][0].label, known[number][0].name, CONFIDENCE[known[number][0].priority], False)
        for start, end, number in outermost(found)
    ]
    for first, pattern, label in _phrases(tuple(base.items())):
        if first in raw:
            detections += [(m.start(1), m.end(1), label, f"base-{label}", BASE_CONFIDENCE, True) for m in pattern.finditer(raw)]
    places = np.searchsorted(opens, [d[0] for d in detections], side="right") - 1 if detections else []
    out = [
        {"label": label, "rule": rule, "start": start, "end": end, "word": max(int(word), 0), "confidence": confidence, "base": is_base}
        for (start, end, label, rule, confidence, is_base), word in zip(detections, places)
    ]
    return len(opens), sorted(out, key=lambda d: (d["start"], d["end"], d["rule"]))


_BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_DETECTION = StructType([
    StructField("label", StringType()), StructField("rule", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("word", IntegerType()), StructField("confidence", DoubleType()), StructField("base", BooleanType()),
])


def _scanner(base: dict[str, str]):
    kind = pa.list_(pa.struct([
        ("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()),
        ("confidence", pa.float64()), ("base", pa.bool_()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            results = [detect(text, base) for text in batch.column("report_text").to_pylist()]
            missed = [1.0] * len(results)
            for k, (_, found) in enumerate(results):
                for d in found:
                    missed[k] *= 1.0 - d["confidence"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("report_id"), pa.array([n for n, _ in results], pa.int64()), pa.array([found for _, found in results], kind),
                    pa.array([1.0 - m for m in missed], pa.float64()),
                ],
                names=["report_id", "n_words", "detections", "score"],
            )

    return run


def scan_licences(reports: DataFrame, base: Mapping[str, str] = BASE) -> DataFrame:
    """Licence notices of every report, in one pass without a shuffle.

    A keyword automaton picks the rules (see ``signatures``) that may match the ``report_text``; only those run,
    over the whole text with A to Z lower-cased. Detections are taken by priority, then length, then place;
    one that lies within another taken before is suppressed. Places of the ``base`` phrases, whose words must
    follow each other, are found beside that and always stay.

    Returns report_id, n_words, detections (label, rule, start and end in bytes of the UTF-8 text, word: number
    of the word where it starts, confidence, base) in order of place, and score: the probability that one detection
    at least is right, were they independent. A null text counts as empty and has score 0. Rows are judged one
    by one, whatever their id; other columns are not looked at. An empty table gives an empty result.
    """
    light(reports.sparkSession)
    shape = StructType([
        reports.schema["report_id"], StructField("n_words", LongType()), StructField("detections", ArrayType(_DETECTION)),
        StructField("score", DoubleType()),
    ])
    return reports.select("report_id", "report_text").mapInArrow(_scanner(dict(base)), shape)
