"""Packing of tokenised report texts into training sequences by the sum-of-squares rule."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from riskloom.llm.batches import light, own, parts

LENGTH = 1024
END = 2
#: A packing group holds about so many reports and so many bytes of text: what one task packs.
GROUP_ROWS, GROUP_BYTES = 16_384, 48 << 20
# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary file writes for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, frozenset[str]]:
    """The vocabulary of a byte-level ``tokenizers`` file in the faster library; loaded once in a Python worker.

    The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: in such a file
    the merges are in the order of the ids, and special tokens met in a text are kept whole.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), frozenset(special)


def _tokenised(path: str, end: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, special = encoder(path)
        last = np.array([end], dtype=width).tobytes()
        for batch in parts(batches):
            out = [
                coding.encode_to_numpy(text, allowed_special=special, disallowed_special=()).astype(width).tobytes() + last
                if text else last
                for text in batch.column("report_text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("report_id"), pa.array(out, pa.binary())], names=["report_id", "ids"])

    return run


def place(sizes: np.ndarray, capacity: int, order: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """A bin for each size, and the number of bins; sizes are taken in ``order``, or from large to small.

    A size goes where the sum over all gaps of the squared number of open bins with that gap becomes
    smallest: into an open bin or a new one. Full bins count nowhere. Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; those of gap 0 are full
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, opened = np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i in (np.argsort(-sizes, kind="stable") if order is None else order).tolist():
        s = int(sizes[i])
        if s == capacity:
            bins[i], opened = opened, opened + 1
            continue
        before, after = count[s:], count[: capacity - s + 1]
        cost = np.where(before > 0, 2 * (after - before) + 2, never)
        if before[0]:
            cost[0] = 1 - 2 * before[0]  # the bin becomes full
        cost[-1] = 2 * after[-1] + 1  # a new bin
        gap = s + int(cost.argmin())
        if gap == capacity:
            target, opened = opened, opened + 1
        else:
            target = stacks[gap].pop()
            count[gap] -= 1
        bins[i] = target
        if gap > s:
            stacks[gap - s].append(target)
            count[gap - s] += 1
    return bins, opened


def arranged(sizes: np.ndarray, capacity: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """A bin and an offset for each size.

    The rule leaves gaps in the bins that were open at the end. So the sizes in bins emptier than usual are
    placed anew by the same rule, in turn mixed up and from large to small, as long as that saves bins.
    """
    bins, opened = place(sizes, capacity)
    for turn in range(rounds if opened else 0):
        gaps = capacity - np.bincount(bins, weights=sizes, minlength=opened)
        loose = gaps > gaps.mean() / 2
        again = np.flatnonzero(loose[bins])
        if not len(again):
            break
        part = sizes[again]
        anew, used = place(part, capacity, np.random.default_rng(turn).permutation(len(part)) if turn % 2 == 0 else None)
        if used < loose.sum():
            firm = opened - int(loose.sum())
            bins = (np.cumsum(~loose) - 1)[bins]
            bins[again] = firm + anew
            opened = firm + used
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0][: len(order)])
    base = np.repeat((ends - sizes[order])[first], np.diff(np.r_[first, len(order)]))
    offsets = np.empty_like(bins)
    offsets[order] = ends - sizes[order] - base
    return bins, offsets


def _packer(capacity: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, texts = [], []
        for batch in parts(batches):
            owners.append(own(batch.column("report_id")))
            texts += batch.column("ids").to_pylist()
        if not texts:
            return
        owners = pa.concat_arrays(owners)
        keys = owners.to_pylist()
        order = sorted(range(len(texts)), key=lambda k: (keys[k] is None, keys[k] if keys[k] is not None else 0, texts[k]))
        unit = np.dtype(width).itemsize
        lengths = np.array([len(texts[k]) // unit for k in order], dtype=np.int64)
        pieces = -(-lengths // capacity)
        row = np.repeat(np.arange(len(order)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        opening = lengths - (pieces - 1) * capacity  # of a cut text, the first piece is the shorter one
        size = np.where(piece == 0, opening[row], capacity)
        start = np.where(piece == 0, 0, opening[row] + (piece - 1) * capacity)
        bins, offsets = arranged(size, capacity)
        sequence = bins + (TaskContext.get().partitionId() << 40)
        index = np.array(order, dtype=np.int64)
        for at in range(0, len(row), 1000):
            part = slice(at, at + 1000)
            tokens = [
                np.frombuffer(texts[index[r]], width, count=n, offset=s * unit).astype("<u4").tobytes()
                for r, s, n in zip(row[part], start[part], size[part])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    owners.take(pa.array(index[row[part]])), pa.array(piece[part], pa.int32()), pa.array(start[part]),
                    pa.array(size[part]), pa.array(tokens, pa.binary()), pa.array(sequence[part]), pa.array(offsets[part]),
                ],
                names=["report_id", "piece", "start", "length", "token_bytes", "sequence_id", "offset"],
            )

    return run


def pack_reports(
    reports: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END,
    group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Report texts as token sequences of at most ``length``, in as few sequences as the sum-of-squares rule gives.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can open. A report is the ids of its
    ``report_text`` (null: none) and then ``end``. Only longer ones are cut, into pieces of ``length``, the first
    of which may be shorter. Reports are dealt by hash into groups of about ``group_rows`` reports and
    ``group_bytes`` of text, whichever gives more groups; a task packs its group (see ``arranged``).

    Returns a row per piece: report_id, piece (from 0), start (tokens of the report before it), length,
    token_bytes (unsigned little-endian 32-bit ids, the form that training loaders map into memory),
    sequence_id, offset (place in the sequence, gapless from 0). Rows repeated with one id are packed one by
    one. Null ids are packed like others. An empty table gives an empty result; other columns are not looked at.
    """
    light(reports.sparkSession)
    bulk = reports.agg(F.count("*").alias("n"), F.sum(F.octet_length("report_text")).alias("size")).first()
    groups = max(1, -(-bulk.n // group_rows), -(-(bulk.size or 0) // group_bytes))
    coding, _ = encoder(tokenizer)
    # Two bytes a token on the way through the shuffle where the vocabulary allows it.
    width = "<u2" if max(coding.max_token_value, end) < 1 << 16 else "<u4"
    owner = reports.schema["report_id"]
    texts = reports.select("report_id", "report_text")
    shape = StructType([owner, StructField("ids", BinaryType())])
    tokens = texts.mapInArrow(_tokenised(tokenizer, end, width), shape)
    dealt = tokens.repartition(groups, F.xxhash64("report_id", F.crc32("ids")))
    shape = StructType([
        owner, StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
        StructField("token_bytes", BinaryType()), StructField("sequence_id", LongType()), StructField("offset", LongType()),
    ])
    return dealt.mapInArrow(_packer(length, width), shape)
