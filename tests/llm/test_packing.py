from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm.packing import arranged, pack_reports, place
from tests.llm.helpers import AWKWARD, reports

PATH = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = [(30, "<|endoftext|> stop<|endoftext|>"), (31, "  two  blanks\r\n\ttab's I'll"), (32, "数値 12345 ٣٤"), (33, "#" * 5000), (34, "a" * 3000)]


def packed(spark, rows, **options):
    return [r.asDict() for r in pack_reports(reports(spark, rows), PATH, **options).collect()]


@pytest.mark.parametrize("options", [{}, {"group_rows": 3}, {"length": 16}])
def test_pieces_are_the_tokens_of_the_report(spark, options):
    rows, length = AWKWARD + STRANGE, options.get("length", 1024)
    coding = Tokenizer.from_file(PATH)
    wanted = sorted([[*coding.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows])
    got, texts, placed = packed(spark, rows, **options), defaultdict(list), defaultdict(list)
    for piece in got:
        assert len(piece["token_bytes"]) == 4 * piece["length"] and 0 < piece["length"] <= length
        placed[piece["sequence_id"]].append((piece["offset"], piece["length"]))
        if piece["piece"] > 0:
            assert piece["length"] == length  # the first piece alone may be shorter
    for places in placed.values():
        ends = 0
        for offset, size in sorted(places):
            assert offset == ends
            ends += size
        assert ends <= length
    # Rows that share an id have equal texts here, so their pieces are told apart by count.
    for piece in sorted(got, key=lambda p: (p["report_id"] is None, p["report_id"] or 0, p["start"])):
        texts[piece["report_id"]].append((piece["start"], np.frombuffer(piece["token_bytes"], "<u4").tolist()))
    for r in {r[0]: r for r in rows if r[0] not in (7, None)}.values():
        ids = [i for _, part in texts[r[0]] for i in part]
        assert ids == [*coding.encode(r[1] or "", add_special_tokens=False).ids, 2]
    assert sum(p["length"] for p in got) == sum(map(len, wanted))
    assert sum(p["report_id"] == 7 for p in got) % 2 == 0


def naive(sizes, capacity):
    """The rule as it is said: the sum of squares is worked out for each choice."""
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        def total(after):
            counts = defaultdict(int)
            for g in after:
                counts[g] += 0 < g < capacity
            return sum(c * c for c in counts.values())
        choices = [(total([*gaps[:k], g - s, *gaps[k + 1:]]), g, k) for k, g in enumerate(gaps) if g >= s]
        choices.append((total([*gaps, capacity - s]), capacity, len(gaps)))
        _, g, k = min(choices)
        if k == len(gaps):
            gaps.append(capacity)
        gaps[k] -= s
    return sorted(gaps)


def test_sum_of_squares_rule():
    draw = np.random.default_rng(3)
    for capacity in (10, 17):
        sizes = draw.integers(1, capacity + 1, 60)
        bins, opened = place(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)
        assert len(fill) == opened and sorted(capacity - fill) == naive(sizes.tolist(), capacity)


def test_waste_is_small_and_offsets_fit():
    for n, allowed in ((16000, 1.016), (1, 1), (2, 2), (0, 1)):
        sizes = np.random.default_rng(1).integers(1, 1025, n)
        bins, offsets = arranged(sizes, 1024)
        fill = np.bincount(bins, weights=sizes)
        assert (fill > 0).all() and (fill <= 1024).all() and (offsets + sizes <= 1024).all()
        assert len(fill) <= max(1, allowed * max(sizes.sum() / 1024, (sizes > 512).sum()))
        order = np.lexsort((offsets, bins))
        same = bins[order][1:] == bins[order][:-1]
        assert (offsets[order][1:] == np.where(same, (offsets + sizes)[order][:-1], 0)).all()


def test_empty_table(spark):
    assert packed(spark, []) == []
