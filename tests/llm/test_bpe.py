import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.llm import bpe as B
from tests.llm.helpers import AWKWARD, reports

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small():
    """Leaves of a few characters, so that every text is a deep tree."""
    return B.Coder(B.coder(RANKS).ranks, leaf=3, window=1)


def test_pattern():
    assert B.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("kind", [r"\p{L}", r"\p{N}", r"\s"])
def test_both_libraries_know_the_same_characters(kind):
    """The sure ends of matches are found with one library, matches with the other."""
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = tiktoken.Encoding("single", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found = set(bytes(single.encode_ordinary(chars)).decode())
    sure = {c for c in chars if not B.cuts()[1].match(c)}
    assert len(sure) > 60_000 and found & sure == set(B.regex.findall(kind, chars)) & sure


def test_every_token_is_its_own_encoding(small):
    """What joining inside a match rests on: by merges alone, without a look at the whole."""
    def merged(data):
        pieces = [bytes([b]) for b in data]
        while True:
            best = min(((small.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return pieces
            pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]

    assert all(merged(t) == [t] for t in list(small.ranks)[::17])


_WORDS = st.lists(st.sampled_from(["the", "valve", "ing", "'", "'s", "'ll", "'v", "e", " ", "  ", "\n", "\t", " ", "　", "12", "3", "!", "--", "Ärger", "火", "字", "😀", "é", "aaaa", "\x00", "<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(_WORDS | st.text(max_size=60))
def test_trees_equal_the_library(plain, small, text):
    assert small.encode(text).tolist() == plain.encode_ordinary(text)
    assert small.decode(small.encode(text)) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "0", "!?", " ", "\n ", "火", "thethethe", "'s'll", "= = ", "  x", "aaaaaaab", " don't"])
def test_long_matches(plain, unit):
    coder = B.Coder(B.coder(RANKS).ranks, leaf=64)
    for n in (500, 1777):
        text = "Start " + unit * n + " the end"
        assert coder.encode(text).tolist() == plain.encode_ordinary(text)


def test_random_letters_in_one_match(plain):
    draw = np.random.default_rng(5)
    for _ in range(30):
        text = "".join(draw.choice(list("etaoinshr"), 700))
        assert B.Coder(B.coder(RANKS).ranks, leaf=16, window=1).encode(text).tolist() == plain.encode_ordinary(text)


def test_reports(spark, plain):
    rows = AWKWARD + [(30 + k, "gas test " * k + "'" * k + "x" * (700 * k), "site") for k in range(9)]
    encoded = B.encode_reports(reports(spark, rows), RANKS, leaf=256)
    got = sorted((str(r.report_id), r.n_tokens, np.frombuffer(r.token_bytes, "<u4").tolist()) for r in encoded.collect())
    assert got == sorted((str(r[0]), len(i := plain.encode_ordinary(r[1] or "")), i) for r in rows)
    back = B.decode_reports(encoded, RANKS).select("report_id", F.col("text_bytes").cast("string").alias("t"))
    assert sorted((str(r.report_id), r.t) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_bytes_that_are_no_text_and_empty_tables(spark, plain):
    odd = spark.sql("select 'a' as report_id, cast(x'48ff69' as string) as report_text union all select null, null")
    got = {r.report_id: np.frombuffer(r.token_bytes, "<u4").tolist() for r in B.encode_reports(odd, RANKS).collect()}
    assert got == {"a": plain.encode_ordinary("H�i"), None: []}
    empty = B.encode_reports(odd.limit(0), RANKS)
    assert empty.count() == 0 and B.decode_reports(empty, RANKS).columns == ["report_id", "text_bytes"] and B.decode_reports(empty, RANKS).count() == 0
