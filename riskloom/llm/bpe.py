"""Byte-level BPE of report texts as a tree reduction: halves are encoded apart and joined at their border."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from riskloom.llm.batches import light, parts

# Fixed value: the pre-tokenisation pattern of the vocabularies meant here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters (of a text) and bytes (of one match of the pattern) that are encoded in one go.
LEAF = 2048
#: Tokens on each side of a border within a match that are encoded anew at first.
WINDOW = 4
#: Tokens whose bytes are put together in one go.
IDS = 4096

_MATCH = regex.compile(PATTERN)


@functools.cache
def cuts() -> tuple[regex.Pattern, regex.Pattern]:
    """Sure ends of matches, and characters that are not sure.

    The end of letters, of digits, and of other signs before white space: whatever surrounds it, a match of the pattern ends here, and no
    match looks beyond it. (Other signs before a letter may be the apostrophe of a contraction, and blanks belong to what follows.) The
    library that encodes follows another version of Unicode than the one that looks for ends; only characters of the basic plane that
    both class alike are sure.
    """
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    letters = {bytes([b]): b for b in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        found = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=letters, special_tokens={}).encode_ordinary(plane)
        odd |= set(bytes(found).decode()) ^ set(regex.findall(kind, plane))
    unsure = "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(odd)) + "\\U00010000-\\U0010ffff]"
    return regex.compile(rf"(?:\p{{L}}(?=\P{{L}})|\p{{N}}(?=\P{{N}})|[^\s\p{{L}}\p{{N}}](?=\s))(?<!{unsure})(?!{unsure})"), regex.compile(unsure)


class Coder:
    """Ids of texts, and texts of ids, by the ranks of a ``tiktoken`` file."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF, window: int = WINDOW):
        self.leaf, self.window = leaf, window
        self.ranks = ranks
        self._cut, self._unsure = cuts()
        self.coding = tiktoken.Encoding("reports", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.size = np.zeros(top, np.int64)
        self.bytes: list[bytes] = [b""] * top
        for token, i in ranks.items():
            self.size[i], self.bytes[i] = len(token), token

    # ------------------------------------------------------------------ a text

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text: of its halves, joined."""
        if len(text) <= self.leaf:
            return self.coding.encode_to_numpy(text, disallowed_special=())
        half = len(text) // 2
        return self._joined(text, half, self.encode(text[:half]), self.encode(text[half:]))

    def _joined(self, text: str, at: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a text from those of its two parts. Only what lies between two sure ends of matches around the border is encoded anew."""
        low, high = self._sure_before(text, at), self._sure_after(text, at)
        kept, gone = len(left) - self._tokens(left[::-1], text[low:at]), self._tokens(right, text[at:high])
        middle = self._window(text[low:high], at - low, left[kept:], right[:gone])
        return np.concatenate([left[:kept], middle, right[gone:]])

    def _tokens(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ids make up the text. A match ends where it does, and so does a token."""
        size, n = len(text.encode()), 64
        if not size:
            return 0
        while True:
            ends = np.cumsum(self.size[ids[:n]])
            if ends[-1] >= size:
                return int(np.searchsorted(ends, size)) + 1
            n *= 2

    def _sure_before(self, text: str, at: int) -> int:
        """The last sure end of a match before the border, found in windows that double; the start of the text at last."""
        width = 64
        while True:
            start = max(0, at - width)
            last = None
            for last in self._cut.finditer(text, start, at):
                pass
            if last is not None or not start:
                return last.end() if last is not None else 0
            width *= 2

    def _sure_after(self, text: str, at: int) -> int:
        """The first sure end of a match behind the border, or the end of the text."""
        found = self._cut.search(text, at)
        return found.end() if found else len(text)

    def _window(self, text: str, at: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the text around a border; those of its two sides serve where one match is long and goes over it."""
        if len(text) <= 2 * self.leaf or self._unsure.search(text):
            return self.coding.encode_to_numpy(text, disallowed_special=())
        before = [m.span() for m in _MATCH.finditer(text[:at])]
        behind = _MATCH.match(text, at)
        out = []
        for m in _MATCH.finditer(text):
            start, end = m.span()
            if start < at < end and before and before[-1] == (start, at) and behind.end() == end:
                head = left[len(left) - self._tokens(left[::-1], text[start:at]) :]
                out.append(self.bordered(head, right[: self._tokens(right, text[at:end])]))
            else:
                out.append(self.match(m.group().encode()))
        return np.concatenate(out)

    # ------------------------------------------------------------------ one match of the pattern

    def match(self, data: bytes) -> np.ndarray:
        """The ids of the bytes of one match: of their halves, joined."""
        if len(data) <= self.leaf:
            return self._plain(data)
        half = len(data) // 2
        return self.bordered(self.match(data[:half]), self.match(data[half:]))

    def bordered(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of two neighbouring parts of one match from the ids of each.

        A row of tokens is the encoding of its bytes if and only if every two neighbours are the encoding of theirs: the first merge over
        a border between tokens would be the first one also among the two tokens alone. So tokens around the border are encoded anew, and
        the window grows until it agrees with its neighbours on both sides; then all tokens outside stay as they are.
        """
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        before = after = self.window
        while True:
            head, tail = left[: max(len(left) - before, 0)], right[after:]
            middle = self._plain(self.decode(left[len(head) :]) + self.decode(right[:after]))
            fits_left = not len(head) or self._agree(head[-1], middle[0])
            fits_right = not len(tail) or self._agree(middle[-1], tail[0])
            if fits_left and fits_right:
                return np.concatenate([head, middle, tail])
            before, after = before * (1 if fits_left else 2), after * (1 if fits_right else 2)

    def _agree(self, one: int, other: int) -> bool:
        pair = self._plain(self.bytes[one] + self.bytes[other])
        return len(pair) == 2 and pair[0] == one and pair[1] == other

    def _plain(self, data: bytes) -> np.ndarray:
        return np.array(self.coding._encode_single_piece(data), np.uint32)

    # ------------------------------------------------------------------ back

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids: those of its halves, one after the other."""
        if len(ids) <= IDS:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=2)
def coder(path: str, leaf: int = LEAF, window: int = WINDOW) -> Coder:
    """The coder of a file of ranks, loaded once in a Python worker."""
    with open(path, "rb") as file:
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, leaf, window)


def _mapped(table: DataFrame, source: str, target: str, work) -> DataFrame:
    """The table with column ``source`` replaced by ``target``, computed row by row in Arrow batches."""
    fields = [StructField(target, BinaryType()) if f.name == source else f for f in table.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = [pa.array(work(batch.column(source)), pa.binary()) if n == source else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return table.mapInArrow(run, StructType(fields))


def encode_reports(reports: DataFrame, ranks: str, leaf: int = LEAF) -> DataFrame:
    """The tokens of report texts: report_id, n_tokens, token_bytes (ids as little-endian unsigned 32-bit numbers).

    ``ranks`` is the path of a ``tiktoken`` file of byte-level ranks, the same on all executors. Every match of ``PATTERN`` is encoded by
    itself, without special tokens; strings that look like some are ordinary text. Texts of more than ``leaf`` characters are halved
    again and again. Halves are joined around their border: between the nearest ends of matches that no text on the other side can move,
    the text is encoded anew, and inside a match longer than that a window of tokens grows until its neighbours provably stay. So no
    step takes more than linear time in a match, however long.

    A row per report, in no order; one pass, no shuffle. A null or empty text has no tokens. Bytes that are no UTF-8 become U+FFFD. Ids
    may be null or repeated; other columns are ignored. A text is one cell and is held whole in one task.
    """
    light(reports.sparkSession)

    def work(column: pa.Array) -> list[bytes]:
        own = coder(ranks, leaf)
        return [own.encode(t).astype("<u4").tobytes() if t else b"" for t in column.to_pylist()]

    texts = reports.select("report_id", F.make_valid_utf8("report_text").alias("report_text"))
    encoded = _mapped(texts, "report_text", "token_bytes", work)
    return encoded.select("report_id", (F.octet_length("token_bytes") / 4).cast(LongType()).alias("n_tokens"), "token_bytes")


def decode_reports(encoded: DataFrame, ranks: str) -> DataFrame:
    """The texts of tokens: report_id, text_bytes. ``encoded`` has report_id and token_bytes as :func:`encode_reports` gives them.

    Null or no tokens give no bytes. An id that the vocabulary does not have is an error, as are bytes that are no whole ids.
    """

    def work(column: pa.Array) -> list[bytes]:
        own = coder(ranks)
        return [own.decode(np.frombuffer(b or b"", "<u4")) for b in column.to_pylist()]

    return _mapped(encoded.select("report_id", "token_bytes"), "token_bytes", "text_bytes", work)
