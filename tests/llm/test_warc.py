import gzip
import hashlib
import io

import pytest

from riskloom.llm.warc import _Bytes, members, read_archives, record, write_archives
from tests.llm.helpers import AWKWARD, LONG, reports, rows_of

COLUMNS = ("report_id", "record_type", "source_file_path", "report_text", "payload_bytes", "payload_digest", "refers_to")


@pytest.mark.parametrize("split", [8 << 20, 97])
def test_round_trip(spark, tmp_path, split):
    rows = AWKWARD + [(40, LONG, "s", None, "http://b.example.org/ü?q=1#x"), (41, "y" * 999), (42, "y" * 999), (43, "y" * 1000), (44, "y" * 1000)]
    manifest = write_archives(reports(spark, rows), f"file://{tmp_path}/w")
    assert sum(r.records for r in manifest.collect()) == len(rows)
    got = read_archives(spark, f"file://{tmp_path}/w", split).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    largest = {}
    for r in rows:
        if r[0] is not None and len((r[1] or "").encode()) >= 1000:
            largest[r[1]] = max(r[0], largest.get(r[1], r[0]))
    for r in rows:
        text, want = r[1] or "", largest.get(r[1])
        revisit = want is not None and r[0] is not None and r[0] != want
        address = (r[4] if len(r) > 4 else None)
        known = [g for g in got if g.report_id == (None if r[0] is None else str(r[0])) and g.payload_digest == hashlib.sha1(text.encode()).hexdigest()]
        assert known, r
        for g in known:
            assert g.record_type == ("revisit" if revisit else "response") and g.refers_to == (str(want) if revisit else None)
            assert g.payload_bytes == len(text.encode()) and g.report_text == (None if revisit else text)
            assert address is None or g.source_file_path.startswith(address[:20])


def test_every_range_owns_the_records_that_start_in_it():
    parts = [gzip.compress(record(k, None, bytes([31, 139, 8] * k) + b"<p>" * (k * 37 % 900), hashlib.sha1(b"").hexdigest(), None)) for k in range(60)]
    # Stored blocks show the magic number inside members; rubbish and a cut member lie between.
    stored = [gzip.compress(record(100 + k, None, parts[k], hashlib.sha1(b"").hexdigest(), None), 0) for k in range(5)]
    pieces = [*parts[:20], *stored, b"\x1f\x8b\x08 no member", gzip.compress(b"not a record"), *parts[20:], parts[3][:40]]
    whole = b"".join(pieces)

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    def starts(step, block):
        source = _Bytes(File(whole), len(whole), block)
        return [at for a in range(0, len(whole), step) for at, _ in members(source, a, min(a + step, len(whole)))]

    every = starts(len(whole), 1 << 20)
    real, at = [], 0
    for piece in pieces:
        if piece in parts or piece in stored:
            real.append(at)
        at += len(piece)
    assert every == real
    # A range that begins inside a stored member may see the member that is its payload; ranges by whole members do not.
    plain = b"".join(parts)
    whole = plain
    assert all(starts(step, block) == starts(len(plain), 1 << 20) for step in (50, 333, 5000) for block in (64, 1 << 20))


def test_archives_of_others(spark, tmp_path):
    """Records of every type, headers in small letters, folded and absent fields, digests of other kinds, several records in a member."""
    def made(kind, block, fields=(), name="WARC-Type", size="Content-Length"):
        head = "".join(f"{k}: {v}\r\n" for k, v in [(name, kind), *fields, (size, len(block))])
        return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nserver: x\r\n\r\n<p>gas</p>"
    sha1 = hashlib.sha1(b"<p>gas</p>").hexdigest()
    others = [made(k, b"software: x\r\n") for k in ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")]
    responses = [
        made("response", page, [("warc-target-uri", "http://a.org/"), ("warc-payload-digest", f"sha1:{sha1}")], "warc-type", "content-length"),
        made("response", page, [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Payload-Digest", "md5:00")]),
        made("response", b"dns: 10.0.0.1", [("WARC-Payload-Digest", "sha1:not base 32")]),
        made("Response", page, [("WARC-Target-URI", "http://a.org/x\r\n  y"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)]),
        made("revisit", b"", [("WARC-Record-ID", "<urn:report:7>")]), made("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n", [("WARC-Payload-Digest", f"SHA1:{sha1.upper()}")]),
    ]
    damaged = [b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\n", b"WARC/1.0\r\n", made("response", page)[:-60]]
    single = [gzip.compress(r) for r in (*others, *responses, *damaged)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(single))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(b"".join([*others, *responses])))
    columns = ("report_id", "record_type", "source_file_path", "report_text", "payload_bytes", "payload_digest", "intact")
    want = [
        (None, "response", "http://a.org/", "<p>gas</p>", 10, sha1, True), (None, "response", None, "<p>gas</p>", 10, sha1, None),
        (None, "response", None, "dns: 10.0.0.1", 13, hashlib.sha1(b"dns: 10.0.0.1").hexdigest(), None),
        (None, "response", "http://a.org/x y", "<p>gas</p>", 10, sha1, False), ("7", "revisit", None, None, None, None, None), (None, "revisit", None, None, 12, sha1, True),
    ]
    found = read_archives(spark, f"file://{tmp_path}/w", 300)
    got = {f: [tuple(r[c] for c in columns) for r in sorted(found.filter(found.archive.endswith(f)).collect(), key=lambda r: r.position)] for f in ("a.warc.gz", "b.warc.gz")}
    # A record that is cut off holds what there is of its block.
    assert got["a.warc.gz"][:6] == want and sorted(got["b.warc.gz"], key=str) == sorted(want, key=str)
    assert len(got["a.warc.gz"]) <= 7


def test_a_task_that_runs_again_replaces_its_file(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(20)]
    for _ in range(2):
        write_archives(reports(spark, rows), f"file://{tmp_path}/w")
    assert len(rows_of(read_archives(spark, f"file://{tmp_path}/w"), *COLUMNS)) == 20


def test_empty_table(spark, tmp_path):
    write_archives(reports(spark, []), f"{tmp_path}/w")
    assert rows_of(read_archives(spark, f"{tmp_path}/w"), *COLUMNS) == []
