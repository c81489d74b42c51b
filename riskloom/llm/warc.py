"""WARC archives of collected reports: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from riskloom.functions.lineage import stored
from riskloom.llm.batches import ROWS, light, parts

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: Bytes of an archive that one reading task owns.
SPLIT = 8 << 20
LEVEL = 4
#: Rows of the table of revisits (an id, a digest and an id) up to which it is sent to every executor.
FEW = 100_000
# The opening bytes of a gzip member, of a record in it, and of its named fields.
MAGIC, OPENING = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16


def _opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it; a single slash after the scheme is a local path."""
    local = re.match(r"file:/(?!/)", path)
    return FileSystem.from_uri("file://" + path[5:] if local else path)


def _name(value) -> str:
    return f"<urn:report:{quote(str(value), safe='')}>" if value is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _identity(name: str) -> str | None:
    found = re.fullmatch(r"<?urn:report:(.*?)>?", name or "")
    return unquote(found.group(1)) if found else None


def record(report_id, address: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header, and with it the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", _name(report_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if address is not None:
        fields.append(("WARC-Target-URI", quote(address, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = _opened(folder)
        final = f"{root}/part-{task.partitionId():06d}.warc.gz"
        written = f"{root}/_attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        rows = 0
        with system.open_output_stream(written) as out:
            for batch in parts(batches):
                columns = [batch.column(c).to_pylist() for c in ("report_id", "source_file_path", "report_text", "digest", "refers_to")]
                for report_id, address, text, digest, refers_to in zip(*columns):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(record(report_id, address, text.encode(), digest, refers_to)) + packer.flush())
                    rows += 1
        # The whole file appears under its name at once; a task that runs again replaces it by the same records.
        if system.get_file_info(final).type == FileType.File:
            system.delete_file(final)  # some file systems do not move onto a file
        system.move(written, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([rows], pa.int64())], names=["path", "records"])

    return run


def write_archives(reports: DataFrame, folder: str, least: int = LEAST_REVISIT, level: int = LEVEL) -> DataFrame:
    """Reports written as gzipped WARC files, one a task, a record a gzip member; returns path and records of each.

    Reads report_id, report_text (the payload in UTF-8; null counts as empty) and source_file_path (the address,
    may be null). Of records with equal payloads of ``least`` bytes or more, the one with the largest
    report_id is a response and the others are revisits of it. Payloads are told apart by SHA-1 and length, which
    alone are shuffled. Rows without an id are always responses, and so are all rows that repeat the id of a
    response. ``folder`` must be reached by all executors through Arrow's file systems. An empty table writes
    no record.
    """
    light(reports.sparkSession)
    text = F.coalesce(F.col("report_text"), F.lit(""))
    rows = reports.select("report_id", "source_file_path", text.alias("report_text")).withColumn("digest", F.sha1(F.encode("report_text", "UTF-8")))
    heads = stored(rows.filter("report_id is not null").select("report_id", "digest", F.octet_length("report_text").alias("size")).filter(F.col("size") >= least))
    groups = heads.groupBy("digest", "size").agg(F.max("report_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = stored(
        heads.join(groups, ["digest", "size"]).filter("report_id <> refers_to").select("report_id", "digest", "refers_to").distinct())
    revisits = F.broadcast(revisits) if revisits.count() <= FEW else revisits
    system, root = _opened(folder)
    system.create_dir(root, recursive=True)
    shape = StructType([StructField("path", StringType()), StructField("records", LongType())])
    return stored(rows.join(revisits, ["report_id", "digest"], "left").mapInArrow(_writer(folder, level), shape))


class _Bytes:
    """Random access to a file by blocks, of which the last is kept."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.at, self.held = file, size, block, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``; fewer only at the end of the file."""
        if at < self.at or min(at + n, self.size) > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(self.block, max(0, self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]


def _member(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at ``at`` and where the member ends; None if there is none."""
    unpacker, parts, place, checked = zlib.decompressobj(31), [], at, False
    try:
        while not unpacker.eof:
            chunk = source.read(place, _STEP)
            if not chunk:
                return None
            parts.append(unpacker.decompress(chunk))
            place += len(chunk)
            if not checked and (unpacker.eof or sum(map(len, parts)) >= len(OPENING)):
                if not b"".join(parts).startswith(OPENING):
                    return None
                checked = True
    except zlib.error:
        return None
    return b"".join(parts), place - len(unpacker.unused_data)


def members(source: _Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records whose member starts in [start, end)."""
    at = start
    while at < end:
        window = source.read(at, _STEP)
        if not window:
            return
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)  # the magic may lie across the end of what was read
            continue
        at += found
        if at >= end:
            return
        got = _member(source, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]


def _sha1(text: str | None) -> str | None:
    """The SHA-1 in a digest field, in base 32 or hexadecimal; None where it is absent, of another kind or damaged."""
    kind, _, value = (text or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, under names in small letters, and block of each record of a member; what follows a damaged one is left."""
    at = 0
    while content.startswith(OPENING, at):
        end = content.find(b"\r\n\r\n", at)
        lines = re.sub(r"\r\n[ \t]+", " ", content[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}
        size = fields.get("content-length", "")
        if end < 0 or not (size.isascii() and size.isdigit()):
            return
        block = content[end + 4 : end + 4 + int(size)]
        yield fields, block
        at = end + 4 + len(block) + 4


def parsed(fields: dict[str, str], block: bytes) -> tuple | None:
    """report_id, record_type, address, payload, payload_bytes, payload_digest, refers_to, intact of a response or revisit; else None."""
    kind = fields.get("warc-type", "").lower()
    if kind not in ("response", "revisit"):
        return None
    # A response need not be of HTTP: then all of it is payload.
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
    said, revisit = _sha1(fields.get("warc-payload-digest")), kind == "revisit"
    digest = said if revisit else hashlib.sha1(payload).hexdigest()
    size = int(length.group(1)) if length else None if revisit else len(payload)
    return (
        _identity(fields.get("warc-record-id", "")), kind, fields.get("warc-target-uri"), None if revisit else payload.decode("utf-8", "replace"),
        size, digest, _identity(fields.get("warc-refers-to", "")), None if said is None else digest == said and (revisit or size == len(payload)),
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["report_id", "record_type", "source_file_path", "report_text", "payload_bytes", "payload_digest", "refers_to", "intact", "archive", "position"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, length, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "start", "end")]):
            system, place = _opened(path)
            rows = []
            with system.open_input_file(place) as file:
                for at, content in members(_Bytes(file, length), start, end):
                    rows += [(*found, path, at) for found in (parsed(*r) for r in records(content)) if found is not None]
                    if len(rows) >= ROWS:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The response and revisit records of all archives ``*.warc.gz`` in a folder, read in byte ranges.

    A task owns the records whose gzip member starts in its range of ``split`` bytes, wherever they end. It looks
    for the magic number, takes a candidate only if what it unpacks opens like a record, and goes on where that
    member ends; damaged members are skipped. Returns report_id (text), record_type, source_file_path, report_text
    (null for a revisit), payload_bytes and payload_digest (of the full payload; SHA-1, hexadecimal), refers_to,
    intact (does the payload agree with its header), archive and position.

    Archives of others may hold other records, names of fields in any capitals, several records in a member, and
    responses without HTTP. Records of other types (warcinfo, request, metadata and so on) are passed over. Ids
    that are not of reports are null. Without a SHA-1 in the header intact is null, and so is a revisit's digest;
    a revisit's payload_bytes are null where its HTTP header does not name them. Payloads are not unpacked.
    """
    system, root = _opened(folder)
    files = [f for f in system.get_file_info(FileSelector(root)) if f.type == FileType.File and f.path.endswith(".warc.gz")]
    scheme = folder[: folder.index(root)] if root in folder else ""
    # One row a file: names and sizes only.
    listed = spark.createDataFrame([(scheme + f.path, f.size) for f in files], "path string, length long")
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least("length", F.col("start") + F.lit(split)))
    n = max(1, sum(-(-f.size // split) for f in files))
    text, number = StringType(), LongType()
    shape = StructType([
        *[StructField(c, text) for c in ("report_id", "record_type", "source_file_path", "report_text")], StructField("payload_bytes", number),
        StructField("payload_digest", text), StructField("refers_to", text), StructField("intact", BooleanType()),
        StructField("archive", text), StructField("position", number),
    ])
    return ranges.repartition(n).mapInArrow(_reader, shape)

