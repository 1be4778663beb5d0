"""WARC archives: whole-file gzip streams, and their normal form of one gzip member a record with an index.

* ``write_archives`` writes records as *monolithic* archives: one gzip stream over many records, as plain
  compression of a WARC file gives.  Nothing in it can be read without all that is before.
* ``normalise`` inflates every such stream once, in steps of bounded size, writes each record as a gzip member of
  its own and beside the archive a *sidecar index* of JSON lines: ``offset`` and ``length`` of the member, record id,
  type.  A record is passed on in pieces and is never held whole.
* ``read_archives`` seeks to the members of the index and returns the records.

The unit of work is an archive of about ``ARCHIVE_BYTES`` before compression.  Its name is new in every task attempt
and a manifest (a Spark table) lists the archives of the attempts that counted, so what a lost
executor leaves behind is never read.  Files are reached by ``pyarrow.fs`` (local, HDFS or object stores by URI).

Payloads repeat: of equal payloads of at least ``revisit_from`` bytes the record with the smallest id is a ``response``,
the others are ``revisit`` records that refer to it and hold the HTTP header alone.

Cases: a null payload counts as empty; a null id is the smallest of no group, and its record gets an id made of
its contents; rows that repeat the smallest id of their group are responses alike; a null url gives no
target line, control characters and blanks of a url are percent-encoded; an empty table gives no archive; other columns are
ignored, whatever their names.  A truncated stream or a damaged record is an error that names the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut_lineage

ARCHIVE_BYTES = 64 << 20
STEP = 1 << 20          # bytes read, inflated or passed on at once
LONGEST_HEADER = 1 << 20
# Format names of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
GZIP = 31  # zlib's window setting for a gzip wrapper


# --- records ----------------------------------------------------------------------------

def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record_id(row_id: int | None, url: str | None, digest: str) -> str:
    if row_id is not None:
        return f"<urn:page:{row_id}>"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{digest}')}>"


def record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` with the HTTP header alone."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(row_id, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(header: bytes) -> dict[str, str]:
    """Named fields of a record or HTTP header, names in lower case."""
    out = {}
    for line in header.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def page_of(record_name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_name or "")
    return int(found.group(1)) if found else None


# --- writing ----------------------------------------------------------------------------

def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


class _Monolith:
    """An archive being written as one gzip stream."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, name = _open(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(name, compression=None)
        self.stream = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        self.records = self.size = 0

    def add(self, whole: bytes) -> None:
        self.out.write(self.stream.compress(whole))
        self.records += 1
        self.size += len(whole)

    def close(self) -> pa.RecordBatch:
        self.out.write(self.stream.flush())
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.records], pa.int64())],
                                          ["archive", "records"])


def write_archives(pages: DataFrame, folder: str, row_id: str = "page_id", url: str = "url", payload: str = "html",
                   revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z", size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row and return the manifest ``(archive, records)`` of the monolithic archives.

    The payloads are not shuffled where the table of repeated payloads is small (Spark's own threshold on
    the size of its file); beyond it they are joined by their digest, and adaptive execution splits a hot one."""
    rows = pages.select(F.col(row_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    repeated = cut_lineage(keyed.where(F.octet_length("payload") >= revisit_from).groupBy("same").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first"))
    original = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    source = keyed.join(repeated, "same", "left").select("id", "url", "payload", original.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for k in range(batch.num_rows):
                archive = archive or _Monolith(folder)
                archive.add(record(*[batch.column(c)[k].as_py() for c in ("id", "url", "payload", "refers_to")], date))
                if archive.size >= size:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return cut_lineage(source.mapInArrow(run, "archive string, records bigint"))


# --- normal form ------------------------------------------------------------------------

def inflated(source, name: str) -> Iterator[bytes]:
    """The bytes of a gzip file (one stream or several members) in steps of bounded size."""
    stream, fresh, rest = zlib.decompressobj(GZIP), True, b""
    while True:
        data = rest or source.read(STEP)
        if not data:
            break
        out = stream.decompress(data, STEP)
        fresh = False
        if out:
            yield out
        rest = stream.unconsumed_tail
        if stream.eof:
            rest = stream.unused_data
            stream, fresh = zlib.decompressobj(GZIP), True
    if not fresh:
        raise ValueError(f"{name}: the gzip stream is cut off")


def split_records(steps: Iterator[bytes], name: str) -> Iterator[tuple[bytes | None, bytes]]:
    """Records of a WARC byte stream as pieces ``(header, bytes)``; the header comes with a record's first piece
    and is None with the others."""
    held, left, fields = b"", 0, None
    for step in steps:
        held += step
        while held:
            if fields is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    if len(held) > LONGEST_HEADER:
                        raise ValueError(f"{name}: a record header does not end")
                    break
                header, held = held[:end + 4], held[end + 4:]
                fields = fields_of(header[:-4])
                if not header.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                    raise ValueError(f"{name}: not a record: {header[:60]!r}")
                left = int(fields["content-length"]) + 4
                yield header, header
            piece, held = held[:left], held[left:]
            left -= len(piece)
            if piece:
                yield None, piece
            if not left:
                fields = None
    if held or fields is not None:
        raise ValueError(f"{name}: the last record is cut off")


def normalise_archive(archive: str, folder: str) -> tuple[str, str, int]:
    """Rewrite one archive with a gzip member per record; returns its path, that of the index and the record count."""
    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
    system, name = _open(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    source_system, source_name = _open(archive)
    index = path + ".idx"
    offset = count = 0
    member, entry = None, None
    with source_system.open_input_stream(source_name, compression=None) as source, \
            system.open_output_stream(name, compression=None) as out, \
            system.open_output_stream(_open(index)[1], compression=None) as listing:

        def close() -> None:
            nonlocal offset, count
            tail = member.flush()
            out.write(tail)
            entry["length"] += len(tail)
            listing.write((json.dumps(entry) + "\n").encode())
            offset += entry["length"]
            count += 1

        for header, piece in split_records(inflated(source, archive), archive):
            if header is not None:
                if member is not None:
                    close()
                fields = fields_of(header[:-4])
                member = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                entry = {"offset": offset, "length": 0, "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}
            packed = member.compress(piece)
            out.write(packed)
            entry["length"] += len(packed)
        if member is not None:
            close()
    return path, index, count


def _one_each(manifest: DataFrame) -> DataFrame:
    """The archives of a manifest, about one to a task."""
    return manifest.repartitionByRange(max(1, manifest.count()), "archive")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Every archive of a manifest in normal form: the manifest ``(archive, index, records)`` of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                path, index, count = normalise_archive(archive, folder)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([index]), pa.array([count], pa.int64())],
                                                 ["archive", "index", "records"])

    return cut_lineage(_one_each(manifest).select("archive").mapInArrow(run, "archive string, index string, records bigint"))


# --- reading ----------------------------------------------------------------------------

RECORD_FIELDS = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary())])
RECORD_SCHEMA = ("archive string, offset bigint, length bigint, id bigint, url string, record_type string, refers_to bigint, "
                 "payload_bytes bigint, payload_digest string, payload binary")


def parse_member(member: bytes, name: str) -> dict:
    """One record from its gzip member.  A response's digest is that of its payload, checked against the one in
    its header; a revisit has those of the payload it refers to, from its own headers."""
    whole = zlib.decompress(member, GZIP)
    end = whole.index(b"\r\n\r\n")
    fields = fields_of(whole[:end])
    block = whole[end + 4:end + 4 + int(fields["content-length"])]
    if len(whole) != end + 8 + len(block):
        raise ValueError(f"{name}: a member does not hold one record")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(fields_of(http)["content-length"])
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (digest_of(payload) != stated or len(payload) != size):
        raise ValueError(f"{name}: payload and digest of {fields['warc-record-id']} differ")
    return {"id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": page_of(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": stated,
            "payload": None if revisit else payload}


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of normalised archives, each read by its offset: ``RECORD_SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                system, name = _open(archive)
                with system.open_input_file(name) as source, system.open_input_stream(_open(index)[1], compression=None) as listing:
                    held, size = [], 0
                    for entry in map(json.loads, _lines(listing)):
                        source.seek(entry["offset"])
                        row = parse_member(source.read(entry["length"]), f"{archive} at {entry['offset']}")
                        held.append({"archive": archive, "offset": entry["offset"], "length": entry["length"], **row})
                        size += row["payload_bytes"]
                        if size > 8 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, RECORD_FIELDS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, RECORD_FIELDS)

    return _one_each(manifest).select("archive", "index").mapInArrow(run, RECORD_SCHEMA)


def _lines(source) -> Iterator[bytes]:
    held = b""
    while step := source.read(STEP):
        *lines, held = (held + step).split(b"\n")
        yield from lines
    if held:
        yield held
