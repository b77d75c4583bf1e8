"""WARC records in ZIP archives: written by tasks, found through the ZIP's directories, and read by ranges.

Every task writes one archive with two stored members: records, each its own gzip stream, and an index of their places. A reader parses the end of the file,
the ZIP64 and central directories and the index, and then reads ranges of records out of the stored member: nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import new_folder, stored

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Records are read in ranges of about so many bytes.
RANGE_BYTES = 8 << 20
#: Files are read in pieces of so many bytes.
CHUNK_BYTES = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _name(page_id: int | None, url: str | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}').urn}>"


def _line(value: str) -> str:
    """A header's value: one line, with other control characters and the percent sign escaped."""
    return "".join(c if c >= " " and c not in "%\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _unline(value: str) -> str:
    out, k, data = bytearray(), 0, value.encode()
    while k < len(data):
        if data[k : k + 1] == b"%":
            out.append(int(data[k + 1 : k + 3], 16))
            k += 3
        else:
            out.append(data[k])
            k += 1
    return out.decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to`` without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id, url)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields; those that it doesn't have are None. Responses and resources have a payload, whose digest and length must agree with what the record says of them."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    kind = fields.get("warc-type", "")
    digest, size = fields.get("warc-payload-digest"), fields.get("x-payload-length")
    digest = digest.partition(":")[2] or digest if digest and (digest.lower().startswith("sha1:") or ":" not in digest) else None
    payload = None
    if kind in ("response", "resource"):
        http = fields.get("content-type", "").lower().startswith("application/http")
        payload = body.partition(b"\r\n\r\n")[2] if http else body
        if size is not None and len(payload) != int(size) or digest is not None and base32_sha1(payload) != digest.upper():
            raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("warc-target-uri")
    own = "x-payload-length" in fields  # written here, and so its address is escaped
    return {
        "page_id": number("x-page-id"),
        "url": None if url is None else _unline(url) if own else url.strip("<>"),
        "record_type": kind,
        "payload_digest": base32_sha1(payload) if payload is not None else digest,
        "payload_bytes": len(payload) if payload is not None else number("x-payload-length"),
        "refers_to": number("x-refers-to-page-id"),
        "payload": payload,
    }


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a run of bytes that comes in pieces, plain or each in a gzip stream of its own; one record and a piece are held at a time."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        for chunk in chunks:
            if chunk:
                del held[:at]
                at = 0
                held.extend(chunk)
                return True
        return False

    while True:
        while at < len(held) and held[at] in b"\r\n":
            at += 1
        if len(held) - at < 2 and more():
            continue
        if at == len(held):
            return
        if held[at : at + 2] == b"\x1f\x8b":
            stream, plain, piece = zlib.decompressobj(31), [], bytes(held[at:])
            at = len(held)
            while not stream.eof:
                plain.append(stream.decompress(piece))
                if not stream.eof:
                    if not more():
                        raise ValueError("a record's gzip stream is cut off")
                    piece, at = bytes(held), len(held)
            held, at = bytearray(stream.unused_data), 0
            yield from records_of(iter([b"".join(plain)]))
            continue
        searched = at
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                raise ValueError("not a WARC record")
            searched = at + seen
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", bytes(held[at:end]))
        if size is None:
            raise ValueError("not a WARC record")
        length = end + 4 + int(size[1]) - at
        while len(held) - at < length and more():
            pass
        yield bytes(held[at : at + length])
        at = min(at + length, len(held))


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a run of bytes."""
    return records_of(data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES))


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Member:
    """A stored member of an archive: where its bytes start, and how many they are."""

    start: int
    size: int


def members(file: pa.NativeFile) -> dict[str, Member]:
    """Stored members by name, from the end record, the ZIP64 end record where there is one, and the central directory; a compressed member has no range, so its size is -1."""
    total = file.size()
    tail_at = max(0, total - 65_535 - 22)
    tail = file.read_at(total - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, at):
        locator = file.read_at(20, tail_at + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        count, size, at = struct.unpack_from("<QQQ", record64, 32)
    directory = file.read_at(size, at)
    out: dict[str, Member] = {}
    k = 0
    for _ in range(count):
        if directory[k : k + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain = struct.unpack_from("<H", directory, k + 10)[0], *struct.unpack_from("<II", directory, k + 20)
        name_size, extra_size, note_size = struct.unpack_from("<HHH", directory, k + 28)
        local = struct.unpack_from("<I", directory, k + 42)[0]
        name = directory[k + 46 : k + 46 + name_size].decode()
        extra, e = directory[k + 46 + name_size : k + 46 + name_size + extra_size], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the fields that don't fit, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + length
        k += 46 + name_size + extra_size + note_size
        if method == 0:
            name_size, extra_size = struct.unpack_from("<HH", file.read_at(30, local), 26)
            out[name] = Member(local + 30 + name_size + extra_size, packed)
        else:
            out[name] = Member(local, -1)
    return out


def _indexed(file: pa.NativeFile, found: dict[str, Member]) -> dict[str, list[tuple[int, int]]]:
    """Offsets and lengths of records by member, from the archive's indexes: JSON lines, with or without a sort key before the JSON, plain or gzip."""
    out: dict[str, list[tuple[int, int]]] = {}
    for name, member in found.items():
        if not name.startswith("indexes/") or member.size < 0 or name.endswith(".idx"):
            continue
        data = file.read_at(member.size, member.start)
        while data[:2] == b"\x1f\x8b":
            stream = zlib.decompressobj(31)
            plain, rest = stream.decompress(data) + stream.flush(), stream.unused_data
            while rest[:2] == b"\x1f\x8b":
                stream = zlib.decompressobj(31)
                plain, rest = plain + stream.decompress(rest) + stream.flush(), stream.unused_data
            data = plain
        for line in data.splitlines():
            if (at := line.find(b"{")) < 0 or b'"offset"' not in line:
                continue
            entry = json.loads(line[at:])
            own = entry.get("filename")
            out.setdefault(RECORDS if own is None else own if own in found else f"archive/{own}", []).append((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(set(places)) for name, places in out.items()}


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId() if task else 0:06d}-{task.taskAttemptId() if task else os.getpid()}.zip"  # a repeated task writes another file
        files, place = _files(path)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        index: list[bytes] = []
        with files.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:  # type: ignore[arg-type]
            with archive.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True) as member:
                at = 0
                for batch in itertools.chain([first], batches):
                    at = _append(batch, member, index, at)
            archive.writestr(zipfile.ZipInfo(INDEX), b"".join(index))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    return write


def _append(batch: pa.RecordBatch, member, index: list[bytes], at: int) -> int:  # noqa: ANN001
    for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        packed = gzip.compress(record(page_id, url, payload, refers_to), compresslevel=4, mtime=0)
        member.write(packed)
        index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(packed)}).encode() + b"\n")
        at += len(packed)
    return at


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """Write a record for each row; returns ``(path, records)`` of the archives, one a task.

    Of rows with equal payloads of at least ``smallest`` bytes, the one with the smallest id is a response, the others are revisits. Null
    payloads are empty. Rows that share the smallest id are responses each; a null id is never the smallest of several, and rows that have no id at all are responses.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    first = rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= smallest)).drop("n")
    rows = rows.join(first, ["digest", "bytes"], "left")
    refers_to = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return stored(rows.select("page_id", "url", "payload", refers_to.alias("refers_to")).mapInArrow(_writer(folder), "path string, records long"), "archives")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole records, as places in the archive's file; a member that no index speaks of is one run."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, place = _files(path)
            starts: list[int] = []
            lengths: list[int] = []
            with files.open_input_file(place) as file:
                found = members(file)
                index = _indexed(file, found)
            for name, member in found.items():
                if not name.startswith("archive/") or not name.endswith((".warc", ".warc.gz")):
                    continue
                if member.size < 0:
                    raise ValueError(f"{path}: {name} is compressed in the archive, so its records have no ranges")
                last = -1
                for offset, length in index.get(name, [(0, member.size)] if member.size else []):
                    if last == offset and lengths[-1] + length <= RANGE_BYTES:
                        lengths[-1] += length
                    else:
                        starts.append(member.start + offset)
                        lengths.append(length)
                    last = offset + length
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["path", "start", "length"])


def _reader(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * with_payload

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges in batches:
            for path, start, length in zip(*(c.to_pylist() for c in ranges.columns), strict=True):
                files, place = _files(path)
                with files.open_input_file(place) as file:
                    chunks = (file.read_at(min(CHUNK_BYTES, start + length - k), k) for k in range(start, start + length, CHUNK_BYTES))
                    rows: list[dict] = []
                    held = 0
                    for found in records_of(chunks):
                        rows.append(parse_record(found))
                        held += len(found)
                        if held > RANGE_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return read


def read_archives(archives: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives at ``path_col``; their ranges are dealt over the cluster. No archives give no rows.

    Archives of other writers are read too: records are found by their index, or one after the other where it doesn't name their member; what a record doesn't say is
    null. A member that the archive compresses is an error.
    """
    spark = archives.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * with_payload
    ranges = archives.select(F.col(path_col).alias("path")).repartition(tasks, "path").mapInArrow(_ranges, "path string, start long, length long")
    return ranges.repartition(tasks, "path", "start").mapInArrow(_reader(with_payload), schema)
