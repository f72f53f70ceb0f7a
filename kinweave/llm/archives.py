"""Web archives: a converter of legacy ARC files to WARC files, with their writers and readers.

An ARC file (version 1 or 2) is a line of blank-separated fields before each body; the last field is
the body's length, and the file's first record names the version and the fields. The converter reads those
lines and lengths and gives each record what WARC asks for: an identifier, a timestamp, a type and
digests. Payloads that occur more than once are stored once; the other records become revisits.

Files are a gzip member for each record. A task writes files of bounded size under the shared folder,
under names of its own attempt; only names in the manifest (the rows a finished task returns)
count, so lost executors leave no half file behind. Payloads are never shuffled: digests are.

Decisions: a null payload is empty, a null address is ``-``, blanks in an address are percent-encoded. Of
equal payloads of at least ``min_payload`` bytes the least page id is the response (a missing id is
last; repeated ids go by their place in the archive). An empty table makes no file. A malformed header line
raises, naming file and record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import left_join_unique
from ..session import stage
from .common import AttemptFile, arrow_schema, as_batch, map_batches, new_folder, read_file, spread

#: A file is closed after so many bytes (before compression) or records.
FILE_BYTES = 64 << 20
FILE_RECORDS = 20_000

#: The field names of the two ARC versions.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_FETCHED = "20200101000000"
_MANIFEST = "file string, records long, bytes long"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def sha1_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Roller:
    """Writes records into files of bounded size; ``done`` are manifest rows."""

    def __init__(self, folder: str, stem: str, first, file_bytes: int, file_records: int):
        self.folder, self.stem, self.first = folder, stem, first
        self.file_bytes, self.file_records = file_bytes, file_records
        self.file: AttemptFile | None = None
        self.done: list[tuple[str, int, int]] = []
        self.raw = self.records = 0

    def add(self, record: bytes) -> None:
        if self.file is None:
            self.file = AttemptFile(self.folder, self.stem)
            self.file.write(_member(self.first(self.file.name)))
            self.raw = self.records = 0
        self.file.write(_member(record))
        self.raw += len(record)
        self.records += 1
        if self.raw >= self.file_bytes or self.records >= self.file_records:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.file.name, self.records, self.file.size))
            self.file = None

    def manifest(self) -> dict:
        names, records, sizes = zip(*self.done, strict=True) if self.done else ((), (), ())
        return {"file": list(names), "records": list(records), "bytes": list(sizes)}


# -- ARC -----------------------------------------------------------------------------------------


def arc_record(version: str, url: str, content_type: str, body: bytes, status: int, name: str, offset: int) -> bytes:
    fields = [url, "0.0.0.0", _FETCHED, content_type]
    if version == "2":
        fields += [str(status), "-", "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode("utf-8", "replace") + b"\n" + body + b"\n"


def arc_version_record(version: str, name: str) -> bytes:
    body = f"{version} 0 kinweave\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {_FETCHED} text/plain {len(body)}\n".encode() + body + b"\n"


def http_block(page_id, payload: bytes) -> bytes:
    """An HTTP response; the page id travels in a header of its own."""
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def _address(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "-") or "-"


def write_arc(
    pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS
) -> DataFrame:
    """Writes (page_id, url, html) as ARC files, versions 1 and 2 by turns of tasks; the manifest of files."""
    fields = arrow_schema(_MANIFEST)

    def run(batches):
        from pyspark import TaskContext

        version = "12"[TaskContext.get().partitionId() % 2]
        out = _Roller(folder, "legacy.arc.gz", lambda n: arc_version_record(version, n), file_bytes, file_records)
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block = http_block(page_id, (html or "").encode("utf-8", "replace"))
                out.add(arc_record(version, _address(url), "text/html", block, 200, out.stem, out.raw))
        out.close()
        yield as_batch(out.manifest(), fields)

    return stage(pages.select("page_id", "url", "html").mapInArrow(run, _MANIFEST), "arc-manifest")


def read_arc(stream, name: str = "") -> Iterator[dict]:
    """The records of an open ARC file, one at a time: url, ip, date, content_type, status, body, seq."""
    names: list[str] = []
    seq = 0
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not names:  # the version block: its own line is always of version 1
            length = _length(parts, name, seq)
            block = stream.read(length).decode("utf-8", "replace").split("\n")
            version = block[0].split(" ")[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"{name}: ARC version {version!r} is not known")
            names = ARC_FIELDS[version].split(" ")
            yield {"url": parts[0], "ip": parts[1], "date": parts[2], "type": "text/plain", "status": None,
                   "body": "\n".join(block).encode(), "seq": seq}
        else:
            length = _length(parts, name, seq)
            if len(parts) > len(names):  # addresses of old crawlers may hold blanks
                spare = len(parts) - len(names) + 1
                parts = ["%20".join(parts[:spare]), *parts[spare:]]
            if len(parts) != len(names):
                raise ValueError(f"{name}, record {seq}: {len(parts)} fields, {len(names)} declared")
            got = dict(zip(names, parts, strict=True))
            body = stream.read(length)
            if len(body) != length:
                raise ValueError(f"{name}, record {seq}: {len(body)} bytes of {length}")
            yield {"url": got["URL"], "ip": got["IP-address"], "date": got["Archive-date"],
                   "type": got["Content-type"], "status": got.get("Result-code"), "body": body, "seq": seq}
        seq += 1


def _length(parts: list[str], name: str, seq: int) -> int:
    if len(parts) < 5 or not parts[-1].isdigit():
        raise ValueError(f"{name}, record {seq}: not an ARC header line")
    return int(parts[-1])


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields in lower case, payload."""
    end = block.find(b"\r\n\r\n")
    head = block[: end + 4] if end >= 0 else block
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            fields[key.strip().lower()] = value.strip()
    return head, fields, block[len(head) :]


# -- ARC to WARC ---------------------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC timestamp; missing parts are the earliest."""
    digits = "".join(c for c in arc_date if c.isdigit())[:14]
    full = digits + "00000101000000"[len(digits) :] if len(digits) >= 4 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(file: str, seq: int) -> str:
    """The same legacy record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file}#{seq}')}>"


def warc_type(record: dict) -> str:
    if record["seq"] == 0:  # the version block; a page's address may begin with filedesc: too
        return "warcinfo"
    return "response" if record["body"].startswith(b"HTTP/") else "resource"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _open_gzip(folder: str, name: str):
    return io.BufferedReader(gzip.GzipFile(fileobj=read_file(folder, name)), 1 << 18)


def index_arc(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, seq, url, date, page_id, payload_bytes, digest) of every HTTP response in the listed files."""

    def work(batch):
        for name in batch.column(0).to_pylist():
            rows = {k: [] for k in ("file", "seq", "url", "date", "page_id", "payload_bytes", "digest")}
            with _open_gzip(folder, name) as stream:
                for r in read_arc(stream, name):
                    if warc_type(r) == "response":
                        _, fields, payload = split_http(r["body"])
                        page = fields.get("x-page-id")
                        values = (name, r["seq"], r["url"], r["date"], page and int(page), len(payload), sha1_digest(payload))
                        for column, v in zip(rows.values(), values, strict=True):
                            column.append(v)
            yield rows

    schema = "file string, seq long, url string, date string, page_id long, payload_bytes long, digest string"
    spread_files = spread(manifest.sparkSession, manifest.select("file"))
    return map_batches(spread_files, work, schema)


def revisits(index: DataFrame, min_payload: int = 0) -> DataFrame:
    """(file, seq, to_file, to_seq, to_url, to_date) of the records whose payload another record holds."""
    able = index.where(F.col("payload_bytes") >= min_payload)
    first = F.min(F.struct(F.col("page_id").isNull().alias("_none"), "page_id", "file", "seq", "url", "date"))
    held = able.groupBy("digest").agg(first.alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = left_join_unique(able.select("file", "seq", "digest"), held.select("digest", "to"), ["digest"])
    return met.where("to is not null and not (file = to.file and seq = to.seq)").select(
        "file", "seq", *[F.col(f"to.{c}").alias(f"to_{c}") for c in ("file", "seq", "url", "date")]
    )


def convert(
    manifest: DataFrame, folder: str, out: str, min_payload: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Writes the listed ARC files as WARC files below ``out``; the manifest of the new files.

    The revisits of a file come as one list, bounded by the records a file may hold.
    """
    index = stage(index_arc(manifest, folder), "arc-index")
    lists = (
        revisits(index, min_payload)
        .groupBy("file")
        .agg(F.collect_list(F.struct("seq", "to_file", "to_seq", "to_url", "to_date")).alias("to"))
    )
    jobs = manifest.select("file").join(lists, "file", "left")
    fields = arrow_schema(_MANIFEST)

    def run(batches):
        roller = _Roller(out, "converted.warc.gz", _warcinfo, file_bytes, FILE_RECORDS)
        for batch in batches:
            for name, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                targets = {t["seq"]: t for t in to or []}
                with _open_gzip(folder, name) as stream:
                    for r in read_arc(stream, name):
                        roller.add(_converted(r, name, targets.get(r["seq"])))
        roller.close()
        yield as_batch(roller.manifest(), fields)

    return stage(spread(manifest.sparkSession, jobs).mapInArrow(run, _MANIFEST), "warc-manifest")


def _warcinfo(name: str) -> bytes:
    block = b"software: kinweave legacy archive converter\r\nformat: WARC File Format 1.1\r\n"
    return warc_record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", warc_date(_FETCHED)),
         ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _converted(r: dict, name: str, target: dict | None) -> bytes:
    kind, block = warc_type(r), r["body"]
    fields = [("WARC-Record-ID", record_id(name, r["seq"])), ("WARC-Date", warc_date(r["date"])),
              ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"])]
    if kind == "warcinfo":
        fields = fields[:2] + [("WARC-Filename", r["url"].removeprefix("filedesc://"))]
        content = "text/plain"
    elif kind == "resource":
        content = r["type"]
        fields.append(("WARC-Payload-Digest", f"sha1:{sha1_digest(block)}"))
    else:
        head, _, payload = split_http(block)
        content = "application/http; msgtype=response"
        fields.append(("WARC-Payload-Digest", f"sha1:{sha1_digest(payload)}"))
        if target:
            kind, block = "revisit", head
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", record_id(target["to_file"], target["to_seq"])),
                       ("WARC-Refers-To-Target-URI", target["to_url"]),
                       ("WARC-Refers-To-Date", warc_date(target["to_date"]))]
    fields.append(("WARC-Block-Digest", f"sha1:{sha1_digest(block)}"))
    return warc_record([("WARC-Type", kind), *fields, ("Content-Type", content)], block)


# -- WARC ----------------------------------------------------------------------------------------


def read_warc(stream, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an open WARC file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{name}: {len(block)} bytes of {length}")
        yield fields, block


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """The responses and revisits of the listed WARC files, with digests checked against the stored bytes."""

    def work(batch):
        for name in batch.column(0).to_pylist():
            rows = {k: [] for k in ("record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "to_id")}
            with _open_gzip(folder, name) as stream:
                for fields, block in read_warc(stream, name):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, http, payload = split_http(block)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), len(payload)
                    if kind == "revisit":
                        size = int(http["content-length"])
                    elif sha1_digest(payload) != digest:
                        raise ValueError(f"{name}: the payload of {fields['warc-record-id']} does not match its digest")
                    page = http.get("x-page-id")
                    values = (fields["warc-record-id"], page and int(page), size, digest, kind, fields.get("warc-refers-to"))
                    for column, v in zip(rows.values(), values, strict=True):
                        column.append(v)
            yield rows

    schema = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, to_id string"
    return map_batches(spread(manifest.sparkSession, manifest.select("file")), work, schema)


def archive(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Pages through legacy archives into WARC files and back: one row for each page.

    page_id, payload_bytes, payload_digest, record_type and refers_to, all read from the WARC files.
    """
    spark = pages.sparkSession
    legacy, out = new_folder(spark, "arc"), new_folder(spark, "warc")
    written = convert(write_arc(pages, legacy), legacy, out, min_payload)
    records = stage(read_records(written, out), "warc-records")
    wanted = records.where("to_id is not null").select(F.col("to_id").alias("record_id")).distinct()
    held = records.select("record_id", F.col("page_id").alias("refers_to")).join(wanted, "record_id", "left_semi")
    found = left_join_unique(records, held.withColumnRenamed("record_id", "to_id"), ["to_id"])
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
