"""Writing and reading WARC archives compressed with a dictionary of their own.

Each archive starts with a skippable frame that holds a Zstandard dictionary
built from its first records; every record follows as a frame of its own, so it
can be read alone given the dictionary. Tasks roll to a new archive at a target
size and hand back what they wrote; only archives named in that stored manifest
count, so the files of lost or repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import picked, shared_folder, sliced, stage
from recordloom.sources.splits import dealt

#: Fixed values of the format: the skippable frame that carries a dictionary,
#: the frame that carries data, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
DATA_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ── Records ──────────────────────────────────────────────────────────


def record_bytes(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record is cut short")
    return fields, rest[:size]


def page_record(row: dict, run: uuid.UUID, date: str) -> bytes:
    """The record of a judged page; a revisit holds no payload but tells the
    digest and size of the whole one.

    The record id follows from the run and the page's id where that is the id of
    one row, so that a revisit can name it; else it is a random one. The page ids
    themselves stand in fields of this writer (``Page-*``), which others skip.
    """
    page, target, url = row["page_id"], row["refers_to"], row["url"]
    plain = page is not None and not row["many"]
    fields = {
        "WARC-Record-ID": _address(run, page) if plain else f"<{uuid.uuid4().urn}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "Page-Payload-Length": str(row["payload_bytes"]),
    }
    if page is not None:
        fields["Page-ID"] = str(page)
    if url is not None:
        # A header is one line: line breaks are written in percent form, and the url
        # as it is beside it. Nothing else of a url is changed.
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
        if fields["WARC-Target-URI"] != url or url != url.strip():
            fields["Page-URL-Base64"] = base64.b64encode(url.encode()).decode()
    fields["Content-Type"] = "application/http; msgtype=response"
    if target is None:
        return record_bytes("response", fields, HTTP + (row["payload"] or b""))
    fields |= {"Page-Refers-To": str(target), "WARC-Profile": PROFILE}
    if not row["target_many"]:
        fields["WARC-Refers-To"] = _address(run, target)
    return record_bytes("revisit", fields, HTTP)


def _address(run: uuid.UUID, page: int) -> str:
    return f"<{uuid.uuid5(run, str(page)).urn}>"


# ── Archives ─────────────────────────────────────────────────────────


def _filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    if address.startswith("file:"):
        address = "file:///" + address.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(address)


def train_dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary of the records; too few or too small ones give their own
    bytes, which serve as a plain dictionary."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


class Archive:
    """An archive being written. Records wait until there are enough for the
    dictionary; after that each is compressed and written on its own."""

    def __init__(self, folder: str, dictionary_bytes: int, sample_bytes: int, level: int):
        self.system, root = _filesystem(folder)
        self.path = posixpath.join(root, f"{uuid.uuid4().hex}.warc.zst")
        self.limits = dictionary_bytes, sample_bytes, level
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.records = 0
        self.out = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is not None:
            self._write(self.frames.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= self.limits[1]:
            self._start()

    def _start(self) -> None:
        dictionary_bytes, _, level = self.limits
        raw = train_dictionary(self.waiting, dictionary_bytes)
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw))
        self.out = self.system.open_output_stream(self.path, compression=None)
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        for record in self.waiting:
            self._write(self.frames.compress(record))
        self.waiting = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            self._start()
        self.out.close()


def read_archive(address: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    system, path = _filesystem(address)
    with system.open_input_file(path) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError("no dictionary in front")
        frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file.read(size)))
        held = b""
        while True:
            if held:
                unit = frames.decompressobj()
                out = unit.decompress(held)
                while not unit.eof:
                    more = file.read(1 << 16)
                    if not more:
                        raise ValueError("an archive is cut short")
                    out += unit.decompress(more)
                yield out
                held = unit.unused_data
            if not held:
                held = file.read(1 << 16)
                if not held:
                    return


# ── Jobs ─────────────────────────────────────────────────────────────


def judged(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """Pages with their payload, the page each one revisits, if any, and whether its
    own id and that page's are ids of several rows."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = picked(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    key = [F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("size")]
    digests = stage(rows.select("page_id", *key), "payloads")
    shared = stage(
        digests.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(
            F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared")
    # Only pages that revisit another one, or share an id; all sides are stored, so AQE can split a common payload.
    key = ["page_id", "sha", "size"]
    again = digests.join(shared, ["sha", "size"]).filter("page_id <> refers_to").distinct()
    many = stage(digests.filter("page_id is not null").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("page_id"), "many")
    own = digests.join(many, "page_id", "left_semi").distinct().withColumn("many", F.lit(True))
    target = many.select(F.col("page_id").alias("refers_to"), F.lit(True).alias("target_many"))
    marks = stage(again.join(target, "refers_to", "left").join(own, key, "full"), "again")
    none = F.lit(False)
    return rows.select("*", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("size")).join(
        marks, key, "left").select("page_id", "url", "payload", "refers_to", F.coalesce("many", none).alias("many"),
                                   F.coalesce("target_many", none).alias("target_many"))


def write_archives(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, archive_bytes: int = 64 << 20, dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 4 << 20, level: int = 3,
) -> DataFrame:
    """Write a record per page to archives in a shared folder; returns the stored
    manifest ``path, records, bytes``.

    The payload is the html in UTF-8, null counting as empty. Of pages with equal
    payloads of at least ``least_bytes``, the one with the largest id is the
    response and the others revisit it; a page without an id is always a
    response. Rows that repeat id and payload are all written, each under a record
    id of its own. A very long payload is one record in memory. An empty table
    writes no archive. Other columns are not looked at.
    """
    address = folder or shared_folder(pages.sparkSession, "archives")
    system, root = _filesystem(address)
    system.create_dir(root, recursive=True)
    scheme = address.partition("://")[0] if "://" in address else "file"

    run = uuid.uuid4()
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None

        def done() -> pa.RecordBatch:
            archive.close()
            place = f"file://{archive.path}" if scheme.startswith("file") else f"{address}/{posixpath.basename(archive.path)}"
            return pa.RecordBatch.from_pydict({
                "path": [place], "records": pa.array([archive.records], pa.int64()),
                "bytes": pa.array([archive.size], pa.int64())})

        for batch in sliced(batches, 32):
            for row in batch.to_pylist():
                body = row["payload"] or b""
                row |= {"payload_digest": base32_sha1(body), "payload_bytes": len(body)}
                archive = archive or Archive(address, dictionary_bytes, sample_bytes, level)
                archive.add(page_record(row, run, date))
                if archive.size >= archive_bytes:
                    yield done()
                    archive = None
        if archive is not None:
            yield done()

    rows = judged(pages, page_id, url, html, least_bytes)
    return stage(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to`` and, if asked, ``payload`` (null for
    revisits). A response whose payload does not have the stated digest and size
    is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                size = 0
                for data in read_archive(path):
                    rows.append(_row(data, with_payload))
                    size += len(data) if with_payload else 256
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if with_payload:
        fields.append(("payload", pa.binary()))
        ddl += ", payload binary"
    schema = pa.schema(fields)
    return dealt(manifest.select("path", "bytes"), "bytes").mapInArrow(read, ddl)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _row(data: bytes, with_payload: bool) -> dict:
    fields, block = parse_record(data)
    exact = fields.get("Page-URL-Base64")
    row = {
        "page_id": _number(fields.get("Page-ID")),
        "url": fields.get("WARC-Target-URI") if exact is None else base64.b64decode(exact).decode(),
        "payload_bytes": int(fields["Page-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": _number(fields.get("Page-Refers-To")),
    }
    if row["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (base32_sha1(payload), len(payload)) != (row["payload_digest"], row["payload_bytes"]):
            raise ValueError(f"page {row['page_id']}: the payload is not the one that was written")
        if with_payload:
            row["payload"] = payload
    return row
