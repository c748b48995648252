"""WARC records in ZIP packages: written by tasks, read back record by record without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj`` (one JSON line per record
with its offset and length), both stored, not compressed, so a record is one range of the package.
The reader finds the members through the (ZIP64) central directory and then reads the ranges that the index names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm import zipread
from procurelake.session import scratch_path, staged

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_BYTES = 0
PACKAGE_BYTES = 64 << 20
PACKAGE_RECORDS = 20_000
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
PACKAGES = "package string, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DIGESTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    """A header value: line breaks and other control characters as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page: int | None, url: str | None, kind: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}:{url}')}>",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Payload-Length: {size}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page is not None:
        head.append(f"Page-Id: {page}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {_REVISIT}")
        if refers is not None:
            head.append(f"Refers-To-Page-Id: {refers}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise zipread.BadPackage("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class _Package:
    """Writes one package; the index is kept until the archive member is closed."""

    def __init__(self, files, path: str) -> None:
        self.path, self.records, self.at, self.index = path, 0, 0, []
        self.stream = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, page, url, kind, digest, size, refers, payload: bytes) -> None:
        data = _gzip(record_bytes(page, url, kind, digest, size, refers, payload))
        self.member.write(data)
        self.index.append(json.dumps({"url": url, "page": page, "offset": self.at, "length": len(data)}, ensure_ascii=False))
        self.at += len(data)
        self.records += 1

    def full(self, records: int) -> bool:
        return self.at >= PACKAGE_BYTES or self.records >= records

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(line + "\n" for line in self.index))
        self.zip.close()
        self.stream.close()
        return self.path, self.records


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _optional(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def _write(target: str, records: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = _files(target)
        task = TaskContext.get()
        # a repeated attempt writes files of its own; only those that a finished task names are read
        stem = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        package, done = None, []
        for batch in batches:
            for page, url, html, sha1, size, kind, refers in batch.itertuples(index=False, name=None):
                payload = (html or "").encode("utf-8", "surrogatepass") if kind == "response" else b""
                if kind == "response" and hashlib.sha1(payload).hexdigest() != sha1:
                    raise ValueError("the rows of the pages changed between two reads")
                package = package or _Package(files, f"{stem}-{len(done)}.zip")
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                package.add(_optional(page), url, kind, digest, int(size), _optional(refers), payload)
                if package.full(records):
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pd.DataFrame([(target.rstrip("/") + "/" + path.rsplit("/", 1)[1], count) for path, count in done], columns=["package", "records"])

    return work


def record_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` as ``_row, page_id, url, sha1, size, kind, refers_to``, without payloads.

    Of equal payloads the row with the smallest page_id is the response, among equal page_ids that
    with the smallest url, among equal rows the first one; null page_ids come last. The smallest is an
    aggregate that combines before the shuffle, and joins back one row per payload.
    """
    payload = F.coalesce("html", F.lit(""))
    slim = pages.select("_row", "page_id", "url", F.sha1(F.encode(payload, "utf-8")).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("m"), "url", "_row")
    first = slim.where(F.col("size") >= least).groupBy("sha1").agg(F.min(order).alias("first"))
    joined = slim.join(first, "sha1", "left")
    revisit = F.coalesce(F.col("first._row") != F.col("_row"), F.lit(False)) & (F.col("size") >= least)
    return joined.select(
        "_row", "page_id", "url", "sha1", "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, target: str, least: int = LEAST_BYTES, records: int = PACKAGE_RECORDS) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) below ``target``; returns the packages (``package``, ``records``).

    A package is closed at ``records`` records or 64 MiB; a page has one record, so none is left out.

    A null html is an empty payload; a null page_id or url leaves its header out; repeated rows are one response and
    revisits; an empty table writes no package; further columns are ignored. ``pages`` is read twice and must give
    the same rows in the same order, as a table of files does; a task that sees another payload fails.
    Only responses carry their html through a shuffle, by a row number that no row shares.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", "html")
    types = staged(record_types(rows, least), "types")
    responses = types.where("kind = 'response'").join(rows.select("_row", "html"), "_row")
    revisits = types.where("kind = 'revisit'").withColumn("html", F.lit(None).cast("string"))
    columns = ["page_id", "url", "html", "sha1", "size", "kind", "refers_to"]
    both = responses.select(columns).union(revisits.select(columns))
    return staged(both.mapInPandas(_write(_uri(target), records), PACKAGES), "packages")


def package_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a package, each read as one range."""
    files, name = _files(path)
    with files.open_input_file(name) as file:
        found = zipread.members(file, file.size())
        index, archive = found[INDEX], found[ARCHIVE]
        lines = zipread.read_range(file, zipread.data_start(file, index), index.size)
        start = zipread.data_start(file, archive)
        for line in lines.decode().split("\n"):
            if line:
                entry = json.loads(line)
                data = zipread.read_range(file, start + entry["offset"], entry["length"])
                yield parse_record(zlib.decompress(data, 31))


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the packages, as in ``RECORDS``, or without payloads as in ``DIGESTS``.

    The digest of a response is computed again from what was read; a payload that doesn't
    match its header fails the job. A revisit gives the digest and length that its header has.
    """

    def number(fields, name):
        return int(fields[name]) if name in fields else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["package"]:
                rows = []
                for fields, payload in package_records(path):
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != number(fields, "payload-length")):
                        raise zipread.BadPackage(f"payload and digest differ in {path}")
                    row = (number(fields, "page-id"), number(fields, "payload-length"), digest, kind, number(fields, "refers-to-page-id"))
                    rows.append((row[0], fields.get("warc-target-uri"), *row[1:], payload if kind == "response" else None) if payloads else row)
                    if len(rows) >= 500:
                        yield _frame(rows, payloads)
                        rows = []
                yield _frame(rows, payloads)

    spread = packages.repartition(max(1, packages.count()))  # one package a task
    return spread.mapInPandas(work, RECORDS if payloads else DIGESTS)


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    names = [part.split()[0] for part in (RECORDS if payloads else DIGESTS).split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to the shared folder and read back ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    target = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, target, least), payloads=False)
