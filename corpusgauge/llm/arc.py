r"""ARC archives, and their conversion to WARC.

An archive is a run of gzip members, one per record, in a file of bounded size.  Executors build
records in Arrow batches and Spark's text writer puts one archive, one row, into each file, so
files are committed with the task and lost executors leave nothing behind.  The writer ends a
row with a line separator; here that is a zero byte, which gzip allows as padding.

ARC (version 1 and 2): the first record, ``filedesc://``, has the version on its second line (``1 0 origin``)
and on the third the names of the fields in each header line:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

A header line is read by that list, from the right, as an URL may hold spaces.  The content has the
declared length whatever is in it; a newline follows.  A file whose records disagree with their
declared lengths raises an error that names the file and the offset.

A WARC record gets from its ARC record: ``WARC-Date`` from the 14-digit date (missing digits count as
the earliest, an unreadable date as 1970), ``WARC-Type`` from the protocol and content
type (response when there is an HTTP status line, resource otherwise; revisit for later records of a
known payload; repeated rows, with equal id, url and payload, are one record, which stays a response), base32 SHA-1 digests of the payload and the block, and a ``WARC-Record-ID`` that is a
name-based UUID of the archive date, the URL and the record's own id, so a rerun gives the same.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.llm.common import table
from corpusgauge.session import scratch_path, written_once

ARCHIVE_BYTES = 16_000_000
GZIP_LEVEL = 4
#: Compressed bytes handed on at a time; what a member leaves of them is copied.
PIECE = 8_192
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Namespace of the synthesised record ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "file string, offset long, version int, url string, ip string, date string, content_type string, status int, "
    "headers binary, payload binary, payload_digest string, record_id string, page_id long"
)


# bytes of single records: small helpers without Spark


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Members:
    """Reads through the gzip members of an archive, holding one member's output at a time."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < len(self.data):
            if self.data[self.at] == 0:  # padding
                self.at += 1
                continue
            opener = zlib.decompressobj(31)
            start, parts = self.at, []
            while not opener.eof:
                piece = self.data[self.at : self.at + PIECE]
                if not piece:
                    raise ValueError(f"archive ends inside the record at {start}")
                parts.append(opener.decompress(piece))
                self.at += len(piece) - len(opener.unused_data)
            yield start, b"".join(parts)


def arc_header(version: int, url: str, ip: str, date: str, kind: str, status: int, length: int, name: str) -> bytes:
    values = {
        "URL": re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 128 else "%20", url) or "-",
        "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": str(status), "Checksum": "-",
        "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(length),
    }
    return " ".join(values[f] for f in FIELDS[version].split()).encode() + b"\n"


def arc_opening(version: int, name: str) -> bytes:
    """The version block that opens an archive; its fields are those of version 1 or 2."""
    body = f"{version} 0 corpusgauge\n{FIELDS[version]}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", "19700101000000", "text/plain", 200, len(body), name) + body


def arc_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, version, header fields, content) of each record after the version block."""
    version, names = 0, []
    for offset, raw in Members(data):
        line, _, rest = raw.partition(b"\n")
        if not version:
            number, _, fields = rest.partition(b"\n")
            version = int(number.split()[0])
            names = fields.partition(b"\n")[0].decode().split()
            if names != FIELDS.get(version, "").split():
                raise ValueError(f"unknown ARC version block {raw[:200]!r}")
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"offset {offset}: {len(values)} of {len(names)} header fields")
        header = dict(zip(names, values, strict=True))
        length = int(header["Archive-length"])
        if rest[length:] != b"\n":
            raise ValueError(f"offset {offset}: content of {len(rest) - 1} bytes, declared {length}")
        yield offset, version, header, rest[:length]


def http_parts(content: bytes) -> tuple[int | None, bytes, bytes]:
    """Status, header block and payload; without a status line all is payload."""
    if not content.startswith(b"HTTP/"):
        return None, b"", content
    head, gap, payload = content.partition(b"\r\n\r\n")
    found = re.match(rb"HTTP/\S+ (\d{3})", head)
    return int(found[1]) if found else None, head + gap, payload


def http_field(headers: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + name.encode() + rb":[ \t]*([^\r\n]*)", headers)
    return found[1].decode() if found else None


def warc_date(date: str) -> str:
    """``YYYYMMDDhhmmss``, or its first digits, as an ISO date."""
    found = re.fullmatch(r"(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?\d*", date or "")
    y, mo, d, h, mi, s = (found or re.match(r"(1970)()()()()()", "1970")).groups()
    return f"{y}-{mo or '01'}-{d or '01'}T{h or '00'}:{mi or '00'}:{s or '00'}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(map(str, parts)))}>"


def warc_record(row: dict) -> bytes:
    """The bytes of one WARC record from a converted ARC record; payload left out of revisits."""
    revisit = row["refers_to"] is not None
    headers, payload = row["headers"] or b"", b"" if revisit else row["payload"] or b""
    block = headers + payload
    http = row["status"] is not None
    kind = "revisit" if revisit else "response" if http else "resource"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", warc_date(row["date"])),
        ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", row["refers_to"])]
    fields += [
        ("Content-Type", "application/http; msgtype=response" if http else row["content_type"]),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def warc_fields(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block of the declared length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"broken WARC record {head[:200]!r}")
    return fields, rest[:length]


# archives in Spark


def rows_in(batches) -> Iterator[dict]:
    """Rows one at a time, however large the batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows with a ``payload`` in batches of a bounded number of rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row["payload"] or b"")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def archived(records: Iterator[bytes], opening: bytes = b"") -> Iterator[pa.RecordBatch]:
    """Rows of one archive each, closed when it reaches the size."""
    held, size = [], 0
    for record in records:
        member = gzip_member(record)
        held.append(member)
        size += len(member)
        if size >= ARCHIVE_BYTES:
            yield pa.record_batch({"archive": pa.array([opening + b"".join(held)], pa.binary())})
            held, size = [], 0
    if held:
        yield pa.record_batch({"archive": pa.array([opening + b"".join(held)], pa.binary())})


def write_archives(archives: DataFrame, path: str) -> str:
    """One file per row of ``archive``; nothing but a zero byte is added."""
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\x00").option(
        "maxRecordsPerFile", 1
    ).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive; a folder without any gives no rows."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20260101000000") -> str:
    """Pages (page_id, url, html) as ARC captures, status 200; null html is an empty payload.

    The page's id travels in the HTTP header ``X-Page-Id``; a null url becomes ``-``.
    """

    def build(batches):
        def records():
            for row in rows_in(batches):
                payload = (row["html"] or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                mark = "" if row["page_id"] is None else f"X-Page-Id: {row['page_id']}\r\n"
                content = (head + mark + "\r\n").encode() + payload
                yield arc_header(version, row["url"] or "-", "192.0.2.1", date, "text/html", 200, len(content), "pages.arc") + content + b"\n"

        return archived(records(), gzip_member(arc_opening(version, "pages.arc")))

    return write_archives(pages.select("page_id", "url", "html").mapInArrow(build, "archive binary"), path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record, columns of ``RECORD``; the id of a record without one is null."""

    def rows(batches):
        for archive in rows_in(batches):
            try:
                for offset, version, header, content in arc_records(archive["content"]):
                    status, headers, payload = http_parts(content)
                    mark = http_field(headers, "X-Page-Id")
                    name = archive["path"].rsplit("/", 1)[-1]
                    own, digest = mark if mark is not None else f"{name}:{offset}", base32_sha1(payload)
                    yield {
                        "file": name, "offset": offset, "version": version, "url": header["URL"], "ip": header["IP-address"],
                        "date": header["Archive-date"], "content_type": header["Content-type"], "status": status,
                        "headers": headers, "payload": payload, "payload_digest": digest,
                        "record_id": record_id(header["Archive-date"], header["URL"], own, digest),
                        "page_id": None if mark is None else int(mark),
                    }
            except (ValueError, zlib.error) as e:
                raise ValueError(f"{archive['path']}: {e}") from e

    arrow = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()),
        ("date", pa.string()), ("content_type", pa.string()), ("status", pa.int32()), ("headers", pa.binary()),
        ("payload", pa.binary()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()),
    ])
    return read_archives(spark, path).mapInArrow(lambda batches: batched(rows(batches), arrow), RECORD)


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``refers_to``: the record id of the first record with the same payload.

    First is the smallest (page_id, date, url, record_id), nulls last; it and payloads of fewer than ``least_bytes`` bytes get
    null.  Only (digest, id) rows are compared, a digest's rows spread over tasks; payloads are
    joined to the revisits found by their own record id, never by a hot digest.
    """
    marked = written_once(records.where(F.octet_length("payload") >= least_bytes).select(
        "payload_digest", "record_id",
        F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "date", "url", "record_id").alias("_order"),
    ))
    firsts = marked.groupBy("payload_digest").agg(
        F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1").select("payload_digest", F.col("_first.record_id").alias("refers_to"))
    revisits = (
        spread_join(marked.drop("_order"), firsts, ["payload_digest"], "inner", spread_by=["record_id"])
        .where("record_id <> refers_to").select("record_id", "refers_to").distinct()
    )
    return records.join(broadcast_if_small(written_once(revisits)), "record_id", "left")


def write_warc(records: DataFrame, path: str) -> str:
    """Converted records, columns of ``RECORD`` and refers_to, as WARC archives."""

    def build(batches):
        return archived(warc_record(row) for row in rows_in(batches))

    needed = ["record_id", "refers_to", "url", "ip", "date", "content_type", "status", "headers", "payload", "payload_digest"]
    return write_archives(records.select(*needed).mapInArrow(build, "archive binary"), path)


WARC = (
    "record_type string, record_id string, refers_to string, url string, date string, payload_digest string, "
    "block_digest string, payload_bytes long, payload binary, page_id long"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per WARC record.  ``payload_bytes`` is the length of the full payload, also for revisits
    (from the HTTP headers they keep).  A digest that the block or payload doesn't have raises an error.
    """
    names = [x.split()[0] for x in WARC.split(", ")]

    def rows(batches):
        for archive in rows_in(batches):
            for offset, raw in Members(archive["content"]):
                fields, block = warc_fields(raw)
                status, headers, payload = http_parts(block) if "application/http" in fields["content-type"] else (None, b"", block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or not revisit and digest != base32_sha1(payload):
                    raise ValueError(f"{archive['path']}, offset {offset}: digests do not match")
                length, mark = http_field(headers, "Content-Length"), http_field(headers, "X-Page-Id")
                values = [
                    fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"],
                    fields["warc-date"], digest, fields["warc-block-digest"].removeprefix("sha1:"),
                    int(length) if revisit and length else len(payload), payload if payloads and not revisit else None,
                    None if mark is None else int(mark),
                ]
                yield dict(zip(names, values, strict=True))

    arrow = pa.schema([
        (n, pa.binary() if n == "payload" else pa.int64() if n in ("payload_bytes", "page_id") else pa.string()) for n in names
    ])
    return read_archives(spark, path).mapInArrow(lambda batches: batched(rows(batches), arrow), WARC)


def op2_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through ARC archives into WARC archives, and what these hold."""
    arc = write_arc(table(spark, sf_dir, "pages"), scratch_path(spark, "arc"))
    warc = write_warc(with_revisits(read_arc(spark, arc)), scratch_path(spark, "warc"))
    rows = written_once(read_warc(spark, warc, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to"
    ))
    targets = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_to")).distinct()
    later = rows.where("record_type = 'revisit'")
    found = spread_join(later, targets, ["refers_to"], "inner", spread_by=["record_id"])
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return rows.where("record_type <> 'revisit'").select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select(*out, F.col("_to").alias("refers_to"))
    )


def arc_to_warc_sql() -> str:
    return """
    WITH hashed AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    digests AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM hashed),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM digests)
    SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast((cast('0x' || substr(h, cast(i // 4 * 5 + 1 AS integer), 5) AS bigint) >> (15 - 5 * (i % 4))) & 31 AS integer) + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM firsts
    """
