"""ARC to WARC: round trips, both versions, declared lengths, revisits."""

import base64
import hashlib
import uuid

import pytest
from helpers import prose

from corpusgauge.llm import arc
from corpusgauge.session import scratch_path, written_once

SCHEMA = "page_id long, url string, html string, file string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, "http://a.example/x", "same"), (2, "http://b.example/ y\n", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""),
    (6, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (7, "u", "\x00\x00 é \n\n"), (8, "u", prose(60_000, 1)),
    (9, "http://a.example/x", "other"), (9, "http://a.example/x", "other"), (9, "http://a.example/x", "same"), (None, "u", "same"),
]


def payload(html):
    return (html or "").encode()


def sha1(html):
    return base64.b32encode(hashlib.sha1(payload(html)).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("archive_bytes", [1, 16_000_000])
def test_pages_come_back_whole(spark, version, archive_bytes, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", archive_bytes)
    path = arc.write_arc(pages(spark, ROWS), scratch_path(spark, "arc"), version)
    got = arc.read_arc(spark, path).collect()
    assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in got) == sorted((i or 0, payload(h)) for i, _, h in ROWS)
    assert {r["version"] for r in got} == {version}
    warc = arc.write_warc(arc.with_revisits(arc.read_arc(spark, path)), scratch_path(spark, "warc"))
    back = {(r["page_id"], r["payload_digest"]): r for r in arc.read_warc(spark, warc).collect()}
    for i, _, html in ROWS:
        r = back[i, sha1(html)]
        assert r["payload_bytes"] == len(payload(html)) and r["date"] == "2026-01-01T00:00:00Z"
        first = min((j for j, _, h in ROWS if j is not None and payload(h) == payload(html)), default=None)
        assert r["record_type"] == ("response" if i == first else "revisit")
        if i != first:
            assert r["refers_to"] == back[first, sha1(html)]["record_id"] and r["payload"] is None
        else:
            assert r["refers_to"] is None and bytes(r["payload"]) == payload(html)
        assert uuid.UUID(r["record_id"][10:-1]).version == 5


def test_reruns_give_the_same_ids_and_no_pages_no_records(spark):
    ids = []
    for parts in (1, 4):
        path = arc.write_arc(pages(spark, ROWS).repartition(parts), scratch_path(spark, "arc"))
        ids.append(sorted(r["record_id"] for r in arc.read_arc(spark, path).where("page_id is not null").collect()))
    assert ids[0] == ids[1]
    path = arc.write_arc(pages(spark, []), scratch_path(spark, "arc"))
    warc = arc.write_warc(arc.with_revisits(arc.read_arc(spark, path)), scratch_path(spark, "warc"))
    assert arc.read_warc(spark, warc).collect() == []


def test_least_bytes_leaves_small_payloads_alone(spark):
    path = arc.write_arc(pages(spark, ROWS), scratch_path(spark, "arc"))
    rows = arc.with_revisits(written_once(arc.read_arc(spark, path)), least_bytes=1_000)
    assert rows.where("refers_to is not null").count() == 0


def test_header_lines_are_read_by_their_version():
    opening = arc.gzip_member(arc.arc_opening(2, "x.arc"))
    body = b"no status line\n\nrest"
    line = arc.arc_header(2, "gopher://h/a b", "10.0.0.1", "19990102", "text/plain", 404, len(body), "x.arc")
    (_, version, header, content), = arc.arc_records(opening + b"\x00" + arc.gzip_member(line + body + b"\n") + b"\x00")
    assert (version, header["Result-code"], header["Archive-date"], content) == (2, "404", "19990102", body)
    assert arc.http_parts(content) == (None, b"", body)
    assert arc.warc_date("19990102") == "1999-01-02T00:00:00Z" and arc.warc_date("x") == "1970-01-01T00:00:00Z"
    record = arc.warc_record({
        "refers_to": None, "headers": b"", "payload": body, "status": None, "record_id": "<urn:uuid:1>", "date": "19990102", "url": "gopher://h/a%20b",
        "ip": "10.0.0.1", "payload_digest": arc.base32_sha1(body), "content_type": "text/plain",
    })
    fields, block = arc.warc_fields(record)
    assert fields["warc-type"] == "resource" and block == body and fields["content-type"] == "text/plain"


@pytest.mark.parametrize("change", [lambda b: b[:-3], lambda b: b + b"more"])
def test_a_wrong_length_is_an_error(change):
    opening = arc.gzip_member(arc.arc_opening(1, "x.arc"))
    line = arc.arc_header(1, "u", "10.0.0.1", "19990102", "text/plain", 200, 10, "x.arc")
    with pytest.raises(ValueError, match="declared 10"):
        list(arc.arc_records(opening + arc.gzip_member(change(line + b"0123456789\n"))))


def test_a_cut_archive_is_an_error():
    data = arc.gzip_member(arc.arc_opening(1, "x.arc"))
    with pytest.raises(ValueError, match="ends inside"):
        list(arc.arc_records(data[:-5]))
    with pytest.raises(ValueError, match="version block"):
        list(arc.arc_records(arc.gzip_member(b"filedesc://x\n7 0 me\nURL\n\n")))
