"""Archives read by an independent parser, and records shared out by their size."""

import gzip
import hashlib
import os
import re
from urllib.parse import quote

import pytest

from vecloop.llm import warc
from vecloop.session import fresh_path

BIG = "<p>ä</p>" * 200
PAGES = [
    (1, "http://b.example.org/x?y=1", BIG),
    (7, "https://a.example.org:8080/", BIG),
    (7, "https://a.example.org:8080/", BIG),
    (3, None, None),
    (None, "http://n.example/", BIG),
    (5, "http://c.example/ü", "small\r\n\r\nbody"),
]


def members(folder):
    """Every record of every archive: its headers and block, by the rules of the format alone."""
    for name in os.listdir(folder):
        if not name.startswith("pages"):
            continue
        with gzip.open(f"{folder}/{name}") as file:
            data = file.read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = {k.lower(): v for k, v in (re.fullmatch(r"([!-9;-~]+):[ \t]*(.*)", line).groups() for line in lines)}
            assert version == "WARC/1.1" and len(fields) == len(lines)
            size = int(fields["content-length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            yield fields, rest[:size]
            data = rest[size + 4 :]


def test_records_are_valid(spark):
    folder = fresh_path(spark, "warc")
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    warc.write_archives(df, folder, date="2024-05-06T07:08:09Z")
    found = list(members(folder))
    assert len(found) == len(PAGES)
    assert len({f["warc-record-id"] for f, _ in found}) == len(PAGES)
    for fields, block in found:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"])
        assert fields["warc-date"] == "2024-05-06T07:08:09Z" and fields["warc-type"] in ("response", "revisit")
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200")
        if fields["warc-type"] == "revisit":
            assert not payload and fields["warc-refers-to-target-uri"] == "https://a.example.org:8080/"
            assert fields["warc-payload-digest"] == "sha1:" + hashlib.sha1(BIG.encode()).hexdigest()
        else:
            assert fields["warc-payload-digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
    bodies = sorted((f["x-page-id"], f["warc-target-uri"], f["warc-type"]) for f, _ in found)
    uri = lambda u: quote(u or "", safe="".join(map(chr, range(33, 127))))
    kind = lambda i, h: "response" if h != BIG or i == 7 else "revisit"
    assert bodies == sorted((str("" if i is None else i), uri(u), kind(i, h)) for i, u, h in PAGES)


@pytest.mark.parametrize("task_bytes", [40, 1 << 22])
def test_records_are_read_by_tasks_of_a_size(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(warc, "TASK_BYTES", task_bytes)
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://h', id % 7, '.example/', id) AS url", "repeat(sha2(string(id), 256), 9) AS html")
    found = warc.archive_round_trip(spark, pages)
    partitions = found.rdd.getNumPartitions()
    assert partitions > 20 if task_bytes == 40 else partitions == 1
    rows = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in found.collect()}
    body = lambda i: hashlib.sha256(str(i).encode()).hexdigest().encode() * 9
    assert rows == {i: (576, hashlib.sha1(body(i)).hexdigest(), "response") for i in range(60)}
