"""Archives: exact round trips, revisits, other writers' files, and predicates before payloads."""

import base64
import gzip
import hashlib

import pytest

from strandline.llm import warc


def plain(rows, least=0):
    of = lambda html: (html or "").encode()
    first = {}
    for page, html in rows:
        if page is not None:
            first[of(html)] = min(first.get(of(html), page), page)
    out = []
    for page, html in rows:
        data = of(html)
        again = len(data) >= least and data in first and page != first[data]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_pages_of_all_kinds(spark, least):
    html = ["<p>one</p>", "", None, "<p>one</p>", "é" * 9, "\r\n\r\nx", "x" * 700_000, "<p>one</p>", "é" * 9, "short", "short", "\0\x01"]
    rows = [(i, h) for i, h in enumerate(html)] + [(0, "<p>one</p>"), (None, "short"), (None, "alone"), (-5, "x" * 700_000)]
    urls = ["http://a/b", None, "http://x/ü ?\r\nWARC-Type: evil"]
    df = spark.createDataFrame([(p, urls[k % 3], h, 1) for k, (p, h) in enumerate(rows)], "page_id long, url string, html string, record_type int")
    got = warc.archived_pages(df.repartition(2), least=least).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, least)
    assert warc.archived_pages(df.limit(0)).count() == 0


def foreign(kind, target, body, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: {target}\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_files_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 4\r\n\r\nbody"
    kind = "Content-Type: application/http;\r\n msgtype=response\r\n"
    records = [foreign("warcinfo", "-", b"a: b\r\n"), foreign("response", "http://a/1", http, kind), foreign("resource", "http://a/2", b"\0" * 600_000), foreign("request", "http://b/3", b"GET")]
    (tmp_path / "p.warc").write_bytes(b"".join(records))
    (tmp_path / "q.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "r.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    (tmp_path / "_left.warc.gz").write_bytes(b"junk")
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}")
    assert df.count() == 12
    rows = df.where("record_type = 'response' and target_uri like 'http://a/%'").collect()
    assert [(bytes(r.payload), r.http_length, r.headers["warc-type"]) for r in rows] == [(b"body", 4, "response")] * 3
    assert {r.offset for r in rows} and len({r.file for r in rows}) == 3
    assert {len(r.payload) for r in df.where("record_type = 'resource'").collect()} == {600_000}
    assert df.where("record_type in ('request', 'warcinfo')").count() == 6
    lean = spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}")
    assert lean.where("payload is not null").count() == 0


class Counting:
    """A source that remembers how many bytes were read."""

    def __init__(self, data):
        self.data, self.place, self.read_bytes = data, 0, 0

    def size(self):
        return len(self.data)

    def seek(self, place):
        self.place = place

    def read(self, n):
        out = self.data[self.place : self.place + n]
        self.place += len(out)
        self.read_bytes += len(out)
        return out


def test_unwanted_payloads_are_not_read():
    import random

    body = random.Random(1).randbytes(3 << 20)
    records = [foreign("resource", "u", body), foreign("request", "v", b"x")]
    for data, reader in ((b"".join(map(warc.member, records)), warc._Members), (b"".join(records), warc._Plain)):
        source = Counting(data)
        assert [h["warc-type"] for _, h, _ in reader(source)] == ["resource", "request"]
        assert source.read_bytes < 1 << 20
    assert gzip.decompress(warc.member(b"data")) == b"data"


def test_filters_that_are_pushed():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader("file:///nowhere", True)
    pushed = [EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b"))]
    rest = [GreaterThan(("content_length",), 5), EqualTo(("headers", "x"), "y")]
    assert list(reader.pushFilters([*pushed, *rest])) == rest and reader.filters == pushed
    assert reader._wanted({"warc-type": "response", "warc-target-uri": "b"})
    assert not reader._wanted({"warc-type": "revisit", "warc-target-uri": "b"}) and not reader._wanted({"warc-type": "response"})
