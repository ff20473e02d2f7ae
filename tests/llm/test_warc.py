import gzip
import hashlib
import io
import zlib
from base64 import b32encode

import pytest

from corpuslab.llm import warc
from corpuslab.llm.queries import QUERIES, SQL_WARC
from corpuslab.operators import joins
from corpuslab.session import scratch_path
from tests.compare import differences, oracle

SCHEMA = "page_id bigint, url string, html string"
ODD = [
    (5, "http://a/x y\r\nz", "<p>same</p>"), (3, "http://b/é", "<p>same</p>"), (9, None, "<p>same</p>"),
    (4, "http://c", None), (2, "http://d", ""), (8, "", " "), (None, "http://e", "<p>same</p>"),
    (None, "http://f", "no id"), (None, "http://g", "no id"), (7, "http://h", "line\r\n\r\nline\n" * 3),
    (6, "http://i", "wörd " * 60000), (3, "http://b/é", "<p>same</p>"), (1, "http://j", "HTTP/1.1 200 OK\r\n\r\n"),
]


def sha1(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    smallest = {}
    for page, _, html in rows:
        if page is not None:
            smallest[html or ""] = min(smallest.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = smallest.get(html or "") if len(body) >= least else None
        again = first is not None and page != first
        out.append((page, len(body), sha1(body), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def written(spark, rows, **settings):
    path = scratch_path(spark, "archives")
    warc.write(spark.createDataFrame(rows, SCHEMA), path, **settings)
    return path


def read_back(spark, path):
    return sorted(((r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type,
                    r.refers_to and int(r.refers_to)) for r in warc.read(spark, path).collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    frame = QUERIES["op11_warc_archives"][0](spark, folder)
    assert differences("op11", frame, oracle(folder), SQL_WARC) == []


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_odd_pages(spark, least):
    assert read_back(spark, written(spark, ODD, least_bytes=least)) == expected(ODD, least)


def test_wide_table_of_repeats_is_joined_by_shuffle(spark, monkeypatch):
    rows = [(k, "u", "hot" if k % 3 else f"text {k % 20}") for k in range(300)]
    original = joins.lookup_join
    monkeypatch.setattr(warc, "lookup_join", lambda *a, **k: original(*a, **k, broadcast_bytes=0))
    assert read_back(spark, written(spark, rows)) == expected(rows)


def test_empty_table(spark):
    assert read_back(spark, written(spark, [])) == []


def test_archives_are_gzip_files_with_whole_payloads(spark, tmp_path):
    path = written(spark, ODD, archive_bytes=2000)
    found = spark.read.format("binaryFile").load(path).collect()
    assert len(found) > 1
    text = b"".join(gzip.decompress(bytes(f.content)) for f in found)
    assert text.count(b"WARC/1.1\r\n") == len(ODD)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read(spark, path, payload=True).collect() if r.payload is not None}
    assert payloads["6"].decode() == "wörd " * 60000 and payloads["7"] == b"line\r\n\r\nline\n" * 3
    assert payloads["2"] == b"" and "5" not in payloads and payloads["3"] == b"<p>same</p>"


def test_one_member_per_record():
    data = warc.member("1", "http://a", b"one", sha1(b"one"), None) + warc.member("2", None, b"one", sha1(b"one"), "1")
    members = 0
    while data:
        unpack = zlib.decompressobj(31)
        text = unpack.decompress(data)
        assert unpack.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        members, data = members + 1, unpack.unused_data
    assert members == 2


class Trickle(io.RawIOBase):
    """A source that gives a few bytes at a time."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n=-1):
        part = self.data[self.at:self.at + 3]
        self.at += len(part)
        return part


def one(payload=b"<p>x</p>" * 30000, digest=None):
    return warc.member("1", "http://a", payload, digest or sha1(payload), None)


def test_reader_takes_small_pieces():
    data = one() + gzip.compress(b"") + one(b"")
    got = [(r.payload, r.payload_bytes) for r in warc.records(Trickle(data))]
    assert got == [(b"<p>x</p>" * 30000, 240000), (b"", 0)]
    assert [r.payload for r in warc.records(io.BytesIO(data), keep=False)] == [None, None]


def packed(text: bytes) -> bytes:
    return gzip.compress(text)


@pytest.mark.parametrize("data, message", [
    (one()[:-20], "ends inside"),
    (one()[:200] + b"\x00\x00" + one()[202:], "broken gzip|digest|ends inside"),
    (one(b"abc", sha1(b"abd")), "payload-digest"),
    (packed(gzip.decompress(one(b"abc")).replace(b"abc", b"abd")), "block-digest"),
    (packed(gzip.decompress(one(b"abc")) + b"more"), "does not end"),
    (packed(gzip.decompress(one(b"abc")) * 2), "does not end"),
    (packed(gzip.decompress(one(b"abc"))[:-6]), "shorter"),
    (packed(gzip.decompress(one(b"abc")).replace(b"\r\nContent-Length: ", b"\r\nLength: ")), "no Content-Length"),
    (packed(b"hello"), "begin with"),
    (packed(b"WARC/1.1\r\n" + b"a: b\r\n" * 400000), "header"),
    (b"plain text", "broken gzip"),
])
def test_reader_refuses_wrong_archives(data, message):
    with pytest.raises(warc.WarcError, match=message):
        list(warc.records(io.BytesIO(data)))
