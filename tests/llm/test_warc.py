"""Archives written and read back, cut at every kind of place."""

import gzip
import hashlib
import io
import random
import uuid

import pytest

from sitescan.llm.common import shared_dir
from sitescan.llm.warc import _record, plan_records, read_warc, records_in, through_warc, write_warc


def pages():
    big = "<p>é漢" + "x" * 1500
    return [(i, f"http://h/{i}", big if i % 3 == 0 else f"<p>{i}" + "y" * (i * 40)) for i in range(40)] + [(50, None, None), (51, "http://a\r\nb", ""), (None, "u", "z"), (50, "twice", "q" * 1200)]


def test_round_trip_and_revisits(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages()], "page_id long, url string, html string, payload string")
    got = through_warc(df).collect()
    assert len(got) == len(pages())
    by = {}
    for i, u, h in pages():
        by.setdefault(i, []).append((u, (h or "").encode()))
    big = max(i for i, _, h in pages() if i is not None and h and h.startswith("<p>é"))
    for r in got:
        payloads = [p for _, p in by[r.page_id] if hashlib.sha1(p).hexdigest() == r.payload_digest]
        assert payloads and r.payload_bytes == len(payloads[0])
        if r.record_type == "response":
            assert bytes(r.payload) == payloads[0] and r.refers_to is None
        else:
            assert r.refers_to == big and r.page_id != big and r.payload is None
    assert sum(r.record_type == "revisit" for r in got) == 13


def test_every_record_has_one_owner(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    manifest = write_warc(plan_records(df), f"file://{tmp_path}/w")
    want = sorted(read_warc(manifest, 1 << 30).select("payload_digest").collect())
    for split in (100, 777, 5000):
        assert sorted(read_warc(manifest, split).select("payload_digest").collect()) == want


def test_foreign_bytes_between_members():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:5>\r\nX-Page-ID: 5\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    data = b"\x1f\x8b\x08junk" + gzip.compress(b"no archive") + gzip.compress(record) + b"\x1f\x8b\x08\x00" + gzip.compress(record)
    for cut in range(0, len(data), 7):
        got = [*records_in(io.BytesIO(data), 0, cut), *records_in(io.BytesIO(data), cut, len(data))]
        assert [r[0] for r in got] == [5, 5]


def test_empty(spark):
    assert through_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lost_or_cut_payloads_are_reported():
    digest = hashlib.sha1(b"payload").hexdigest()
    whole = _record(5, "u", b"payload", digest, None)
    got = [*records_in(io.BytesIO(gzip.compress(whole)), 0, 1)]
    assert got[0][4:6] == (digest, 7) and got[0][8:] == (True, b"payload")
    end = whole.index(b"payload\r\n")
    for bad in (whole[: end + 3], whole[:end] + b"\r\n\r\n", whole[:end] + b"PAYLOAD\r\n\r\n", _record(5, "u", b"", digest, None)):
        with pytest.raises(ValueError, match="urn:uuid:"):
            list(records_in(io.BytesIO(gzip.compress(bad)), 0, 1))


def test_archives_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    body = "<p>é</p>".encode()
    sha256 = hashlib.sha256(body).hexdigest()
    block = http + body
    records = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000001>\r\nContent-Type: application/warc-fields\r\nContent-Length: 14\r\n\r\nsoftware: any\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: request\r\nwarc-record-id: <urn:uuid:2>\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n",
        b"WARC/1.1\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:uuid:3>\r\nWARC-Target-URI: http://h/\r\n a\r\nwarc-payload-digest: sha256:%s\r\nContent-Type: application/http;msgtype=response\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (sha256.encode(), len(block), block),
        b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Refers-To: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Payload-Digest: md5:%s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % hashlib.md5(b"abd").hexdigest().encode(),
    ]
    data = b"".join(map(gzip.compress, records))
    got = [*records_in(io.BytesIO(data), 0, len(data))]
    assert [r[2] for r in got] == ["warcinfo", "request", "response", "revisit", "resource"]
    assert [r[6] for r in got] == ["<urn:uuid:00000000-0000-4000-8000-000000000001>", *(f"<urn:uuid:{i}>" for i in (2, 3, 4, 5))]
    assert [r[8] for r in got] == [None, None, True, True, False] and all(r[0] is None for r in got)
    assert got[2][1] == "http://h/ a" and got[2][9] == body and got[2][4] == hashlib.sha1(body).hexdigest() and got[3][7] == "<urn:uuid:3>"
    assert got[0][9] == b"software: any\n"


def stored(payload, page, url="u"):
    """A record as a member that holds its payload as it is, so that members inside it can be seen from outside."""
    return gzip.compress(_record(page, url, payload, hashlib.sha1(payload).hexdigest(), None), 0)


def test_archives_inside_payloads_are_no_records(spark, tmp_path):
    inner = b"".join(stored(b"deep" * n, 100 + n) for n in (5, 60, 1))
    middle = stored(b"x" * 300 + inner + b"y" * 200 + inner, 200) + stored(b"plain", 201)
    data = stored(b"first", 1) + stored(middle + b"z" * 100 + middle, 2) + b"\x1f\x8b\x08 no member" + stored(middle, 3) + stored(b"last" * 50, 4)
    assert data.count(inner) > 4
    (tmp_path / "a.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data))], "path string, bytes long")
    for split in (1 << 20, 4000, 1000, 450, 97):
        got = [(r.page_id, r.payload_digest) for r in read_warc(manifest, split).collect()]
        want = [(1, b"first"), (2, middle + b"z" * 100 + middle), (3, middle), (4, b"last" * 50)]
        assert sorted(got) == [(i, hashlib.sha1(p).hexdigest()) for i, p in want], split
    # a file listed twice is still read once
    assert read_warc(manifest.union(manifest), 450).count() == 4


def test_megabytes_and_digests_that_are_joined(spark):
    rnd = random.Random(8)
    big = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé 漢<>/", k=3_000_000))
    df = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "s" * 999), (4, "w", "s" * 999)], "page_id long, url string, html string")
    df = plan_records(df, most_sent=0)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    got = {r.page_id: r for r in read_warc(write_warc(df, folder), 700_000).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "response", 3: "response", 4: "response"}
    assert got[1].refers_to == 2 and bytes(got[2].payload).decode() == big
    assert got[1].payload_digest == got[2].payload_digest == hashlib.sha1(big.encode()).hexdigest()
