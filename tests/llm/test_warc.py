"""Legacy archives of both versions, their conversion, and awkward rows."""

import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from rollcall.llm import queries, warc

DATA = "/root/testdata/sf0.001"


def sha1(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_versions(version, packed):
    rows = [warc.ArcRecord(f"http://x/{k}", "1.2.3.4", "20010203040506", "text/html", b"a\nb" * k) for k in (0, 1, 40_000)]
    parts = [warc.version_block("x.arc", "20010203040506", version), *(warc.arc_bytes(r, version) for r in rows)]
    head = parts[0].decode().split("\n")
    assert head[0].startswith("filedesc://x.arc 0.0.0.0 20010203040506 text/plain") and head[1].startswith(f"{version} 0 ")
    assert len(head[0].split(" ")) == (5, 10)[version - 1] == len(head[2].split(" "))
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    assert list(warc.read_arc(io.BytesIO(data)))[1:] == rows
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-50])))


def test_blanks_in_urls_and_unknown_versions():
    block = warc.version_block("x.arc", "20010203040506", 1)
    own = list(warc.read_arc(io.BytesIO(block + b"http://a b c 1.2.3.4 2001 text/html 3\nabc\n\n")))
    assert own[1] == warc.ArcRecord("http://a b c", "1.2.3.4", "2001", "text/html", b"abc") and warc.iso("2001") == "2001-00-00T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(block.replace(b"1 0 rollcall", b"9 0 rollcall"))))
    assert warc.iso("20010203040506") == "2001-02-03T04:05:06Z"


def test_conversion(spark):
    p, q = "<p>é</p>", "z" * 200_000
    rows = [(1, "http://a b/é", p), (2, "https://x", None), (3, None, ""), (4, "dns:x", p), (5, "http://y", q), (None, "ftp://z", p), (None, "ftp://z", "own"), (5, "http://y", q), (9, "filedesc://w", "w")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    arcs = warc.legacy(pages.repartition(3))
    declared = set()
    for r in arcs.collect():
        where, name = fs.FileSystem.from_uri(r.path)
        with where.open_input_stream(name, compression=None) as stream:
            declared.add(warc.arc_version(next(warc.read_arc(stream)).payload))
    assert declared == {1, 2}
    got = warc.read_back(warc.converted(arcs)).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    digest, long_ = sha1(p.encode()), sha1(q.encode())
    want = [
        (1, len(p.encode()), digest, "response", None),
        (4, len(p.encode()), digest, "revisit", 1),
        (None, len(p.encode()), digest, "revisit", 1),
        (2, 0, sha1(b""), "response", None),
        (3, 0, sha1(b""), "revisit", 2),
        (5, 200_000, long_, "response", None),
        (5, 200_000, long_, "revisit", 5),
        (None, 3, sha1(b"own"), "resource", None),
        (9, 1, sha1(b"w"), "warcinfo", None),
    ]
    assert seen == sorted(want, key=str)
    by_record = {r.record_id: r for r in got}
    assert all(by_record[r.refers_to_record].payload_digest == r.payload_digest for r in got if r.record_type == "revisit")
    assert warc.read_back(warc.written(pages.limit(0))).count() == 0


def test_query_against_plain_python(spark):
    got = {r.page_id: r for r in queries.op2_warc(spark, DATA).collect()}
    pages = sorted(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect())
    first = {}
    for page_id, html in pages:
        body = (html or "").encode()
        own = first.setdefault(body, page_id)
        g = got[page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(body), sha1(body), *(("response", None) if own == page_id else ("revisit", own)))
    assert len(got) == len(pages)
