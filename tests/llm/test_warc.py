"""Archives: bytes round trip, members stand alone, damaged and foreign files, revisits."""

import gzip
import hashlib
import os

from pyspark.sql import functions as F

from foliant.llm import op13_warc as op

KIND = "page_id long, url string, html string"
SAME = "<p>the same long payload</p>\r\n\r\n" * 10
ODD = [(1, None, None), (2, "http://a.b/ c\r\nX: y", ""), (3, "http://a.b", "short"), (4, "http://a.b", "short"), (9, "u", SAME), (5, "v", SAME), (7, "w", SAME), (5, "v", SAME), (None, "n", SAME), (10, "WARC/1.1", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\n" * 9), (11, "z", "é字\n\n\r" * 20000), (12, "z", "no line end")]


def members(path):
    """(offset, length, bytes) of each gzip member, found without the index."""
    import zlib

    data, at = open(path, "rb").read(), 0
    while at < len(data):
        z = zlib.decompressobj(31)
        body = z.decompress(data[at:]) + z.flush()
        assert z.eof
        size = len(data) - at - len(z.unused_data)
        yield at, size, body
        at += size


def test_members_and_index(spark, tmp_path):
    df = spark.createDataFrame(ODD, KIND).repartition(2)
    folder = f"file://{tmp_path}/w"
    op.write_monolithic(df, f"{folder}/monolithic")
    streams = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "w/monolithic") for f in names if f.endswith(".gz")]
    assert streams and all(len(list(members(f))) == 1 for f in streams)
    index = op.normalise(spark, f"{folder}/monolithic", folder)
    rows = index.collect()
    assert len(rows) == len(ODD)
    found = {(a, o, n): b for a in {r.archive for r in rows} for o, n, b in members(tmp_path / "w/archives" / a)}
    assert set(found) == {(r.archive, r.offset, r.length) for r in rows}
    whole = b"".join(gzip.open(f).read() for f in streams)
    assert sorted(b"".join(found.values())) == sorted(whole)  # every byte is kept
    for (*_, size), body in found.items():
        assert size and body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
    some = op.read_records(index.where("record_type = 'revisit'"), folder).collect()
    assert {r.record_type for r in some} == {"revisit"} and all(r.payload_bytes == 0 for r in some)


def test_revisits(spark, tmp_path):
    df = spark.createDataFrame(ODD, KIND).withColumn("__n", F.lit(1)).withColumn("payload_digest", F.lit("clash"))
    index = op.archive_pages(df, f"file://{tmp_path}/w")
    got = op.resolved(op.read_records(index, f"file://{tmp_path}/w")).collect()
    page = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None
    out = sorted(((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in got), key=repr)
    want = []
    for i, _, html in ODD:
        body = (html or "").encode()
        again = html == SAME and i != 5
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert out == sorted(want, key=repr)
    assert not os.path.exists(tmp_path / "w/monolithic")
    none = op.archive_pages(df.where("false"), f"file://{tmp_path}/none")
    assert none.count() == 0


def test_foreign_and_damaged_files(spark, tmp_path):
    rec = lambda i, body: b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:page:%d>\nX-Folded: a\n  b\ncontent-length:  %d\n\n%s\n\n" % (i, len(body), body)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.warc.gz").write_bytes(gzip.compress(rec(1, b"one") + b"noise\n" + rec(2, b"two\nlines\n") + b"WARC/1.0\nno length\n\n" + rec(3, b"x" * 100)[:-60]))
    (src / "b.warc.gz").write_bytes(gzip.compress(rec(4, b"four")) + gzip.compress(rec(5, bytes(range(256)))))
    (src / "c.warc").write_bytes(rec(6, b""))
    (src / "d.warc.gz").write_bytes(gzip.compress(b""))
    index = op.normalise(spark, f"file://{src}", f"file://{tmp_path}/out")
    got = {r.record_id: r for r in op.read_records(index, f"file://{tmp_path}/out").collect()}
    want = {1: b"one", 2: b"two\nlines\n", 4: b"four", 5: bytes(range(256)), 6: b""}
    assert set(got) == {f"<urn:page:{i}>" for i in want}
    assert all(got[f"<urn:page:{i}>"].payload_digest == hashlib.sha256(b).hexdigest() for i, b in want.items())
    assert op.header(b"A: b\r\nX-Folded: a\r\n  b\r\nC: d\r\n\r\n", "x-folded") == "a b"


def test_same_bytes_at_any_time():
    assert op.member(b"record") == op.member(b"record") and gzip.decompress(op.member(b"record")) == b"record"
