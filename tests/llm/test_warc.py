import gzip
import hashlib
import io

import numpy as np

from gridloom.llm import warc


def test_ranges_of_any_size_find_each_record_once():
    rng = np.random.default_rng(4)
    inner = warc.record(99, "inner", b"in" * 50, "d", None)
    bodies = [b"", b"x", inner, warc.MAGIC * 40, rng.bytes(5000), rng.bytes(300) + inner + rng.bytes(300), b"<html>" * 40_000]
    raw, at = b"", []
    for i, b in enumerate(bodies * 3):
        at.append(len(raw))
        raw += warc.record(i, "u", b, hashlib.sha1(b).hexdigest(), None if i % 4 else 7)
    assert gzip.decompress(raw).count(b"WARC/1.1") >= len(at)
    for size in (1, 37, 1000, 70_000, 1 << 22):
        got = [(p, h, b) for s in range(0, len(raw), size) for p, h, b in warc.records_in(io.BytesIO(raw), s, s + size)]
        assert [g[0] for g in got] == at
        assert all(b == (bodies[i % 7] if i % 4 else b"") for i, (_, _, b) in enumerate(got))


def test_pages(spark):
    big, small = "b" * 1000, "s" * 999
    rows = [(1, "u", big), (2, "u", big), (5, "u", big), (3, "u", small), (4, "u", small), (6, None, None), (7, "u", ""), (8, "a\r\nb", "é" * 600), (5, "u", big), (None, "u", big), (9, "u", "é" * 600)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    manifest, folder = warc.archive(df)
    got = warc.read(spark, manifest, folder, range_bytes=100).collect()
    assert len(got) == len(rows)
    sent = sorted(((r["id"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert sent == sorted([(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (5, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None), (None, "revisit", 5)], key=str)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r["digest"] == hashlib.sha1(html[r["id"]]).hexdigest() and r["payload_bytes"] == len(html[r["id"]])
        assert r["payload"] == (None if r["refers_to"] else html[r["id"]])
    manifest, folder = warc.archive(df.limit(0))
    assert warc.read(spark, manifest, folder).count() == 0
