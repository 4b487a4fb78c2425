import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import warc

SCHEMA = "page_id long, url string, html string, payload int"


def test_round_trip_and_revisits(spark, tmp_path):
    big, other = "é<p>x</p>" * 200, "b" * 1000
    rows = [(i, f"http://x/{i}\r\nEvil: 1", big, 1) for i in range(40)] + [(50, None, None, 2), (51, "u", "", 2), (52, "u", "short", 2), (53, "u", "short", 2), (54, "u", other, 2), (55, "u", other[1:], 2), (56, "u", other, 2), (56, "u", other, 2), (None, "u", other, 2)]
    path = f"file://{tmp_path}/w"
    warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    found = warc.read_archive(spark, path, payload=True)
    got = found.select(warc.page_id("record_id").alias("id"), warc.page_id("refers_to").alias("to"), "*").collect()
    assert len(got) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        full = html[r.id]
        assert r.payload_bytes == len(full) and r.payload_digest == hashlib.sha1(full).hexdigest()
        latest = max((k for k, v in html.items() if k is not None and v == full), default=None)
        revisit = r.id is not None and len(full) >= 1000 and r.id != latest
        assert (r.record_type, r.to) == (("revisit", latest) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else full)
    assert sum(r.record_type == "response" for r in got if r.payload_digest == hashlib.sha1(big.encode()).hexdigest()) == 1
    # plain gzip tools read the archive
    text = b"".join(gzip.open(f"{tmp_path}/w/{f}").read() for f in os.listdir(f"{tmp_path}/w"))
    assert text.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nEvil" not in text


def test_pushdown_and_foreign_members(spark, tmp_path):
    os.makedirs(f"{tmp_path}/w")
    blocks = [warc.record(f"<urn:page:{i}>", "response" if i % 2 else "metadata", f"u{i}", None, "00" * 20, b"z" * (100_000 * i)) for i in range(6)]
    with open(f"{tmp_path}/w/a.warc.gz", "wb") as f:
        f.writelines(gzip.compress(b) for b in blocks)  # no noted lengths
    with open(f"{tmp_path}/w/b.warc", "wb") as f:
        f.writelines(blocks)
    found = warc.read_archive(spark, str(tmp_path / "w"), payload=True, pushdown=True)
    some = found.filter("record_type = 'response' and target_uri in ('u3', 'u4', 'u5')")
    assert sorted((r.target_uri, r.payload_bytes, len(r.payload)) for r in some.collect()) == [("u3", 300_000, 300_000)] * 2 + [("u5", 500_000, 500_000)] * 2
    same = warc.read_archive(spark, str(tmp_path / "w"), payload=True, where={"record_type": ["response"], "target_uri": ["u3", "u4", "u5"], "payload_digest": None})
    assert sorted((r.target_uri, len(r.payload)) for r in same.collect()) == [("u3", 300_000)] * 2 + [("u5", 500_000)] * 2
    # without either, a frame gives the same to each query
    plain = warc.read_archive(spark, str(tmp_path / "w"))
    assert [plain.count(), plain.filter("record_type = 'response'").count(), plain.count(), plain.filter("record_type = 'metadata'").count()] == [12, 6, 12, 6]
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert warc.read_archive(spark, str(tmp_path / "w")).filter("payload_bytes > 300000").count() == 4


def test_heads_without_fields(spark, tmp_path):
    os.makedirs(f"{tmp_path}/w")
    block = b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore"
    with open(f"{tmp_path}/w/a.warc", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    (r,) = warc.read_archive(spark, str(tmp_path / "w"), payload=True).collect()
    assert bytes(r.payload) == b"body\r\n\r\nmore" and r.payload_bytes == len(r.payload) and r.http_headers.startswith("HTTP/1.1 200 OK")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_payloads_hash_to_their_digests(spark, tmp_path):
    """All pages and a very long one, written, read back with payloads, and hashed again."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = spark.createDataFrame([(10**9, "long", "<p>é" * 3_000_000)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archive(pages.select("page_id", "url", "html").union(more), path)
    found = warc.read_archive(spark, path, payload=True).withColumns({"sha": F.sha1("payload"), "own": F.octet_length("payload")})
    assert found.filter("record_type = 'response' and (sha <> payload_digest or own <> payload_bytes)").count() == 0
    assert found.filter("record_type = 'revisit' and own > 0").count() == 0
    assert found.count() == pages.count() + 1 and found.agg(F.max("payload_bytes")).first()[0] == 15_000_000


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archive(spark, path).count() == 0
