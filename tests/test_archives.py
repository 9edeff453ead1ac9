import gzip
import io
import random
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from feedskein.schemas import CAPTURES
from feedskein.sources import archives as A
from feedskein.sources.captures import read_captures, stream_captures


@pytest.fixture
def captures(make):
    r = random.Random(4)
    rows = [{"url": f"https://a.example/{i}", "final_url": f"https://a.example/{i}", "body": f"<p>é {i}</p>\r\n\r\n" + "".join(chr(r.randrange(32, 0x2000)) for _ in range(r.randrange(4000)))}
            for i in range(60)]
    rows += [
        {"url": "https://b.example/", "http_status": 301, "final_url": "https://b.example/new"}, {"url": "https://c.example/", "error_kind": "timeout"},
        {"url": "https://d.example/", "http_status": 404, "body": ""}, {"url": "https://e.example/ä b", "body": "WARC/1.0", "fetched_at": D(2025, 1, 2, 3, 4, 5, 678901)},
    ]
    return make.captures(*rows)


def rows(frame):
    return sorted(tuple(r) for r in frame.select(*CAPTURES.names).select(
        "url", F.coalesce("final_url", "url"), F.coalesce("http_status", F.lit(0)), F.coalesce("error_kind", F.lit("")), F.coalesce("body", F.lit("none")), "fetched_at").collect())


def test_archives_equal_the_captures(spark, captures, tmp_path):
    A.register_archives(spark)
    path = str(tmp_path / "archives")
    captures.repartition(3).write.format(A.NAME).mode("append").save(path)
    assert rows(read_captures(spark, path, A.NAME)) == rows(captures)
    # many ranges in a file: every record in one of them
    split = spark.read.format(A.NAME).option("split_bytes", 3000).load(path)
    assert split.rdd.getNumPartitions() > 20 and rows(split) == rows(captures)
    captures.limit(2).write.format(A.NAME).mode("overwrite").save(path)
    assert read_captures(spark, path, A.NAME).count() == 2
    assert read_captures(spark, str(tmp_path / "none"), A.NAME).count() == 0


def test_filters_reach_the_records(spark, captures, tmp_path, monkeypatch):
    A.register_archives(spark)
    path = str(tmp_path / "archives")
    captures.coalesce(1).write.format(A.NAME).mode("append").save(path)
    read = spark.read.format(A.NAME).load(path)
    assert [r.url for r in read.filter("url = 'https://a.example/7'").collect()] == ["https://a.example/7"]
    assert read.filter(F.col("url").isin("https://a.example/7", "https://c.example/")).filter("http_status = 200").count() == 1
    assert read.filter(F.col("url").startswith("https://a.example/1")).count() == 11
    assert read.filter("url like '%example/7'").count() == 1
    reader = A.ArchiveReader(path, A.SPLIT_BYTES)
    left = reader.pushFilters([A.EqualTo(("url",), "https://a.example/7"), A.EqualTo(("http_status",), 200)])
    assert [f.attribute for f in left] == [("http_status",)]
    decoded = []
    monkeypatch.setattr(A, "_text", lambda *a: decoded.append(a))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(decoded) == 1


def test_stream_takes_each_archive_once(spark, captures, tmp_path):
    A.register_archives(spark)
    path, target = str(tmp_path / "archives"), str(tmp_path / "out")

    def run():
        arriving = stream_captures(spark, path, A.NAME)
        arriving.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", target).start().processAllAvailable()
        for query in spark.streams.active:
            query.stop()

    first = captures.filter("url < 'https://a.example/3'")
    first.write.format(A.NAME).mode("append").save(path)
    run()
    assert rows(spark.read.schema(CAPTURES).parquet(target)) == rows(first)
    captures.filter("url >= 'https://a.example/3'").repartition(2).write.format(A.NAME).mode("append").save(path)
    run()  # from the checkpoint
    assert rows(spark.read.schema(CAPTURES).parquet(target)) == rows(captures)


def member(*lines, body=b"", **more):
    return gzip.compress("\r\n".join(["WARC/1.0", *lines]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", **more)


def response(url, headers, body):
    content = headers.encode() + b"\r\n\r\n" + body
    return member("WARC-Type: response", f"WARC-Target-URI: {url}", "WARC-Date: 2025-01-01T00:00:00Z", f"Content-Length: {len(content)}", body=content)


def test_members_from_any_place():
    r = random.Random(1)
    parts = [member(f"WARC-Type: x{i}", body=r.randbytes(r.randrange(3000)) + A.MEMBER * 3) for i in range(40)]
    data = b"".join(parts)
    whole = [gzip.decompress(p) for p in parts]
    for step in (1, 700, 5000, 10**6):
        found = []
        for begin in range(0, len(data), step) if step > 1 else range(0, 3000):
            found += A.members(io.BytesIO(data), begin, min(begin + step, len(data)))
        assert found == (whole if step > 1 else whole[:len(found)]) and found
    # a broken member and a cut-off one are lost alone
    broken = bytearray(data)
    at = len(b"".join(parts[:5])) + 40
    broken[at:at + 30] = bytes(30)
    found = list(A.members(io.BytesIO(bytes(broken)), 0, len(data)))
    assert [f for f in whole if f in found][-1] == whole[-1] and len(whole) - 2 <= len(found) < len(whole)
    assert list(A.members(io.BytesIO(data[:-10]), 0, len(data) - 10)) == whole[:-1]
    assert list(A.members(io.BytesIO(b""), 0, 0)) == []


def test_responses_as_servers_send_them():
    chunked = b"4;x=1\r\n<p>a\r\n5\r\nbcd</\r\n0\r\n\r\n"
    read = lambda *a: A.capture(gzip.decompress(response(*a)))
    assert read("http://u", "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html", chunked)[4] == "<p>abcd</"
    assert read("http://u", "HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=latin-1", gzip.compress("é".encode("latin-1")))[4] == "é"
    assert read("http://u", "HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=none", b"plain")[4] == "plain"
    assert read("http://u/a/b", "HTTP/1.1 302 Found\r\nLocation: ../c", b"")[:3] == ("http://u/a/b", "http://u/c", 302)
    assert read("http://u", "nonsense", b"")[2] is None
    assert A.capture(gzip.decompress(member("WARC-Type: request", "WARC-Target-URI: http://u"))) is None
