import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from odonto.llm import warc
from odonto.llm.common import scratch_path

PAGES = [(5, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c/\r\nX: y", "ünïcode"),
         (4, "u", None), (6, "u", ""), (7, "u", "only once " * 5000), (None, "u", "<p>same</p>"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
         (11, "u", "twice"), (11, "u", "twice")]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("n", F.lit(1))
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted((-1 if i is None else i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in PAGES)
    read = warc.archive_pages(spark, pages).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read) == want
    assert [r.url for r in read if r.page_id == 3] == ["http://c/%0D%0AX: y"]


def test_dictionary_and_single_frames(spark):
    import zstandard
    rows = [(i, f"http://x/{i}", f"<html><head><title>Page {i}</title></head><body><div class='content'>Text {i * 7919}</div></body></html>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.plan_records(pages).coalesce(1), scratch_path(spark, "warc"), sample_bytes=50_000)
    uri = manifest.first()["file"]
    system, path = warc.file_system(uri)
    data = system.open_input_stream(path, compression=None).read()
    magic, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    words = zstandard.ZstdCompressionDict(data[8:8 + size])
    one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
    record = one.decompress(data[8 + size:])
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and one.unused_data
    assert warc.parse(record)["http-content-length"] == str(len(warc.parse(record)["payload"]))
    assert warc.read_archives(manifest).count() == 400


def test_small_payloads_and_archives(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    planned = warc.plan_records(pages, min_shared_bytes=3).coalesce(1)
    manifest = warc.write_archives(planned, scratch_path(spark, "warc"), archive_bytes=1)
    assert manifest.count() == 4
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_truncated_archive_is_an_error(tmp_path):
    f = tmp_path / "x.warc.zst"
    a = warc.Archive(f"file://{f}", 1 << 12, 1, 3)
    a.add(warc.record(1, "u", b"payload " * 100, "D", None, "2024-01-15T00:00:00Z"))
    a.close()
    assert len(list(warc.read_records(f"file://{f}"))) == 1
    f.write_bytes(f.read_bytes()[:-5])
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(f"file://{f}"))


def test_empty_table(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
