import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from confab.llm import warc
from confab.sources.storage import shared_folder


def rows():
    big, huge = "<p>" + "é" * 600, "z" * 3_000_000
    return [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", ""), (7, "u", huge), (9, "u", huge), (9, "u", huge), (None, "u", big), (10, "u", "a\r\n\r\nb" * 300)]


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("payload", "same", "top", "_id", "_same", "record_type", "path", "n")})
    manifest = warc.write_archives(pages, shared_folder(spark) + "/warc-test", archive_bytes=4000)
    assert manifest.count() > 2
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows())
    for r in got:
        page, _, html = next(x for x in rows() if x[0] == r.page_id)
        body = (html or "").encode()
        top = max((x[0] for x in rows() if x[0] is not None and (x[2] or "").encode() == body and len(body) >= 1000), default=page)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if page == top else ("revisit", top))
        assert r.payload == (body if page == top else None)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, shared_folder(spark) + "/warc-empty")).collect() == []


def test_damage_is_found():
    good = warc.record_bytes(1, "u", b"payload" * 300, None)
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(good + good))] == [2100, 2100]
    plain = zlib.decompress(good, 31)
    pack = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    for bad in (good[:-20], pack(plain.replace(b"payload", b"payroll", 1)), pack(plain[:-1]), pack(b"x")):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))
