"""Archives written and read back: digests, revisits, chunks, odd input."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rollcall.llm import warc

SCHEMA = "page_id long, url string, html string, row string, chunk string, data string, key string, _row long"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2 b\r\nX-Evil: 1", "<p>one</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "http://ä/5", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "http://a/6", "".join(random.Random(1).choices("abcdé€😀\r\n", k=30_000))),
    (7, "http://a/7", "".join(random.Random(1).choices("abcdé€😀\r\n", k=30_000))),
    (7, "http://a/7", "".join(random.Random(1).choices("abcdé€😀\r\n", k=30_000))),
    (None, "http://a/8", "<p>one</p>"),
    (None, "http://a/9", "alone"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "r", "c", "d", "k", 9) for p in PAGES], SCHEMA).repartition(3)


def back(contents):
    return [r.asDict() for r in warc.read_records(contents).collect()]


def test_records_come_back_with_digests_and_revisits(pages):
    got = back(warc.write(pages, "page_id", "url", "html"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or "")
    best = {}
    for i, _, html in PAGES:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want, carried = [], set()
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        text, top = html or "", best[html or ""]
        first = (-1 if i is None else i) == top and text not in carried
        carried |= {text} if first else set()
        want.append((i, len(text.encode()), sha1(text), "response" if first else "revisit", None if first else str(top)))
    assert sorted([(None if r["key"] is None else int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=lambda r: key(r) + (r[4] or "",)) == sorted(want, key=lambda r: key(r) + (r[4] or "",))
    assert all(r["digest_matches"] is (True if r["record_type"] == "response" else None) for r in got)
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(PAGES)
    assert all(ids[r["refers_to_id"]]["payload_digest"] == r["payload_digest"] for r in got if r["refers_to_id"])
    assert {r["target_uri"] for r in got if r["key"] in ("2", "3", "5")} == {"http://a/2%20b%0D%0AX-Evil:%201", None, "http://ä/5"}


def test_small_payloads_are_all_responses(pages):
    kinds = {(r["key"], r["record_type"]) for r in back(warc.write(pages, "page_id", "url", "html", revisit_from=100))}
    assert ("1", "response") in kinds and ("3", "response") in kinds and ("6", "revisit") in kinds


def test_chunks_rebuild_each_payload_and_carry_its_digest_so_far(pages):
    rows = warc.read_chunks(warc.write(pages, "page_id", "url", "html", chunk=700), chunk=1000).collect()
    payloads = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk"])):
        assert len(r["data"]) <= 1000
        payloads[r["record_id"]] = payloads.get(r["record_id"], b"") + bytes(r["data"])
        assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(payloads[r["record_id"]]).digest()).decode()
    assert sum(r["last"] for r in rows) == len(payloads) == len(PAGES)
    assert {p for p in payloads.values() if p} == {h.encode() for _, _, h in PAGES if h}


def test_chunk_rows_of_a_table(spark):
    rows = warc.chunked(spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "abc"), (5, "é" * 4)], "row long, payload string"), size=3).collect()
    assert [(r["row"], r["chunk"], bytes(r["data"])) for r in rows] == [(1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g"), (2, 0, b""), (3, 0, b""), (4, 0, b"abc"), *[(5, i, "éééé".encode()[3 * i : 3 * i + 3]) for i in range(3)]]


def test_files_roll_over_and_are_gzip_members(pages):
    contents = warc.write(pages.coalesce(1), "page_id", "url", "html", archive=500)
    files = contents.collect()
    assert len(files) > 2 and sum(f["records"] for f in files) == len(PAGES)
    for f in files:
        with open(warc.filesystem(f["path"])[1], "rb") as raw:
            data = raw.read()
        assert len(data) == f["bytes"] and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") >= f["records"] + 1
    assert len(back(contents)) == len(PAGES)


def test_plain_archives_and_damaged_ones(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\nWARC-Payload-Digest: sha1:WRONG\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    one = lambda p: spark.createDataFrame([(str(tmp_path / p),)], "path string")
    got = back(one("a.warc"))
    assert [(r["payload_bytes"], r["payload_digest"], r["digest_matches"]) for r in got] == [(5, sha1("hello"), False)] * 2
    for name, data in (("cut.warc", record[:-7]), ("cut.warc.gz", gzip.compress(record)[:-9]), ("text.warc", b"hello\n")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="archive ends|not a WARC"):
            back(one(name))


def test_empty_table(spark, pages):
    contents = warc.write(pages.limit(0), "page_id", "url", "html")
    assert contents.count() == 0 and back(contents) == [] and warc.read_chunks(contents).count() == 0


def test_lost_work_is_not_read(spark, pages, tmp_path):
    folder = str(tmp_path / "archives")
    first = warc.write(pages, "page_id", "url", "html", folder=folder)
    second = warc.write(pages.where(F.col("page_id") < 3), "page_id", "url", "html", folder=folder)
    assert len(back(first)) == len(PAGES) and len(back(second)) == 2
