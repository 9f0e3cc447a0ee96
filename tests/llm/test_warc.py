import base64
import gzip
import hashlib

import pytest

from pkgsieve.llm import store, warc
from tests.llm.helpers import long_text

PAGES = "page_id long, url string, html string, record string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], PAGES)


ROWS = [
    (7, "http://a.org/x", "<p>one</p>"), (3, "http://a.org/y\r\nX: y", "<p>one</p>"), (9, None, "<p>one</p>"),
    (4, "http://b.org/é", None), (5, "", ""), (None, "http://n.org/", "<p>null id</p>"), (None, "http://n.org/", "<p>one</p>"),
    (6, "http://c.org/", "\r\n\r\nWARC/1.1\r\n\r\n" + "字" * 70_000), (8, "http://c.org/", long_text(n=50_000)),
    (10, "u", "rep"), (10, "u", "rep"),
]


def brute(rows, least=0):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if len(raw) < least or digest not in first:
            first.setdefault(digest, page_id)
            out.append((page_id, len(raw), digest, "response", None))
        else:
            out.append((page_id, len(raw), digest, "revisit", first[digest]))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    for least in (0, 5):
        got = sorted((tuple(r) for r in warc.archive_pages(pages(spark, ROWS).repartition(3), min_bytes=least).collect()), key=repr)
        assert got == brute(ROWS, least)


def test_chunks_are_bounded_and_archives_roll_over(spark):
    chunks = warc.chunk_table(pages(spark, ROWS), chunk=1000)
    assert max(len(r["data"]) for r in chunks.select("data").collect()) <= 1000
    archives = warc.write_archives(chunks, warc.record_plan(chunks), archive_bytes=20_000)
    found = archives.collect()
    assert len(found) > 1 and sum(r["records"] for r in found) == len(ROWS)
    assert sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=repr) == brute(ROWS)
    with store.open_input(found[0]["uri"]) as f:  # any gzip reader can read the files
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_damage_is_noticed(spark, tmp_path):
    chunks = warc.chunk_table(pages(spark, ROWS[:1]))
    uri = warc.write_archives(chunks, warc.record_plan(chunks)).first()["uri"]
    with store.open_input(uri) as f:
        raw = gzip.decompress(f.read())
    bad = tmp_path / "bad.warc.gz"
    for data in (gzip.compress(raw.replace(b"<p>one", b"<p>two")), gzip.compress(raw)[:-20]):
        bad.write_bytes(data)
        with open(bad, "rb") as f, pytest.raises((ValueError, StopIteration)):
            for member in warc._members(f):
                warc._record(member)


def test_empty_table(spark):
    assert warc.archive_pages(pages(spark, [])).count() == 0
