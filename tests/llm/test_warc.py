import base64
import gzip
import hashlib
import io

import pytest

from flowscope.llm.warc import CHUNK, Members, archive_pages, clean_header, page_id_of, read_archives, read_header, record_bytes
from flowscope.session import shared_folder
from tests.compare import compare, duck
from flowscope.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
PAGES = [(3, "http://a/é", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (9, "x", ""), (4, "u\r\nWARC-Type: revisit", "r\r\n\r\nWARC/1.1\r\n"),
         (7, "100%25", "z" * 700_000), (8, "y", "z" * 700_000), (None, "n", "<p>é</p>"), (1, "http://b", "<p>é</p>")]


@pytest.fixture(scope="module")
def folder(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 as id", "2 as sha1", "3 as size")
    out = shared_folder(spark, "warc-test")
    archive_pages(pages.repartition(3), out)
    return out


def test_round_trip(spark, folder):
    rows = read_archives(spark, folder, verify=True).select("*", page_id_of("record_id").alias("id"), page_id_of("refers_to").alias("of")).collect()
    assert len(rows) == len(PAGES)
    html = {i: (t or "").encode() for i, _, t in PAGES}
    url = {i: u for i, u, _ in PAGES}
    first = {1: 1, 3: 1, 2: 2, 9: 2, 7: 7, 8: 7, 4: 4}
    for r in rows:
        assert r.target_uri == url[r.id] and r.payload_bytes == len(html[r.id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.id]).digest()).decode()
        response = r.id is None or first[r.id] == r.id
        assert (r.record_type, r.of) == (("response", None) if response else ("revisit", first[r.id]))
        assert (bytes(r.payload) == html[r.id]) if response else (r.payload is None)


def test_filters_reach_the_reader(spark, folder):
    records = read_archives(spark, folder, payload=False).where("record_type = 'revisit' and target_uri in ('http://a/é', 'y')")
    assert sorted(r.target_uri for r in records.collect()) == ["http://a/é", "y"]
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[-1] or "Filter" not in plan
    assert "payload" not in [f.name for f in records.schema if f.name == "payload"]


def test_small_payloads_are_all_responses(spark):
    out = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    archive_pages(pages, out, least=100)
    kinds = {page: kind for page, kind in read_archives(spark, out).select(page_id_of("record_id"), "record_type").collect()}
    assert [i for i, k in kinds.items() if k == "revisit"] == [8]


def test_empty_table_and_folder(spark):
    out = shared_folder(spark, "warc-test")
    assert read_archives(spark, out).count() == 0
    archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), out)
    assert read_archives(spark, out).count() == 0


def test_headers_keep_any_text():
    for value in ("plain", "a%0Db\r\n\x7f%", "é%%25"):
        assert read_header(clean_header(value)) == value and "\n" not in clean_header(value)


def test_members_can_be_skipped_unread():
    row = {"record_id": "<urn:page:1>", "record_type": "response", "payload": bytes(range(256)) * 5000}
    member = gzip.compress(record_bytes(row))
    members = Members(io.BytesIO(member * 3))
    for _ in range(3):
        assert members.until(b"\r\n\r\n").startswith(b"WARC/1.1")
        assert len(members.text) <= 2 * CHUNK
        members.skip()
    assert members.until(b"\r\n\r\n") is None


def test_query(spark):
    assert compare(QUERIES["op5_warc"](spark, SF), duck(SF), CHECKS["op5_warc"]) is None
