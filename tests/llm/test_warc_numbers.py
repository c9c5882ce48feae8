"""Heads inside payloads whose numbers are none."""

import pytest

from grafita.llm import warc


@pytest.mark.parametrize("size", ["700b", "128m"])
def test_malformed_numbers_inside_payloads(spark, tmp_path, size):
    head = "WARC/1.0\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    lengths = ["²", "9" * 25, "9" * 5000, "9" * 18, "-3", "+3", "3.0", "0x3", "٣", "", " 3 ", "00000000000000000003"]
    ids = "WARC/1.0\r\nWARC-Record-ID: <urn:row:{0}>\r\nWARC-Refers-To: <urn:row:{0}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [head.format(x) for x in lengths] + [ids.format(x) for x in ("9" * 25, "9" * 19, "9" * 5000, "²", "-")] + ["plain"]
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.page_id: r.payload_digest for r in warc.archive_round_trip(df, f"file://{tmp_path}/w").collect()}
        back = {r.id: bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i: warc.payload_digest(h.encode()) for i, h in enumerate(html)}
    assert back == {i: h.encode() for i, h in enumerate(html)}
