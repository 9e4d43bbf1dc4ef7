import base64
import hashlib

import pytest

from rillwork.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_and_revisits(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>", 7), (2, None, None, 7), (3, "", "", 7), (4, "http://b/%20 \r\ncé", "é" * 1000, 7), (5, "http://a/2", "<p>x</p>", 7), (9, "http://a/9", "<p>x</p>", 7), (None, "u", "<p>x</p>", 7), (9, "again", "<p>x</p>", 7), (11, "z", "q\r\n\r\nWARC/1.1\r\n", 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, offset int").repartition(3)
    folder = f"file://{tmp_path}/w"
    got = warc.round_trip(df, folder=folder).collect()
    assert len(got) == len(pages)
    assert sorted(r.url or "-" for r in got) == sorted(u or "-" for _, u, _, _ in pages) and sum(r.url is None for r in got) == 1
    tops = {}
    for i, _, h, _ in pages:
        tops[h or ""] = max(tops.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in pages:
        top = tops[h or ""]
        same = i == top
        want.append((i or -1, len((h or "").encode()), digest(h), "response" if same else "revisit", None if same else top))
    assert sorted(want, key=str) == sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    assert all(bytes(r.payload).decode() == "é" * 1000 for r in got if r.page_id == 4)


def test_small_payloads_stay_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "a" * 50), (4, "u", "a" * 50)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(df, least=10, folder=f"file://{tmp_path}/w").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_files_roll_and_selected_records_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.assign_types(df, "page_id", "url", "html", 10**9), folder, roll=20_000)
    assert index.select("file").distinct().count() > 3
    some = index.where("page_id % 7 = 3")
    got = {r.page_id: r.payload_bytes for r in warc.read_records(some, folder, gap=500, chunk=4000).collect()}
    assert got == {i: i * 37 % 900 for i in range(300) if i % 7 == 3}


def test_damage_is_noticed():
    data = warc.record(1, "u", b"abc", warc.payload_digest(b"abc"))
    assert warc.parse(data)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, folder=f"file://{tmp_path}/w").count() == 0
