import gzip
import random

import duckdb

from pyspark.sql import functions as F

from llm_cases import records  # noqa: F401
from locusframe.llm import queries, warc
from locusframe.llm.warc import LoserTree, _url_key, archive_round_trip, read_index, write_archives


def captured():
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 61 % 31_536_000)


def odd_pages(spark):
    rows = [(1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/y", "<p>same</p>"), (9, "http://a.example/x", "<p>same</p>"), (3, None, None),
            (4, "", ""), (5, "not a url\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (6, "https://www.A.example:443/P?q=1", "é\U0001f642" * 30_000),
            (7, "http://a.example:8080/", "\r\n\r\n"), (8, "http://[bad", "<p>same</p> "), (2, "http://b.example/y", "<p>same</p>")]
    rows += [(100 + k, "http://hot.example/", "copy of one page") for k in range(60)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(4)


def test_round_trip_equals_the_sql(spark, tmp_path):
    pages = odd_pages(spark)
    got = archive_round_trip(pages, captured()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured",
                                                           "url_key", "place")
    pages.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op4_warc_merge"]).fetchall()
    assert records(got) == sorted((tuple("null" if v is None else v for v in r) for r in want), key=repr)
    assert archive_round_trip(pages.where("false"), captured()).count() == 0


def test_payloads_and_order(spark, tmp_path):
    pages, path = odd_pages(spark), f"{tmp_path}/archives"
    write_archives(pages, path, captured(), minimum=12)
    index = read_index(spark, path).orderBy("range", "place").collect()
    order = [(r.url_key, r.captured, r.page_id) for r in index]
    assert order == sorted(order) and len(order) == pages.count()
    html = {}
    for r in pages.collect():
        html[r.page_id] = (r.html or "").encode()
    small = [r for r in index if r.payload_bytes < 12]
    assert small and all(r.record_type == "response" and r.refers_to is None for r in small)
    for r in index:
        raw = gzip.open(r.run.removeprefix("file:")).read()[r.position :]
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        size = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)[b"Content-Length"])
        assert rest[:size] == (html[r.page_id] if r.record_type == "response" else b"") and rest[size : size + 4] == b"\r\n\r\n"


def test_places_count_through_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    rows = [(k % 90, f"http://h{k % 4}.example/{k % 3}", f"text {k % 11}") for k in range(100)]
    index = archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), captured()).collect()
    assert len({r.range for r in index}) > 5
    index.sort(key=lambda r: r.place)
    assert [r.place for r in index] == list(range(100)) and [r.range for r in index] == sorted(r.range for r in index)
    order = [(r.url_key, r.captured, r.page_id, r.payload_digest) for r in index]
    assert order == sorted(order)


def test_null_ids(spark):
    rows = [(None, "http://a/", "p"), (3, "http://a/", "p"), (None, "http://b/", "q")]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), F.lit(None)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == sorted(
        [(None, "revisit", 3), (3, "response", None), (None, "response", None)], key=repr)


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((rng.randrange(20), j) for _ in range(rng.randrange(0, 12))), key=lambda r: r[0]) for j in range(k)]
        merged = list(LoserTree([iter(r) for r in runs], lambda r: r[0]))
        assert merged == sorted((x for r in runs for x in r), key=lambda r: r[0])


def test_url_keys():
    assert _url_key("https://www.A.example:443/P?q=1") == "example,a)/p?q=1"
    assert _url_key("http://a.example:8080") == "example,a:8080)/" and _url_key("") == "" and _url_key("http://[bad") == "http://[bad"
