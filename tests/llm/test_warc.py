import base64
import hashlib

from pyspark.sql import functions as F

from graphloom.llm import warc

ROWS = [(1, "http://a/ ü\n", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, "http://c", None), (4, None, ""), (5, "http://d", "WARC/1.1\r\n\r\n" * 3), (7, "http://e", "x" * 300_000), (None, "http://f", "<p>é</p>"), (8, "http://g", "only"), (8, "http://g", "only")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id bigint, url string, html string, offset int")
    index = warc.write(pages)
    assert index.count() == len(ROWS)
    for gap, most in ((1 << 16, 1 << 23), (0, 1), (-1, 1 << 23)):
        got = warc.read(index, gap=gap, most=most).collect()
        by = {}
        for i, _, h in ROWS:
            by.setdefault(h or "", []).append(i)
        want = []
        for i, _, h in ROWS:
            b, top = (h or "").encode(), max(x for x in by[h or ""] if x is not None)
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
        assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
        assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {2: "<p>é</p>", 4: "", 5: ROWS[4][2], 7: ROWS[5][2], 8: "only"}
    some = warc.read(index.where(F.col("page_id") == 5)).collect()
    assert [r.page_id for r in some] == [5]


def test_small_payloads_and_empty(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    kinds = {(r.page_id, r.record_type) for r in warc.read(warc.write(pages, least_bytes=5), payloads=False).collect()}
    assert (3, "response") in kinds and (4, "response") in kinds and (1, "revisit") in kinds
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_members_are_gzip():
    import gzip

    z, _ = warc.record(3, "http://x/y z", b"abc", None, False)
    text = gzip.decompress(z)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"abc\r\n\r\n") and b"WARC-Target-URI: http://x/y%20z\r\n" in text


def test_tasks_by_the_size_of_archives(spark):
    """Many small records are read in several tasks, whatever their index weighs."""
    pages = spark.range(400).selectExpr("id page_id", "concat('http://x/', id) url", "repeat(sha2(cast(id as string), 256), 2000) html").repartition(3)
    index = warc.write(pages)
    got = warc.read(index, most=1 << 16)
    assert len(index.inputFiles()) <= 3 and got.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 3 and sum(r["count"] for r in parts) == 400


def test_bodies_shuffled_give_the_same(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_round_trip(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_against_plain_python(spark):
    from graphloom.llm.queries import op8_warc

    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    top = {}
    for i, b in pages.items():
        top[b] = max(i, top.get(b, i))
    want = sorted((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top[b] == i else "revisit", None if top[b] == i else top[b]) for i, b in pages.items())
    assert sorted(map(tuple, op8_warc(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want
