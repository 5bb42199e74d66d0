"""Round trips through the archives, against a plain reading of the rules."""

import gzip
import hashlib

from pyspark.sql import functions as F

from tabloom.llm.warc import WarcSettings, byte_ranges, place, read_warc, write_warc
from tabloom.session import work_dir

LONG = "<p>é\U0001f600 text</p>\r\n\r\nWARC/1.1\r\n" * 20
ROWS = [
    (5, "http://a/x?y=%20 z\r\nEvil: 1", LONG, "k"),
    (3, None, LONG, "k"),
    (9, "http://b/ü", LONG, None),
    (3, "http://tie", LONG, "k"),
    (None, "http://null-id", LONG, "k"),
    (1, "http://c", None, "k"),
    (2, "http://d", "", "k"),
    (4, "http://e", "short", "k"),
    (6, "http://f", "short", "k"),
    (7, "http://g", "y" * 99, "k"),
    (8, "http://h", "y" * 99, "k"),
    (10, "http://i", "z" * 100, "k"),
    (11, "http://j", "z" * 100, "k"),
    (12, "http://k", "big " * 200_000, "k"),
]
SCHEMA = "page_id long, url string, html string, file string"


def want(rows):
    first = {}
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            first[raw] = min(first.get(raw, page_id), page_id)
    out = []
    for page_id, url, html, _ in rows:
        raw = (html or "").encode()
        again = raw in first and page_id != first[raw]
        out.append((page_id, url, len(raw), hashlib.sha256(raw).hexdigest(),
                    "revisit" if again else "response", first[raw] if again else None, None if again else raw))
    return sorted(out, key=str)


def got(df):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(
        ((*[r[n] for n in names], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect()), key=str
    )


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for settings in (WarcSettings(), WarcSettings(file_bytes=100, gap_bytes=0, range_bytes=200)):
        path = work_dir(spark, "warc")
        index = write_warc(pages, path, settings)
        assert index.count() == len(ROWS)
        assert got(read_warc(index, path, settings)) == want(ROWS)


def test_selected_records_are_read_by_few_ranges(spark, sf):
    path = work_dir(spark, "warc")
    pages = spark.read.parquet(f"{sf}/pages.parquet").coalesce(1)
    index = write_warc(pages, path)
    some = index.where("page_id % 3 = 0")
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in read_warc(some, path).collect() if r["payload"]}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert back and all(html[k] == v for k, v in back.items())
    assert byte_ranges(some).count() < some.count() / 10
    near = byte_ranges(some, WarcSettings(gap_bytes=0)).agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
    assert near == some.agg(F.sum("length")).first()[0]


def test_archives_are_plain_warc_members(spark):
    path = work_dir(spark, "warc")
    index = write_warc(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path).orderBy("offset").collect()
    system, root = place(path)
    with system.open_input_file(f"{root}/{index[0]['file']}") as f:
        raw = gzip.decompress(f.read())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    assert raw.count(b"WARC-Type: revisit") == sum(w[4] == "revisit" for w in want(ROWS))


def test_empty_table(spark):
    path = work_dir(spark, "warc")
    index = write_warc(spark.createDataFrame([], SCHEMA), path)
    assert index.count() == 0 and read_warc(index, path).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    """As many reading tasks as the archives' bytes need, and a payload of many MB comes back whole."""
    import random

    rnd = random.Random(1)
    big = "".join(chr(rnd.randrange(32, 0x2FF)) for _ in range(3_000_000))
    rows = [(i, f"http://{i}", f"{i} " * 2000 + str(rnd.random()), "k") for i in range(300)] + [(999, "http://big", big, "k")]
    path, s = work_dir(spark, "warc"), WarcSettings(task_bytes=50_000, range_bytes=20_000)
    index = write_warc(spark.createDataFrame(rows, SCHEMA).repartition(4), path, s)
    read = read_warc(index, path, s)
    used = {r["p"] for r in read.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(used) > 4
    got = {r["page_id"]: r["payload"].decode() for r in read.collect()}
    assert got == {i: html for i, _, html, _ in rows}
