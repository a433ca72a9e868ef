import hashlib

from corpusloom.llm import warc

LONG = "é<p>" * 60
PAGES = [(1, "http://a", LONG), (2, None, LONG), (0, "http://b\r\nX: y", "short"), (5, "http://c", "short"), (6, "u", None), (7, "u", ""), (2, "again", LONG), (9, "http://d", "WARC/1.1\r\n\r\n\r\n\r\n" * 30), (None, "n", LONG), (3, "v", "x" * 300000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def expected(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and p != first[h]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    for packed in ("none", "gzip"):
        assert sorted(map(tuple, warc.round_trip(pages(spark), compression=packed).collect()), key=str) == expected(PAGES)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_pushdown_and_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.round_trip(pages(spark), path)
    found = spark.read.format("warc").load(path).where("record_type = 'revisit'")
    assert sorted(r.record_id for r in found.collect()) == ["urn:page:2", "urn:page:2", "urn:page:null"]
    assert "record_type" not in found._jdf.queryExecution().executedPlan().toString().partition("Filter")[2].partition("BatchScan")[0]
    one = spark.read.format("warc").load(path).where("record_id = 'urn:page:1'").collect()
    assert [bytes(r.payload).decode() for r in one] == [LONG]
    assert spark.read.format("warc").option("partitionBytes", 1).load(path).where("target_uri like 'http://%'").count() == 4
    reader = warc.WarcReader(found.schema, {"path": path, "partitionBytes": 1})
    assert len(reader.partitions()) >= 1
