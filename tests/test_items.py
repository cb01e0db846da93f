"""Items of services: aliases, lists, success, hidden fields."""

import json

from pyspark.sql import functions as F

from tracelake.operators import items as I


def test_items(spark):
    cases = [
        ({"doc_id": " d1 ", "name": "a.txt", "topics": "x, ,y"}, ("a.txt", "d1", "p", "a.txt", ["x", "y"], "waiting", True, "")),
        ({"id": "d2", "document_id": "", "topics": ["t", " ", "u"], "indexing_status": "indexing"}, ("given", "d2", "p", "given", ["t", "u"], "indexing", True, "")),
        ({"filename": "b", "document_type": "law", "document_summary": "s", "indexing_status": "x"}, ("b", "", "p", "b", [], "completed", True, "")),
        ({"file_name": "c", "contract_package": "q", "document_title": "T"}, ("c", "", "q", "T", [], "completed", False, I.NO_ID)),
        ({"document_id": "d", "error_message": "full"}, ("given", "d", "p", "given", [], "waiting", False, "full")),
    ]
    texts = [json.dumps(c) for c, _ in cases] + ["[1]", "broken {", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    out = [r.i for r in df.select("k", I.ingested(F.col("t"), F.lit("p"), F.lit("given")).alias("i")).orderBy("k").collect()]
    assert [(r.file_name, r.document_id, r.package, r.title, list(r.topics), r.status, r.success, r.error) for r in out[:5]] == [w for _, w in cases]
    assert all(r.status == "error" and not r.success and r.file_name == "given" for r in out[5:])


def test_ids_and_hidden_fields(spark):
    shapes = ['{"document_id": "a"}', '{"outputs": {"document_id": "a"}}', '{"outputs": {"document_ids": ["a"]}}', '{"document_ids": ["a"]}', '{"document_ids": ["a", "b"]}', "x", None]
    df = spark.createDataFrame(list(enumerate(shapes)), "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(I.document_id_of(F.col("t"))).collect()] == ["a"] * 4 + [None] * 3
    m = spark.createDataFrame([({"token": "1", "tokens": "2", "at": "/etc/x", "win": "C:\\x", "share": "\\\\h", "n": None},)], "m map<string,string>")
    assert set(m.select(I.shown(F.col("m"))).first()[0]) == {"tokens", "n"}


def test_paged_stream_goes_on_behind_what_it_has_read(spark, tmp_path):
    from tracelake.sources.paged import _StreamReader, stream_pages

    size = tmp_path / "n"

    def _grows(kind, page, limit, size=str(size)):
        n = int(open(size).read())
        return [{"n": k} for k in range((page - 1) * limit, min(n, page * limit))]

    got = []
    for n in (0, 7, 7, 10, 61):
        size.write_text(str(n))
        q = stream_pages(spark, _grows, "x", 5).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(sorted(json.loads(r.payload)["n"] for r in spark.read.schema("payload string").json(str(tmp_path / "out")).collect()))
    assert got == [list(range(n)) for n in (0, 7, 7, 10, 61)]
    for n in range(0, 40):
        size.write_text(str(n))
        reader = _StreamReader(_grows, "x", 5)
        assert reader.latestOffset() == {"rows": n} and sum(s.high - s.low for s in reader.partitions({"rows": n // 3}, {"rows": n})) == n - n // 3
