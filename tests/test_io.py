"""Sources and sinks, the registry, and that the core doesn't need the llm subpackage."""

import io
import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tracelake.operators.model import judge_with
from tracelake.sources import documents as D
from tracelake.sources import files
from tracelake.sources.jsonl import read_jsonl
from tracelake.sources.paged import LANES, read_all, read_pages

ROOT = Path(__file__).resolve().parent.parent


def test_quarantine(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"traceId": "t", "id": "1"}\n\n   \nnot json\n{"id": "2"}\n[1]\n{"traceId": " ", "id": "3"}\n')
    good, bad = read_jsonl(spark, str(tmp_path), "traceId string, id string", "traceId")
    assert [r.id for r in good.collect()] == ["1"]
    assert sorted(r.error for r in bad.collect()) == ["invalid json", "invalid json", "missing traceId", "missing traceId"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b",\n\nc '), (2, ""), (3, "，。")], "k long, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "k long, t string").collect()) == [(1, ' a "b",\n\nc '), (2, ""), (3, "，。")]


def test_all_or_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(ValueError):
        files.write_all_or_nothing(df, str(tmp_path / "x"), F.col("k") == 2)
    assert not (tmp_path / "x").exists()
    files.write_all_or_nothing(df, str(tmp_path / "x"), F.col("k") == 3)
    with pytest.raises(Exception):
        files.write_all_or_nothing(df, str(tmp_path / "x"), F.col("k") == 3)


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_files(spark, tmp_path):
    p = lambda t, s="": f"<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    docx = zipped({"word/document.xml": f'<w:document {W}><w:body>{p("Title", "<w:pStyle w:val=\"Heading1\"/>")}{p("text")}<w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}</w:tr></w:tbl></w:body></w:document>'})
    xlsx = zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Prices"/></sheets></workbook>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>bolt</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>price</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+1</f></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>',
    })
    for name, data in {"a.docx": docx, "b.xlsx": xlsx, "c.csv": "名称,价\n螺栓,5\n".encode("gb18030"), "d.txt": "one\n\n\ntwo".encode("utf-8-sig"), "e.pdf": b"%PDF", "f.docx": b"broken", "g.md": b""}.items():
        (tmp_path / name).write_bytes(data)
    out = {}
    for r in D.read_documents(spark, str(tmp_path)).collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert [(r.kind, r.heading, r.text) for r in out["a.docx"]] == [("paragraph", "Title", "Title"), ("paragraph", "Title", "text"), ("table", "Title", "| a | b |\n| --- | --- |\n| 1 |  |")]
    assert [r.text for r in out["b.xlsx"]] == [f"name：bolt；price：{D.UNCACHED}", "name：bolt"] and out["b.xlsx"][0].sheet_name == "Prices"
    assert [r.text for r in out["c.csv"]] == ["名称：螺栓；价：5"] and [r.text for r in out["d.txt"]] == ["one", "two"]
    assert out["e.pdf"][0].error.startswith("unsupported") and out["f.docx"][0].error and "g.md" not in out
    assert D.is_numbered_heading("第三章 总则") and D.is_numbered_heading("1.2 范围") and not D.is_numbered_heading("合同")


def test_paged_source(spark):
    def _fails(kind, page, limit):
        if page == 2:
            raise TimeoutError("no")
        return [{"n": page}]

    rows = read_pages(spark, _fails, "x", 3).collect()
    assert sorted((r.page, r.payload, r.error) for r in rows) == [(1, '{"n": 1}', None), (2, None, "no"), (3, '{"n": 3}', None)]


@pytest.mark.parametrize("n", [0, 1, 10, 40, 1234])
def test_paged_source_reads_on_to_the_end(spark, n):
    def _serves(kind, page, limit):
        if page == 12:
            raise TimeoutError("no")
        return [{"n": k} for k in range((page - 1) * limit, min(n, page * limit))]

    rows = read_all(spark, _serves, "x", 10).collect()
    assert sorted(json.loads(r.payload)["n"] for r in rows if r.payload) == [k for k in range(n) if k // 10 != 11]
    assert [(r.page, r.error) for r in rows if r.error] == ([(12, "no")] if n > 30 else [])


def test_paged_source_of_a_dead_service_ends(spark):
    def _dead(kind, page, limit):
        raise TimeoutError("no")

    errors = [r.error for r in read_all(spark, _dead, "x").collect()]
    assert sum(e.startswith("given up") for e in errors) == LANES and len(errors) == 4 * LANES


def test_model_errors_stay_in_their_row(spark):
    def _client(prompt):
        if prompt.startswith("bad"):
            raise RuntimeError("refused")
        return '{"answer_correct": 1}'

    df = spark.createDataFrame([("a", "good", "x"), ("b", "bad", None)], "judge_key string, question string, final_answer string")
    assert {r.judge_key: (r.answer_correct, r.error) for r in judge_with(df, _client).collect()} == {"a": (1, None), "b": (None, "refused")}


def test_entry_and_registry(spark, sf):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 200
    df = entry.entry(spark)
    assert df.count() > 0 and "final_answer" in df.columns


def test_sinks_of_all_datasets(spark, sf):
    """Every document is stored and every chunk exported, with each export column that the table has."""
    q = entry.queries()
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("create_document", "chunk_catalog")}
    assert q["SNK-23"](spark, sf).where("version = 1").count() == n["create_document"].count()
    out = q["SNK-06"](spark, sf)
    assert out.count() == n["chunk_catalog"].count() and out.select("dataset_id").distinct().count() == n["chunk_catalog"].select("dataset_id").distinct().count()
    assert set(out.columns) == set(n["chunk_catalog"].columns) - {"created_at", "deleted_at"}


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['tracelake.llm'] = None; import tracelake.plans.registry as r; assert len(r.queries()) > 150; assert not any(m.startswith('tracelake.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=120).returncode == 0


def test_polling():
    from tracelake.sources.poll import poll_until

    answers = iter([0, 0, 3])
    assert poll_until(lambda: next(answers), bool, 60, 5, iter(range(0, 99, 5)).__next__, lambda s: None) == ("ready", 3)
    assert poll_until(lambda: 0, bool, 12, 5, iter(range(0, 99, 5)).__next__, lambda s: None) == ("timeout", 2)
