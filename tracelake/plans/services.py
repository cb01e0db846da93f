"""Services, office files, rendered artifacts, prompts and the accounting of generation stages."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsons import first_array, get, json_object
from ..functions.text import content_hash, non_blank
from ..operators import grids as G
from ..operators import items as I
from ..operators import render as T
from ..operators import reports as P
from ..operators.model import judge_with
from ..runtime import materialise, new_path, table
from ..sources.documents import NUMBERED_HEADINGS, UNCACHED, read_cells, read_documents
from ..sources.files import write_files
from ..sources.jsonl import read_jsonl, write_jsonl
from ..sources.paged import read_all, read_pages
from ..sources.service import TableService
from . import judging
from . import sqltext as q
from .define import Registry
from .tables import _GRID, _MD, _REND, _grid

R = Registry()
query = R.query

# --- paged services ---------------------------------------------------------------------------------------------------


def _pulled(spark: SparkSession, d: str, kind: str, schema: str, pages: int | None, limit: int, broken: tuple[int, ...] = ()) -> DataFrame:
    """The rows of one pull from a service that serves the tables."""
    client = TableService(d, broken)
    p = read_all(spark, client, kind, limit) if pages is None else read_pages(spark, client, kind, pages, limit)
    return p.select(F.from_json("payload", schema).alias("r"), "page", "error")


@query("SRC-04", "select 'row' as what, delivery_id as id from (select delivery_id, row_number() over (order by delivery_id) as rn from traces) where rn <= 250 and (rn - 1) // 50 <> 2 union all select 'error', 3")
def src_04(spark, d):
    """Five pages of traces from a service that fails on the third: it costs only its own rows, and stands as an error."""
    p = _pulled(spark, d, "traces", "delivery_id bigint", 5, 50, (3,))
    return p.where("error is null or page = 3").select(F.when(F.col("error").isNull(), "row").otherwise("error").alias("what"), F.when(F.col("error").isNull(), F.col("r.delivery_id")).otherwise(F.col("page").cast("bigint")).alias("id"))


@query("SRC-05", "select delivery_id, trace_id from traces order by delivery_id limit 50")
def src_05(spark, d):
    """One page of traces."""
    return _pulled(spark, d, "traces", "delivery_id bigint, trace_id string", 1, 50).select("r.*")


@query("SRC-06", "select obs_key, type from observations where traceid = (select min(traceid) from observations) order by obs_key limit 100")
def src_06(spark, d):
    """The observations of one trace: one page of at most 100."""
    trace = table(spark, d, "observations").agg(F.min("traceid")).first()[0]
    return _pulled(spark, d, f"observations:{trace}", "obs_key bigint, type string", 1, 100).select("r.*")


@query("SRC-08", "select distinct dataset_id from create_document where dataset_id is not null order by 1 limit 100")
def src_08(spark, d):
    """The first hundred datasets."""
    return _pulled(spark, d, "datasets", "dataset_id string", 1, 100).select("r.*")


@query("SRC-09", "select document_id, dataset_id from create_document order by document_id limit 20")
def src_09(spark, d):
    """One page of documents."""
    return _pulled(spark, d, "documents", "document_id string, dataset_id string", 1, 20).select("r.*")


@query("SRC-10", "select document_id, dataset_id from create_document")
def src_10(spark, d):
    """All documents, page by page until a page is empty."""
    return _pulled(spark, d, "documents", "document_id string, dataset_id string", None, 20).select("r.*")


@query("SRC-11", "select chunk_row, segment_id from chunk_catalog where status = 'completed' order by chunk_row limit 100")
def src_11(spark, d):
    """One page of completed segments: the service applies the filter."""
    return _pulled(spark, d, "completed", "chunk_row bigint, segment_id string", 1, 100).select("r.*")


@query("SRC-12", "select chunk_row, segment_id, status from chunk_catalog")
def src_12(spark, d):
    """All segments, page by page until a page is empty."""
    return _pulled(spark, d, "segments", "chunk_row bigint, segment_id string, status string", None, 100).select("r.*")


@query("SRC-13", "select case when c.deleted_at is not null then 'archived' when c.document_id not in (select document_id from chunk_catalog where document_id is not null) then 'no_segments' else 'pulled' end as state, count(*) as n from create_document c group by 1")
def src_13(spark, d):
    """A full catalog pull: what becomes of every document."""
    have = table(spark, d, "chunk_catalog").where("document_id is not null").select("document_id").distinct().withColumn("have", F.lit(True))
    t = table(spark, d, "create_document").join(have, "document_id", "left")
    return t.groupBy(F.when(F.col("deleted_at").isNotNull(), "archived").when(F.col("have").isNull(), "no_segments").otherwise("pulled").alias("state")).agg(F.count("*").alias("n"))


@query("STR-03", "with n as (select d.document_id, count(c.document_id) as n from create_document d left join chunk_catalog c on c.document_id = d.document_id group by 1) select document_id, case when n = 0 or n % 17 > 10 then 'timeout' else 'ready' end as outcome, cast(case when n = 0 or n % 17 > 10 then 11 else n % 17 + 1 end as integer) as n_polls from n")
def str_03(spark, d):
    """Polling for the segments of every document, with an injected clock: they appear after some polls, or not in time."""
    from ..sources.poll import poll_until

    def run(parts):
        for part in parts:
            out = []
            for document, n in zip(part["document_id"], part["n"]):
                seen = iter([0] * (n % 17) + [n] * 99)
                now = [0.0]
                asked = poll_until(lambda seen=seen: next(seen), lambda x: x > 0, 52, 5, lambda now=now: now[0], lambda s, now=now: now.__setitem__(0, now[0] + s))
                out.append((document, *asked))
            yield pd.DataFrame(out, columns=["document_id", "outcome", "n_polls"])

    segments = table(spark, d, "chunk_catalog").groupBy("document_id").agg(F.count("*").alias("n"))
    waiting = table(spark, d, "create_document").select("document_id").join(segments, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n"))
    return waiting.mapInPandas(run, "document_id string, outcome string, n_polls int")


# --- files ------------------------------------------------------------------------------------------------------------

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")  # not allowed in XML


def _xml(t: str) -> str:
    return escape(_UNSAFE.sub("", t))


def _zipped(entries: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v.encode("utf-8", "replace"))
    return b.getvalue()


def _word(text: str) -> bytes:
    """A text as a Word document, a paragraph a line."""
    body = "".join(f"<w:p><w:r><w:t>{_xml(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    return _zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def _sheet(cells: list, merge: bool = False, formula=lambda c: False) -> bytes:
    """The cells of a grid as a workbook of one sheet; rows keep their numbers. With ``merge`` an empty cell is merged with the
    filled one before it; where ``formula`` holds, a formula without a cached value stands for the value."""
    rows: dict[int, list] = {}
    spans, held = [], {(c["row"], c["col"]): c["value"] for c in cells}
    for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
        ref = f'{_letters(c["col"])}{c["row"]}'
        if c["value"] is None:
            if held.get((c["row"], c["col"] - 1)) is not None:
                spans.append(f'<mergeCell ref="{_letters(c["col"] - 1)}{c["row"]}:{ref}"/>')
        elif formula(c):
            rows.setdefault(c["row"], []).append(f'<c r="{ref}"><f>1+1</f></c>')
        else:
            rows.setdefault(c["row"], []).append(f'<c r="{ref}" t="inlineStr"><is><t>{_xml(c["value"])}</t></is></c>')
    data = "".join(f'<row r="{n}">{"".join(cs)}</row>' for n, cs in rows.items())
    merged = f"<mergeCells>{''.join(spans)}</mergeCells>" if merge and spans else ""
    return _zipped({"xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{data}</sheetData>{merged}</worksheet>"})


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _csv(cells: list) -> bytes:
    """The rows with a filled cell as CSV in a legacy encoding."""
    rows: dict[int, dict[int, str]] = {}
    for c in cells:
        rows.setdefault(c["row"], {})[c["col"]] = c["value"]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([[r.get(k, "") for k in range(1, max(r) + 1)] for _, r in sorted(rows.items())])
    return out.getvalue().encode("gb18030", "replace")


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """(name, cells): the filled cells of every price sheet, which is as many as one sheet holds."""
    cells = _grid(spark, d).where("value is not null").groupBy("sheet").agg(F.collect_list(F.struct("row", "col", "value")).alias("cells"))
    return cells.select(F.col("sheet").cast("string").alias("name"), "cells")


def _made(df: DataFrame, make, ext: str) -> DataFrame:
    """(name, content) of files built from each row's second column."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"name": part["name"] + ext, "content": [make(x) for x in part.iloc[:, 1]]})

    return df.mapInPandas(run, "name string, content binary")


def _office(spark: SparkSession, d: str, *kinds: str) -> str:
    """A folder of files of the kinds asked for: documents as Word files, price sheets as workbooks and CSV, old workbooks."""
    path = new_path(spark, "office")
    docs = table(spark, d, "create_document").where("text is not null").select(F.col("document_id").alias("name"), "text")
    old = table(spark, d, "collectors").select(F.col("collector_id").alias("name"), F.lit("\u00d0\u00cf").alias("text"))
    makers = {"docx": lambda: _made(docs, _word, ".docx"), "xlsx": lambda: _made(_sheets(spark, d), _sheet, ".xlsx"), "csv": lambda: _made(_sheets(spark, d), _csv, ".csv"), "xls": lambda: _made(old, lambda t: t.encode("latin-1"), ".xls")}
    for kind in kinds:
        write_files(makers[kind](), "name", "content", path)
    return path


def _parsed(spark, d, *kinds):
    return read_documents(spark, _office(spark, d, *kinds), "*").withColumn("name", F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1))


_LINES = f"ls as (select document_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from create_document where text is not null), pg as (select document_id, n, {q.strip('line')} as t from ls where {q.non_blank('line')} is not null)"
_HEAD = "|".join(NUMBERED_HEADINGS)
_FILLED = f"{_GRID}, fl as (select sheet, row, col, value from grid where value is not null), r0 as (select sheet, min(row) as r0 from fl group by 1), hd0 as (select fl.sheet, fl.col, fl.value as head from fl join r0 on r0.sheet = fl.sheet and r0.r0 = fl.row), bl as (select fl.sheet, fl.row, string_agg(coalesce(head, fl.col::varchar) || '：' || fl.value, '；' order by fl.col) as text, dense_rank() over (partition by fl.sheet order by fl.row) + 1 as n from fl join r0 on r0.sheet = fl.sheet and fl.row > r0.r0 left join hd0 on hd0.sheet = fl.sheet and hd0.col = fl.col group by 1, 2)"


@query("SRC-16", f"with {_LINES} select document_id, count(*) as n_paragraphs, count(*) filter (h > 0) as n_headed from (select *, sum(case when regexp_matches(t, '{_HEAD}') then 1 else 0 end) over (partition by document_id order by n) as h from pg) group by 1")
def src_16(spark, d):
    """Word documents: their paragraphs, and how many stand under a heading."""
    return _parsed(spark, d, "docx").groupBy(F.col("name").alias("document_id")).agg(F.count("*").alias("n_paragraphs"), F.count_if(F.col("heading") != "").alias("n_headed"))


@query("SRC-17", f"with {_FILLED} select sheet, row as row_number, text from bl")
def src_17(spark, d):
    """Workbooks: one block per row below the header, with its number."""
    return _parsed(spark, d, "xlsx").select(F.col("name").cast("bigint").alias("sheet"), "row_number", "text")


@query("SRC-18", f"with {_FILLED} select sheet, text from bl")
def src_18(spark, d):
    """CSV in a legacy encoding."""
    return _parsed(spark, d, "csv").select(F.col("name").cast("bigint").alias("sheet"), "text")


@query("SRC-19", "select collector_id as name, 'unsupported: xls' as error from collectors")
def src_19(spark, d):
    """The binary sheet format needs a library that isn't there: an error row a file, no crash."""
    return _parsed(spark, d, "xls").select("name", "error")


@query("SRC-25", f"with {_FILLED} select sheet, cast(max(n) as integer) as last_row, count(*) as n_rows from bl group by 1")
def src_25(spark, d):
    """Rows of every CSV file, and the number of its last one."""
    return _parsed(spark, d, "csv").groupBy(F.col("name").cast("bigint").alias("sheet")).agg(F.max("row_number").alias("last_row"), F.count("*").alias("n_rows"))


@query("SRC-26", f"with {_FILLED} select sheet, cast(sum(len(text) - len(replace(text, chr(65533), ''))) as bigint) as n_replaced from bl group by 1")
def src_26(spark, d):
    """The encoding probe: decoding adds no replacement character."""
    p = _parsed(spark, d, "csv").select(F.col("name").cast("bigint").alias("sheet"), F.regexp_count("text", F.lit("\ufffd")).alias("n"))
    return p.groupBy("sheet").agg(F.sum("n").alias("n_replaced"))


@query("SRC-27", f"with {_FILLED}, {_LINES} select 'csv' as ext, count(*) as n from bl union all select 'xlsx', count(*) from bl union all select 'docx', count(*) from pg union all select 'xls', count(*) from collectors")
def src_27(spark, d):
    """Dispatch on the extension: blocks per kind of file."""
    return _parsed(spark, d, "csv", "xlsx", "docx", "xls").groupBy(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@query("SRC-20", f"with {_LINES} select document_id, cast(count(*) filter (regexp_matches(t, '{_HEAD}')) as integer) as n_headings from pg group by 1")
def src_20(spark, d):
    """Numbered headings per document: paragraphs that begin like one."""
    lines = F.transform(F.split("text", "\n"), lambda x: non_blank(x))
    t = table(spark, d, "create_document").where("text is not null").select("document_id", F.array_compact(lines).alias("lines")).where(F.size("lines") > 0)
    return t.select("document_id", F.size(F.filter("lines", lambda x: x.rlike(_HEAD))).alias("n_headings"))


@query("SRC-21", f"with {_GRID}, ls as (select sheet, row, list(coalesce(value, '') order by col) as cs, count(value) as n from grid group by 1, 2 having count(value) > 0), hs as (select sheet, arg_min(len(cs), row) as w from ls group by 1) select sheet, row, '| ' || array_to_string(list_resize(cs, w, ''), ' | ') || ' |' as line from ls join hs using (sheet)")
def src_21(spark, d):
    """Table rows as Markdown, as wide as the first of them: shorter rows are filled up, longer ones cut, empty ones left out."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"])
    lines = _grid(spark, d).groupBy("sheet", "row").agg(cells.alias("cells"), F.count("value").alias("n")).where("n > 0")
    wide = lines.groupBy("sheet").agg(F.min_by(F.size("cells"), "row").alias("w"))
    sized = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("w"))), F.lit(1), F.col("w"))
    return lines.join(wide, "sheet").select("sheet", "row", F.concat(F.lit("| "), F.array_join(sized, " | "), F.lit(" |")).alias("line"))


def _workbooks(spark: SparkSession, d: str, make) -> DataFrame:
    """The cells of workbooks made of all price sheets, empty cells included, and read back."""
    path = new_path(spark, "books")
    cells = _grid(spark, d).groupBy("sheet").agg(F.collect_list(F.struct("row", "col", "value")).alias("cells"))  # a sheet's cells
    write_files(_made(cells.select(F.col("sheet").cast("string").alias("name"), "cells"), make, ".xlsx"), "name", "content", path)
    return read_cells(spark, path).select(F.regexp_extract("path", r"([0-9-]+)\.xlsx$", 1).cast("bigint").alias("sheet"), "row", "col", "value", "uncached")


@query("SRC-22", f"with {_GRID} select sheet, row, col, case when col % 3 = 0 then '{UNCACHED}' else value end as shown, col % 3 = 0 as uncached from grid where value is not null")
def src_22(spark, d):
    """Workbooks in which every third column holds formulas without a cached value: a mark stands for them."""
    return _workbooks(spark, d, lambda cells: _sheet(cells, formula=lambda c: c["col"] % 3 == 0)).select("sheet", "row", "col", F.col("value").alias("shown"), "uncached")


@query("SRC-23", f"with {_GRID}, m as (select *, lag(value) over w as v1, lag(col) over w as c1 from grid window w as (partition by sheet, row order by col)) select sheet, row, col, coalesce(value, case when c1 = col - 1 then v1 end) as value from m where coalesce(value, case when c1 = col - 1 then v1 end) is not null")
def src_23(spark, d):
    """Workbooks in which empty cells are merged with the filled ones before them, as one long grid."""
    return _workbooks(spark, d, lambda cells: _sheet(cells, merge=True)).select("sheet", "row", "col", "value")


@query("SRC-24", f"with {_GRID} select sheet, max(row) as n_rows, max(col) as n_cols, count(*) as n_cells from grid where value is not null group by 1")
def src_24(spark, d):
    """The extent of every sheet of a workbook and its filled cells."""
    return _workbooks(spark, d, _sheet).groupBy("sheet").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"), F.count("value").alias("n_cells"))


@query("SRC-28", "select dataset_id, count(*) as n from create_document group by 1")
def src_28(spark, d):
    """An ingestion history with a broken line in it, which is skipped."""
    path = new_path(spark, "history")
    write_jsonl(table(spark, d, "create_document").select("dataset_id", "document_id"), path)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    good, _ = read_jsonl(spark, path, "dataset_id string, document_id string", "document_id")
    return good.groupBy("dataset_id").agg(F.count("*").alias("n"))


@query("SRC-30", "select document_id from create_document where text is not null")
def src_30(spark, d):
    """Stored objects without the sidecars beside them."""
    path = new_path(spark, "objects")
    docs = table(spark, d, "create_document").where("text is not null")
    for ext, content in ((".txt", F.col("text")), (".metadata.json", F.to_json(F.struct("document_id", "dataset_id"))), (".cleaned.txt", F.trim("text"))):
        write_files(docs.select(F.concat("document_id", F.lit(ext)).alias("name"), content.alias("content")), "name", "content", path)
    stored = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return stored.where(~F.col("name").rlike(r"\.(metadata\.json|chunks\.json|cleaned\.txt)$")).select(F.regexp_replace("name", r"\.txt$", "").alias("document_id"))


@query("SNK-23", "select document_id, 1 as version from create_document union all select document_id, 2 from create_document where deleted_at is null")
def snk_23(spark, d):
    """Versioned puts of the documents of all datasets."""
    return _stored_versions(spark, table(spark, d, "create_document"))


def _stored_versions(spark: SparkSession, t: DataFrame) -> DataFrame:
    path = new_path(spark, "vault")
    t.select("document_id", "text").write.parquet(f"{path}/version=1")
    t.where("deleted_at is null").select("document_id", "text").write.parquet(f"{path}/version=2")
    return spark.read.parquet(path).select("document_id", F.col("version").cast("int").alias("version"))


@query("SNK-24", f"select document_id, {q.content_hash('text')} as content_hash, cast(length(text) as integer) as n_chars from create_document")
def snk_24(spark, d):
    """Sidecars: metadata beside the stored text."""
    path = new_path(spark, "sidecar")
    t = table(spark, d, "create_document").select("document_id", content_hash("text").alias("content_hash"), F.length("text").alias("n_chars"))
    write_jsonl(t, path)
    return spark.read.schema("document_id string, content_hash string, n_chars int").json(path)


# --- rendered artifacts -----------------------------------------------------------------------------------------------



_KIND = "case when not has_old or not has_new then 'unpaired' when o is not null and n is null then 'evidence_lost' when o is not null and n > o then 'ranking_regression' when oh <> nh then 'judge_disagreement' else 'unchanged' end"
_CELL = "case when regexp_matches({c}, '[\",\\n\\r]') then '\"' || replace({c}, '\"', '\"\"') || '\"' else {c} end"


@query("SNK-19", f"{judging._PAIR} select {_CELL.format(c='question_id')} || ',' || coalesce(cast(o as varchar), '') || ',' || coalesce(cast(n as varchar), '') || ',' || coalesce(cast(oh as varchar), '') || ',' || coalesce(cast(nh as varchar), '') || ',' || {_KIND} as line from al")
def snk_19(spark, d):
    """The comparison of two runs as CSV lines: question, both ranks of the evidence, both verdicts, and the kind of difference."""
    rows = judging._pair(spark, d).select("question_id", F.col("old.rank").alias("o"), F.col("new.rank").alias("n"), F.col("old.top5_hit").alias("oh"), F.col("new.top5_hit").alias("nh"), P.diff_class().alias("kind"))
    path = new_path(spark, "diff")
    rows.select(T.csv_line("question_id", "o", "n", "oh", "nh", "kind").alias("line")).write.option("lineSep", "\x1e").text(path)
    return spark.read.option("lineSep", "\x1e").text(path).withColumnRenamed("value", "line")


_DIFF_KINDS = ("evidence_lost", "ranking_regression", "judge_disagreement", "unchanged")
_DIFF_HEAD = ["# Comparison", "", "## Summary", ""]
_CUT_HEAD = ["", "## By cutoff", "", "| cutoff | old | new | change | loss | evidence_lost | ranking_drop | gain |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]


@query("SNK-20", f"""{judging._PAIR}, c as (select k, coalesce(o <= k, false) as was, coalesce(n <= k, false) as now, n is null as gone from al, (values (1), (3), (5)) v(k) where has_old and has_new),
ct as (select k, '| Top' || k || ' | ' || count(*) filter (was) || ' | ' || count(*) filter (now) || ' | ' || (count(*) filter (now) - count(*) filter (was)) || ' | ' || count(*) filter (was and not now) || ' | ' || count(*) filter (was and not now and gone) || ' | ' || count(*) filter (was and not now and not gone) || ' | ' || count(*) filter (not was and now) || ' |' as line from c group by 1),
su as (select '- aligned: ' || count(*) filter (has_old and has_new) || chr(10) || '- missing_in_old: ' || count(*) filter (not has_old) || chr(10) || '- missing_in_new: ' || count(*) filter (not has_new){''.join(f" || chr(10) || '- {k}: ' || count(*) filter ({_KIND} = '{k}')" for k in _DIFF_KINDS)} as t from al)
select {"'" + "' || chr(10) || '".join(_DIFF_HEAD) + "'"} || chr(10) || su.t || chr(10) || {"'" + "' || chr(10) || '".join(_CUT_HEAD) + "'"} || coalesce(chr(10) || (select string_agg(line, chr(10) order by k) from ct), '') as document from su""")
def snk_20(spark, d):
    """The comparison as a Markdown report: what was aligned, the kinds of difference, and hits by cutoff (a few lines)."""
    pairs = materialise(judging._pair(spark, d), "pairs")
    n = lambda cond: F.count_if(cond).cast("string")
    old, new = F.col("old").isNotNull(), F.col("new").isNotNull()
    facts = [("aligned", old & new), ("missing_in_old", ~old), ("missing_in_new", ~new)] + [(k, P.diff_class() == k) for k in _DIFF_KINDS]
    summary = pairs.agg(F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), n(cond)) for name, cond in facts]).alias("t"))
    line = F.concat(F.lit("| Top"), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("k", "old_hits", "new_hits", "delta", "loss", "evidence_lost", "ranking_drop", "gain")]), F.lit(" |"))
    cuts = P.cutoff_stats(pairs).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("x")).select(F.transform("x", lambda x: x["line"]).alias("lines"))  # three lines
    parts = F.concat(F.array(*[F.lit(t) for t in _DIFF_HEAD], F.col("t"), *[F.lit(t) for t in _CUT_HEAD]), "lines")
    return summary.crossJoin(cuts).select(F.array_join(parts, "\n").alias("document"))


def _sql_cells(cells: str, line: str) -> str:
    return f"{judging._REPORT_SQL} select part, {line.format(c=cells)} as line from rep"


def _html(rows: DataFrame) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return rows.select("part", row.alias("line"))


def _markdown(rows: DataFrame) -> DataFrame:
    row = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    return rows.select("part", row.alias("line"))


def _pages(spark, lines: DataFrame, name: str, heads: dict[int, list[str]], feet: list[str]) -> DataFrame:
    """A report written as text, one file a part: heading lines, rows in order, closing lines; read back as (part, line)."""
    path = new_path(spark, name)
    fixed = [(part, 0, n, t) for part, ts in heads.items() for n, t in enumerate(ts)] + [(part, 2, n, t) for part in heads for n, t in enumerate(feet)]
    all_ = lines.select("part", F.lit(1).alias("at"), F.lit(0).alias("n"), "line").unionByName(spark.createDataFrame(fixed, "part int, at int, n int, line string"))
    all_.repartition("part").sortWithinPartitions("part", "at", "n", "line").select("part", F.regexp_replace("line", "[\r\n]+", " ").alias("line")).write.partitionBy("part").text(path)
    return spark.read.text(path).select(F.col("part").cast("int").alias("part"), F.col("value").alias("line"))


def _sql_fixed(heads: dict[int, list[str]], feet: list[str]) -> str:
    quoted = lambda t: t.replace("'", "''")
    return " union all ".join(f"select {part}, '{quoted(t)}'" for part, ts in heads.items() for t in [*ts, *feet])


_MD_HEADS = {part: [f"## {title}", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)] for part, (title, cols) in judging.PARTS.items()}
_HTML_HEADS = {part: [f"<h2>{title}</h2>", "<table>", "<tr>" + "".join(f"<th>{c}</th>" for c in cols) + "</tr>"] for part, (title, cols) in judging.PARTS.items()}
_HTML_LINE = "'<tr>' || array_to_string(list_transform({c}, lambda x: '<td>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>'), '') || '</tr>'"
_MD_LINE = "'| ' || array_to_string(list_transform({c}, lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |'"


@query("SNK-17", f"{_sql_cells('cells', _HTML_LINE)} union all {_sql_fixed(_HTML_HEADS, ['</table>'])}")
def snk_17(spark, d):
    """The HTML report: tracks, groups, ranks and failures as tables, stored a file a part and read back line by line."""
    return _pages(spark, _html(judging.report_rows(spark, d)), "html", _HTML_HEADS, ["</table>"])


@query("SNK-18", f"{_sql_cells('cells', _MD_LINE)} union all {_sql_fixed(_MD_HEADS, [])}")
def snk_18(spark, d):
    """The Markdown report, in the same parts."""
    return _pages(spark, _markdown(judging.report_rows(spark, d)), "markdown", _MD_HEADS, [])


_FACTS = f"{judging._REPORT_SQL} select '# Facts' || chr(10) || string_agg('- ' || array_to_string(cells, ' / '), chr(10) order by part, array_to_string(cells, ' / ')) as document from rep where part in (1, 3)"


@query("AGG-26", _FACTS)
def agg_26(spark, d):
    """The deterministic part of an analysis: what the tracks and ranks hold, one line each (a few dozen at most)."""
    c = judging.report_rows(spark, d).where("part in (1, 3)").select("part", F.array_join("cells", " / ").alias("t")).select("part", "t", F.concat(F.lit("- "), "t").alias("line"))
    return T.document(c, ["part", "t"], "line", ["# Facts"])


@query("SNK-26", _FACTS)
def snk_26(spark, d):
    """The report stored as a file and read back."""
    path = new_path(spark, "report")
    agg_26(spark, d).coalesce(1).write.text(path)
    lines = spark.read.text(path, wholetext=True).where("value != ''")
    return lines.select(F.regexp_replace("value", "\n$", "").alias("document"))


@query("SRT-04", f"{judging._RES}, f as (select sample_id, coalesce(source_file_name, '') as f, length(coalesce(question, '')) as n from results where top5_hit = 0), r as (select *, row_number() over (partition by f order by sample_id) as rn from f) select count(*) filter (rn <= 20) as kept, count(*) as n_all, sum(least(n, 100)) filter (rn <= 20) as n_chars from r")
def srt_04(spark, d):
    """A context within its budget: at most twenty failures per file, at most 100 characters of each (a report's limits)."""
    from ..operators.reports import capped

    f = judging.results(spark, d).where("top5_hit = 0").select("sample_id", F.coalesce("source_file_name", F.lit("")).alias("f"), F.length(F.coalesce("question", F.lit(""))).alias("n"))
    kept = capped(f, ["f"], [F.col("sample_id")], 20).agg(F.count("*").alias("kept"), F.sum(F.least("n", F.lit(100))).alias("n_chars"))
    return kept.crossJoin(f.agg(F.count("*").alias("n_all"))).select("kept", "n_all", "n_chars")


# --- prompts, replies and generation stages ---------------------------------------------------------------------------

# The places of the templates by track.
TEMPLATES = {
    "retrieval": "Question: {question}\nQuery: {retrieval_query}\nEvidence: {gold_evidence}",
    "strict_qa": "Question: {question}\nAnswer: {final_answer}\nReference: {reference_answer}",
    "grounded_qa": "Question: {question}\nAnswer: {final_answer}",
}


_SHEET_PROMPT = "Write questions about the rows of a sheet.\n\n[Sheet]\n{sheet}\n\n[Columns]\n{columns}\n\n[Rows]\n{rows}\n\n[Reply]\nA JSON array of objects with question, sheet, row and column."


@query("LLM-10", f"""with {_GRID}, {_MD}, b0 as (select sheet, string_agg(line, chr(10) order by row) as rows from ml where row < {2 + G.BLOCK_ROWS} group by 1), cs as (select g.sheet, string_agg(g.value, '、' order by g.col) as cols from grid g join hdr h on h.sheet = g.sheet and h.header_row = g.row group by 1)
select sheet, md5(replace(replace(replace({"'" + _SHEET_PROMPT.replace(chr(10), "' || chr(10) || '") + "'"}, '{{sheet}}', sheet::varchar), '{{columns}}', coalesce(cols, '(none)')), '{{rows}}', rows)) as prompt_md5 from b0 left join cs using (sheet)""")
def llm_10(spark, d):
    """The prompt of a sheet: its columns and its first block, which is what a prompt has room for; later blocks are prompts of their own."""
    g = _grid(spark, d)
    first = G.block_markdown(g).where("block = 0").select("sheet", F.col("markdown").alias("rows"))
    h = G.header_rows(g).select("sheet", F.col("header_row").alias("row"))
    cols = g.where("value is not null").join(h, ["sheet", "row"], "left_semi").groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), "、").alias("cols"))
    prompt = T.filled(_SHEET_PROMPT, sheet=F.col("sheet"), columns=F.col("cols"), rows=F.col("rows"))
    return first.join(cols, "sheet", "left").select("sheet", F.md5(prompt).alias("prompt_md5"))


@query("LLM-12", "select count(*) as n_rows, count(distinct question_id) as n_questions from questions where trim(coalesce(question, '')) <> ''")
def llm_12(spark, d):
    """A batch of questions asked through a client: one row per question, failures isolated."""

    def client(prompt: str) -> str:
        return json.dumps({"answer_correct": len(prompt) % 2})

    rows = table(spark, d, "questions").where("trim(coalesce(question, '')) != ''").select(F.col("question_row").cast("string").alias("judge_key"), "question", F.lit("").alias("final_answer"), "question_id")
    asked = judge_with(rows.drop("question_id"), client)
    return asked.join(rows.select("judge_key", "question_id"), "judge_key").agg(F.count("*").alias("n_rows"), F.countDistinct("question_id").alias("n_questions"))


@query("LLM-08", f"with {_GRID}, c as (select case when is_summary then 'summary_row' when n_filled < 2 then 'too_few_cells' else 'accepted' end as outcome from prof2) select outcome, count(*) as n from c group by 1")
def llm_08(spark, d):
    """The accounting of sheet candidates: accepted and rejected rows by reason."""
    p = G.row_profile(_grid(spark, d))
    return p.groupBy(F.when(F.col("is_summary"), "summary_row").when(F.col("n_filled") < 2, "too_few_cells").otherwise("accepted").alias("outcome")).agg(F.count("*").alias("n"))


_ROLE = f"with {_GRID}, r as (select g.sheet, g.col, count(*) filter ({q.non_blank('value')} is not null) as n, count(*) filter (coalesce(regexp_matches(value, '{G.NUMBER}'), false)) as num from grid g join hdr h on h.sheet = g.sheet and g.row >= h.data_start group by 1, 2)"


def _roles(spark, d):
    g = _grid(spark, d)
    body = g.join(G.header_rows(g), "sheet").where("row >= data_start").groupBy("sheet", "col").agg(F.count("value").alias("n"), F.count_if(G.is_number(F.col("value"))).alias("num"))
    return body.withColumn("role", F.when(F.col("n") == 0, "empty").when(F.col("num") * 2 > F.col("n"), "value").otherwise("label"))


@query("LLM-09", f"{_ROLE} select sheet, col, case when n = 0 then 'empty' when num * 2 > n then 'value' else 'label' end as role from r")
def llm_09(spark, d):
    """Column roles from the data alone."""
    return _roles(spark, d).select("sheet", "col", "role")


@query("PRJ-40", f"{_ROLE}, hs as (select g.sheet, g.col, g.value as head from grid g join hdr h on h.sheet = g.sheet and h.header_row = g.row) select r.sheet, '[' || string_agg('{{\"col\":' || r.col || ',\"name\":' || to_json(coalesce(head, '列' || r.col))::varchar || ',\"role\":\"' || case when n = 0 then 'empty' when num * 2 > n then 'value' else 'label' end || '\"}}', ',' order by r.col) || ']' as schema from r left join hs on hs.sheet = r.sheet and hs.col = r.col group by 1")
def prj_40(spark, d):
    """A sheet's schema as JSON: number, name and role of each column; columns without a name get the default one."""
    g = _grid(spark, d)
    h = G.header_rows(g).select("sheet", F.col("header_row").alias("row"))
    heads = g.join(h, ["sheet", "row"], "left_semi").select("sheet", "col", F.col("value").alias("head"))
    one = F.struct("col", F.coalesce("head", F.concat(F.lit("列"), F.col("col").cast("string"))).alias("name"), "role")
    return _roles(spark, d).join(heads, ["sheet", "col"], "left").groupBy("sheet").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("schema"))


@query("LLM-11", f"{judging._RES} select coalesce(nullif(source_file_name, ''), '(unknown)') as source_key, count(*) as n, cast(ceil(count(*) / 4.0) as bigint) as n_batches from results where top5_hit = 0 group by 1")
def llm_11(spark, d):
    """The manifest of a map-reduce analysis: failures per source and the batches of four they make."""
    f = judging.results(spark, d).where("top5_hit = 0").groupBy(F.coalesce(F.nullif("source_file_name", F.lit("")), F.lit("(unknown)")).alias("source_key")).agg(F.count("*").alias("n"))
    return f.withColumn("n_batches", F.ceil(F.col("n") / 4))


@query("LLM-13", f"with {_REND} select sheet, row, length(string_agg(t, '；' order by col)) as n_chars from bd group by 1, 2")
def llm_13(spark, d):
    """Rendered evidence of the legacy sheet path, by its length."""
    return G.rendered(_grid(spark, d)).select("sheet", "row", F.length("evidence").cast("bigint").alias("n_chars"))


@query("SHE-02", f"with {_REND} select sheet, row, col, t as pair from bd")
def she_02(spark, d):
    """Header and value aligned by column, one pair per cell."""
    g = _grid(spark, d)
    h = G.header_rows(g)
    heads = g.join(h.select("sheet", F.col("header_row").alias("row")), ["sheet", "row"]).select("sheet", "col", F.col("value").alias("head"))
    body = g.join(h, "sheet").where("row >= data_start and value is not null").join(heads, ["sheet", "col"], "left")
    return body.select("sheet", "row", "col", F.when(F.col("head").isNull(), F.col("value")).otherwise(F.concat("head", F.lit("："), "value")).alias("pair"))


@query("SHE-04", f"with {_REND} select sheet, row, cast(count(*) as integer) as n_pairs from bd group by 1, 2")
def she_04(spark, d):
    return she_02(spark, d).groupBy("sheet", "row").agg(F.count("*").cast("int").alias("n_pairs"))


@query("SHE-07", "select document_id, sha256(text) as file_hash, count(*) over (partition by sha256(text)) > 1 as cached from create_document where text is not null")
def she_07(spark, d):
    """A cache by content hash: contents seen more than once are answered from it."""
    t = table(spark, d, "create_document").where("text is not null").select("document_id", F.sha2("text", 256).alias("file_hash"))
    n = t.groupBy("file_hash").agg(F.count("*").alias("n"))
    return t.join(n, "file_hash").select("document_id", "file_hash", (F.col("n") > 1).alias("cached"))


_ANCHORS = f"{_GRID}, hd1 as (select g.sheet, g.col, g.value as label from grid g join hdr h on h.sheet = g.sheet and h.header_row = g.row), an as (select g.sheet, g.row, g.col, g.value, label, case when g.value is null then 'empty' when h.data_start is null then 'no_header' when g.row < h.data_start then 'above_data' when is_summary then 'summary_row' when label is null then 'no_label' when regexp_matches(lower(label), '{G.TOTALS}') then 'aggregate_label' end as reason from grid g left join hdr h on h.sheet = g.sheet join prof2 p on p.sheet = g.sheet and p.row = g.row left join hd1 on hd1.sheet = g.sheet and hd1.col = g.col)"


@query("FLT-18", f"with {_ANCHORS} select sheet, row, col, reason from an")
def flt_18(spark, d):
    """The checks of a question's anchor composed over every cell: the first rule that fails names the reason."""
    return G.anchors(_grid(spark, d)).select("sheet", "row", "col", "reason")


@query("FLT-19", f"with {_ANCHORS} select sheet, row, col, label || '：' || value as evidence from an where reason is null")
def flt_19(spark, d):
    """Accepted anchors with their rendered evidence."""
    return G.anchors(_grid(spark, d)).where("reason is null").select("sheet", "row", "col", F.concat("label", F.lit("："), "value").alias("evidence"))


@query("FLT-17", f"{_ROLE}, {_ANCHORS.removeprefix(_GRID + ', ')} select an.sheet, an.row, an.col, coalesce(regexp_matches(value, '{G.NUMBER}'), false) as numeric_value, not coalesce(regexp_matches(value, '{G.NUMBER}'), false) or num * 2 > n as consistent from an join r on r.sheet = an.sheet and r.col = an.col where reason is null")
def flt_17(spark, d):
    """A number may only be asked for in a column of values: accepted anchors against the role of their column."""
    g = _grid(spark, d)
    a = G.anchors(g).where("reason is null").join(_roles(spark, d).select("sheet", "col", "role"), ["sheet", "col"])
    number = G.is_number(F.col("value"))
    return a.select("sheet", "row", "col", number.alias("numeric_value"), (~number | (F.col("role") == "value")).alias("consistent"))


@query("FLT-21", f"with {_ANCHORS} select sheet, coalesce(reason, 'accepted') as reason, count(*) as n from an group by 1, 2")
def flt_21(spark, d):
    """What the checks made of each sheet's cells."""
    return G.anchors(_grid(spark, d)).groupBy("sheet", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


_PATH_SQL = " or ".join(f"starts_with(coalesce(json_extract_string(m, '$.\"' || k || '\"'), ''), '{p}')" for p in I.PATHS)


@query("PRJ-25", f"select obs_key, list_sort(list_filter(json_keys(m), lambda k: k not in {I.HIDDEN} and not ({_PATH_SQL}))) as fields from (select obs_key, {q.obj('metadata')} as m from observations) where m is not null")
def prj_25(spark, d):
    """Metadata without secrets, payloads and paths of a machine: the fields that are left."""
    t = table(spark, d, "observations").select("obs_key", json_object("metadata").alias("m")).where("m is not null")
    return t.select("obs_key", F.array_sort(F.map_keys(I.shown(F.col("m")))).alias("fields"))


@query("PRJ-32", "select collector_id, rtrim('https://' || lower(collector_name) || '.example//', '/') as host from collectors")
def prj_32(spark, d):
    url = F.concat(F.lit("https://"), F.lower("collector_name"), F.lit(".example//"))
    return table(spark, d, "collectors").select("collector_id", F.regexp_replace(url, "/+$", "").alias("host"))


@query("PRJ-35", f"select obs_key, case when json_exists(o, '$.result') then 'result' when json_exists(o, '$.answer') then 'answer' when json_exists(o, '$.text') then 'text' when o is not null then 'object' when output is not null then 'plain' end as envelope from (select obs_key, output, {q.obj('output')} as o from observations)")
def prj_35(spark, d):
    """Which envelope a payload comes in."""
    t = table(spark, d, "observations").select("obs_key", "output", json_object("output").alias("o"))
    has = lambda k: F.map_contains_key("o", k)
    return t.select("obs_key", F.when(has("result"), "result").when(has("answer"), "answer").when(has("text"), "text").when(F.col("o").isNotNull(), "object").when(F.col("output").isNotNull(), "plain").alias("envelope"))


@query("PRJ-36", f"select obs_key, cast(coalesce(json_array_length(json_extract(o, '$.result')), 0) as integer) as n_items from (select obs_key, {q.obj('output')} as o from observations where type = 'SPAN')")
def prj_36(spark, d):
    t = table(spark, d, "observations").where("type = 'SPAN'").select("obs_key", json_object("output").alias("o"))
    return t.select("obs_key", F.coalesce(F.json_array_length(first_array(get("o", "result"))), F.lit(0)).alias("n_items"))




def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
