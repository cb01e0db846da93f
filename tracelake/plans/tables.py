"""Grids, configurations and runs, registries, and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import configs as C
from ..operators import grids as G
from ..operators.ranking import numbered
from ..operators.retrieval import top_k
from ..runtime import table
from . import sqltext as q
from .define import Registry

R = Registry()
query = R.query

# --- grids: the price sheets among the documents, one sheet per document ----------------------------------------------


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return G.cells(table(spark, d, "documents").where("source = 'price-sheets'"), "doc_id", "text")


_NUM = f"coalesce(regexp_matches({q.strip('value')}, '{G.NUMBER}'), false)"
_GRID = f"""ln as (select doc_id as sheet, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as row from documents where source = 'price-sheets'),
cl as (select sheet, row, unnest(string_split(line, '|')) as v, generate_subscripts(string_split(line, '|'), 1) as col from ln where contains(line, '|')),
grid as (select sheet, cast(row as integer) as row, cast(col as integer) as col, {q.non_blank('v')} as value from cl),
prof as (select sheet, row, cast(count(value) as integer) as n_filled, cast(count(*) filter ({_NUM}) as integer) as n_numeric, coalesce(regexp_matches(lower(arg_min(value, col) filter (value is not null)), '{G.TOTALS}'), false) as has_total from grid group by 1, 2),
prof2 as (select *, has_total or (n_filled > 0 and n_filled = n_numeric) as is_summary from prof),
isl as (select sheet, row, min(col) as first_col, max(col) as last_col, cast(count(*) filter ({_NUM}) as integer) as n_numeric from (select *, col - row_number() over (partition by sheet, row order by col) as k from grid where value is not null) group by sheet, row, k),
hdr as (select sheet, min(row) as header_row, min(row) + 1 as data_start from prof where n_filled > 1 and n_numeric = 0 group by 1)"""


@query("FLT-15", f"with {_GRID} select * from prof2")
def flt_15(spark, d):
    return G.row_profile(_grid(spark, d))


@query("WIN-05", f"with {_GRID} select sheet, row as label_row, nr as value_row from (select *, lead(row) over w as nr, lead(n_numeric) over w as nn from prof window w as (partition by sheet order by row)) where n_numeric = 0 and nr = row + 1 and nn > 0")
def win_05(spark, d):
    return G.value_pairs(_grid(spark, d))


@query("WIN-06", f"with {_GRID} select * from hdr")
def win_06(spark, d):
    return G.header_rows(_grid(spark, d))


@query("WIN-07", f"with {_GRID} select * from isl")
def win_07(spark, d):
    return G.islands(_grid(spark, d))


@query("WIN-08", f"with {_GRID} select i.sheet, i.row, i.first_col, i.last_col, g.value as next_number from isl i left join grid g on g.sheet = i.sheet and g.row = i.row and g.col = i.last_col + 1 where i.n_numeric < i.last_col - i.first_col + 1")
def win_08(spark, d):
    """Text runs with the cell that follows them."""
    g = _grid(spark, d)
    after = g.select("sheet", "row", (F.col("col") - 1).alias("last_col"), F.col("value").alias("next_number"))
    return G.islands(g).where("n_numeric < last_col - first_col + 1").join(after, ["sheet", "row", "last_col"], "left").select("sheet", "row", "first_col", "last_col", "next_number")


@query("WIN-09", f"with {_GRID} select sheet, cast((row - 2) // 30 as bigint) as block, min(row) as first_row, max(row) as last_row, cast(count(value) as bigint) as n_cells from grid where row >= 2 group by 1, 2")
def win_09(spark, d):
    return G.blocks(_grid(spark, d))


_RANGES = "rg as (select sheet, row, col, row as min_row, row + 1 as max_row, col as min_col, col + 1 as max_col from grid)"


@query("FLT-14", f"with {_GRID}, {_RANGES}, hit as (select rg.sheet, rg.row, rg.col, count(distinct i.row) as n from rg join isl i on i.sheet = rg.sheet and i.row between rg.min_row and rg.max_row and i.first_col <= rg.min_col and i.last_col >= rg.max_col group by 1, 2, 3) select rg.sheet, rg.row, rg.col, coalesce(n = 2, false) as inside from rg left join hit using (sheet, row, col)")
def flt_14(spark, d):
    """Every range of two rows by two columns, inside the filled runs or not."""
    g = _grid(spark, d)
    at = F.struct("row", "col")
    ranges = g.select("sheet", at.alias("range_id"), F.col("row").alias("min_row"), (F.col("row") + 1).alias("max_row"), F.col("col").alias("min_col"), (F.col("col") + 1).alias("max_col"))
    return G.contained(ranges, G.islands(g)).select("sheet", "range_id.row", "range_id.col", "inside")


@query("FLT-16", f"with {_GRID} select distinct a.sheet, a.row from isl a join isl b on a.sheet = b.sheet and b.row = a.row + 1 and a.first_col <= b.last_col and b.first_col <= a.last_col")
def flt_16(spark, d):
    """Rows whose runs overlap a run of the row below (interval overlap behind an equi-join)."""
    i = G.islands(_grid(spark, d))
    a = i.select("sheet", "row", F.col("first_col").alias("a0"), F.col("last_col").alias("a1"))
    b = i.select("sheet", (F.col("row") - 1).alias("row"), F.col("first_col").alias("b0"), F.col("last_col").alias("b1"))
    return a.join(b, ["sheet", "row"]).where("a0 <= b1 and b0 <= a1").select("sheet", "row").distinct()


_REND = f"{_GRID}, hd as (select g.sheet, g.col, g.value as head from grid g join hdr h on h.sheet = g.sheet and h.header_row = g.row), bd as (select g.sheet, g.row, g.col, case when hd.head is null then g.value else hd.head || '：' || g.value end as t from grid g join hdr h on h.sheet = g.sheet and g.row >= h.data_start left join hd on hd.sheet = g.sheet and hd.col = g.col where g.value is not null)"


@query("SHE-01", f"with {_REND} select sheet, row, string_agg(t, '；' order by col) as evidence from bd group by 1, 2")
def she_01(spark, d):
    return G.rendered(_grid(spark, d))


@query("SHE-03", f"with {_REND} select sheet, row, string_agg(t, '；' order by col) as evidence from bd where col <= 3 group by 1, 2")
def she_03(spark, d):
    """Evidence of allowed fields only (the first three columns)."""
    return G.rendered(_grid(spark, d).where("col <= 3 or value is null"))


_MD = "ml as (select sheet, row, '| ' || string_agg(coalesce(value, ''), ' | ' order by col) || ' |' as line from grid group by 1, 2)"


@query("SHE-05", f"with {_GRID}, {_MD} select b.sheet, b.block, coalesce(max(h.line) || chr(10), '') || string_agg(b.line, chr(10) order by b.row) as markdown from (select *, cast((row - 2) // 30 as bigint) as block from ml where row >= 2) b left join ml h on h.sheet = b.sheet and h.row = 1 group by 1, 2 union all select sheet, 0, max(line) from ml group by 1 having max(row) = 1")
def she_05(spark, d):
    """Every block of a sheet as Markdown, all rows of all sheets."""
    return G.block_markdown(_grid(spark, d))


@query("SHE-06", f"with {_GRID} select distinct value as field_name from grid g join hdr h on h.sheet = g.sheet and h.header_row = g.row where value is not null")
def she_06(spark, d):
    g = _grid(spark, d)
    h = G.header_rows(g).select("sheet", F.col("header_row").alias("row"))
    return g.where("value is not null").join(h, ["sheet", "row"], "left_semi").select(F.col("value").alias("field_name")).distinct()


@query("JOI-18", f"with {_GRID} select g.sheet, g.row, g.col from grid g join hdr h on h.sheet = g.sheet and g.row >= h.data_start join (select sheet, row from prof2 where not is_summary) p on p.sheet = g.sheet and p.row = g.row where g.value is not null and g.col >= 2")
def joi_18(spark, d):
    """Candidate anchors: data rows by target columns, guarded; as an equi-join, the pairs are the cells themselves."""
    g = _grid(spark, d)
    rows = G.row_profile(g).where("not is_summary").join(G.header_rows(g), "sheet").where("row >= data_start").select("sheet", "row")
    return g.where("value is not null and col >= 2").join(rows, ["sheet", "row"], "left_semi").select("sheet", "row", "col")


_LETTERS = "case when {n} <= 26 then chr(cast({n} + 64 as integer)) when {n} <= 702 then chr(cast(({n} - 27) // 26 + 65 as integer)) || chr(cast(({n} - 27) % 26 + 65 as integer)) else chr(cast(({n} - 703) // 676 + 65 as integer)) || chr(cast((({n} - 703) // 26) % 26 + 65 as integer)) || chr(cast(({n} - 703) % 26 + 65 as integer)) end"


@query("PRJ-43", f"select p_partkey, {_LETTERS.format(n='n')} as letters, cast(n as integer) as back from (select p_partkey, p_partkey % 18278 + 1 as n from part)")
def prj_43(spark, d):
    """Column letters there and back."""
    n = F.col("p_partkey") % 18278 + 1
    return table(spark, d, "part").select("p_partkey", G.column_letters(n).alias("letters"), G.column_number(G.column_letters(n)).alias("back"))


@query("PRJ-44", f"with {_GRID} select sheet, row, 'A' || row || ':' || {_LETTERS.format(n='max(col)')} || row as cell_range from grid where value is not null group by 1, 2")
def prj_44(spark, d):
    last = G.column_letters(F.max("col"))
    g = _grid(spark, d).where("value is not null").groupBy("sheet", "row").agg(last.alias("l"))
    return g.select("sheet", "row", F.concat(F.lit("A"), F.col("row").cast("string"), F.lit(":"), "l", F.col("row").cast("string")).alias("cell_range"))


# --- configurations: parts stand for profiles, suppliers for runs ---------------------------------------------------

_FIELDS = ["p_brand", "p_type", "p_size"]
_FP = "left(sha256('{' || concat_ws(', ', " + ", ".join(f"'\"{f}\": \"' || nullif(trim(cast({f} as varchar)), '') || '\"'" for f in sorted(_FIELDS)) + ") || '}'), 16)"
_DUP = f"fp as (select *, {_FP} as fingerprint from part), dup as (select fingerprint, count(*) as n, arg_min(p_partkey, (p_retailprice, p_partkey)) as canonical from fp group by 1 having count(*) > 1)"


@query("PRJ-29", f"select p_partkey, {_FP} as fingerprint from part")
def prj_29(spark, d):
    return table(spark, d, "part").select("p_partkey", C.fingerprint(_FIELDS).alias("fingerprint"))


@query("PRJ-28", "select p_partkey, 'p_brand: ' || p_brand || ' | p_type: ' || p_type || ' | p_size: ' || p_size as summary from part")
def prj_28(spark, d):
    return table(spark, d, "part").select("p_partkey", C.summary(_FIELDS).alias("summary"))


@query("AGG-16", f"with {_DUP} select * from dup")
def agg_16(spark, d):
    return C.duplicate_groups(table(spark, d, "part"), "p_partkey", _FIELDS, "p_retailprice")


def _plan(spark, d):
    runs = table(spark, d, "supplier").select(F.col("s_name").alias("run"), F.col("s_suppkey").alias("p_partkey"))
    return C.cleanup_plan(table(spark, d, "part"), runs, "p_partkey", _FIELDS, "p_retailprice"), runs


_PLAN = f"{_DUP}, us as (select s_suppkey as p_partkey, count(*) as n_runs from supplier group by 1), pl as (select fp.p_partkey, canonical, case when fp.p_partkey = canonical then 'keep' when n_runs is not null then 'archive' else 'delete' end as action, coalesce(n_runs, 0) as n_runs from fp join dup using (fingerprint) left join us using (p_partkey))"


@query("AGG-17", f"with {_PLAN} select * from pl")
def agg_17(spark, d):
    return _plan(spark, d)[0]


@query("CFG-04", f"with {_PLAN} select coalesce(pl.canonical, s_suppkey) as p_partkey, count(*) as n from supplier left join pl on pl.p_partkey = s_suppkey group by 1")
def cfg_04(spark, d):
    """Runs after the merge of duplicate configurations."""
    plan, runs = _plan(spark, d)
    return C.rebind(runs, plan, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("CFG-01", "select snapshot_id, project_id from snapshots union all select distinct snapshot_id, null from samples where trim(snapshot_id) <> '' and snapshot_id not in (select snapshot_id from snapshots)")
def cfg_01(spark, d):
    """Profiles registered anew: snapshots that samples name and no table holds, beside those there are."""
    base = table(spark, d, "snapshots").select("snapshot_id", "project_id")
    new = table(spark, d, "samples").where("trim(snapshot_id) != ''").select("snapshot_id").distinct().join(base.select("snapshot_id"), "snapshot_id", "left_anti").withColumn("project_id", F.lit(None).cast("string"))
    return C.merge(base, new, "snapshot_id", [])


@query("CFG-02", "select snapshot_id, project_id, snapshot_type from snapshots where deleted_at is null")
def cfg_02(spark, d):
    return table(spark, d, "snapshots").where("deleted_at is null").select("snapshot_id", "project_id", "snapshot_type")


_USED = "us as (select snapshot_id, min(run_id) as run_id, count(*) as n from samples where trim(snapshot_id) <> '' group by 1)"


def _used(spark, d):
    return table(spark, d, "samples").where("trim(snapshot_id) != ''").groupBy("snapshot_id").agg(F.min("run_id").alias("run_id"), F.count("*").alias("n"))


@query("CFG-03", f"with {_USED} select s.snapshot_id, project_id, case when us.n is not null then 'used' else snapshot_type end as snapshot_type from snapshots s left join us using (snapshot_id)")
def cfg_03(spark, d):
    """An update from the samples: every snapshot they name becomes 'used'; its project, a protected field, stays although the update carries the run."""
    base = table(spark, d, "snapshots").select("snapshot_id", "project_id", "snapshot_type")
    update = _used(spark, d).join(base.select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", F.coalesce("run_id", F.lit("-")).alias("project_id"), F.lit("used").alias("snapshot_type"))
    return C.merge(base, update, "snapshot_id", ["project_id"])


@query("FLT-25", f"with {_USED} select s.snapshot_id, project_id, coalesce(us.n, trace_count) as trace_count from snapshots s left join us using (snapshot_id)")
def flt_25(spark, d):
    """Protected fields of an update are left out, its other fields are taken."""
    base = table(spark, d, "snapshots").select("snapshot_id", "project_id", "trace_count")
    update = _used(spark, d).join(base.select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", F.lit("x").alias("project_id"), F.col("n").alias("trace_count"))
    return C.merge(base, update, "snapshot_id", ["project_id"])


@query("RUN-01", "select run_id, min(config_id) as config_id, min(created_at) as started_at, count(*) as question_count from samples where run_id is not null group by 1")
def run_01(spark, d):
    """Run manifests."""
    return table(spark, d, "samples").where("run_id is not null").groupBy("run_id").agg(F.min("config_id").alias("config_id"), F.min("created_at").alias("started_at"), F.count("*").alias("question_count"))


@query("RUN-02", "select run_id, cast(row_number() over (order by s desc, run_id) as integer) as place from (select run_id, min(created_at) as s from samples where run_id is not null group by 1) order by place limit 100")
def run_02(spark, d):
    """The hundred newest runs (a listing's limit)."""
    r = table(spark, d, "samples").where("run_id is not null").groupBy("run_id").agg(F.min("created_at").alias("s")).orderBy(F.desc("s"), "run_id").limit(100)
    return r.select("run_id", F.row_number().over(Window.orderBy(F.desc("s"), "run_id")).alias("place"))


@query("RUN-03", "select snapshot_id, case when deleted_at is not null then 'deleted' else snapshot_type end as state, case when deleted_at is not null then snapshot_type end as before from snapshots")
def run_03(spark, d):
    """Edits with their history: the state before a deletion."""
    s = table(spark, d, "snapshots")
    edits = s.where("deleted_at is not null").select("snapshot_id", F.col("deleted_at").cast("timestamp_ntz").alias("edited_at"), F.lit("deleted").alias("value"), F.lit("end of life").alias("note"))
    out = C.with_history(s.select("snapshot_id", F.col("snapshot_type").alias("state")), edits, "snapshot_id", "state")
    return out.select("snapshot_id", "state", F.get("history", F.lit(0))["before"].alias("before"))


@query("REG-01", "select project_id, count(*) as n_snapshots, min(created_at) as first_seen from snapshots group by 1")
def reg_01(spark, d):
    return table(spark, d, "snapshots").groupBy("project_id").agg(F.count("*").alias("n_snapshots"), F.min("created_at").alias("first_seen"))


@query("REG-02", "select * from snapshots where snapshot_id = (select min(snapshot_id) from snapshots)")
def reg_02(spark, d):
    s = table(spark, d, "snapshots")
    return s.join(s.agg(F.min("snapshot_id").alias("snapshot_id")), "snapshot_id", "left_semi")


@query("REG-03", "select snapshot_id, list_sort(list_filter([case when project_id is null then 'project_id' end, case when snapshot_type is null then 'snapshot_type' end, case when created_at is null then 'created_at' end, case when trace_count is null then 'trace_count' end, case when coalesce(has_observations, false) and observation_count is null then 'observation_count' end], lambda x: x is not null)) as missing from snapshots")
def reg_03(spark, d):
    """The required fields that each registered snapshot lacks, as a sorted list."""
    need = {"project_id": None, "snapshot_type": None, "created_at": None, "trace_count": None, "observation_count": F.coalesce("has_observations", F.lit(False))}
    lacks = [F.when(F.col(c).isNull() & (on if on is not None else F.lit(True)), c) for c, on in need.items()]
    return table(spark, d, "snapshots").select("snapshot_id", F.array_sort(F.array_compact(F.array(*lacks))).alias("missing"))


@query("FLT-22", "select snapshot_id, case when snapshot_type <> 'frozen' then 'not_frozen' when not coalesce(has_observations, false) then 'no_observations' when coalesce(trace_count, 0) = 0 then 'empty' when observation_count < trace_count then 'incomplete' else 'eligible' end as state from snapshots")
def flt_22(spark, d):
    c = F.col
    state = F.when(c("snapshot_type") != "frozen", "not_frozen").when(~F.coalesce(c("has_observations"), F.lit(False)), "no_observations").when(F.coalesce(c("trace_count"), F.lit(0)) == 0, "empty").when(c("observation_count") < c("trace_count"), "incomplete").otherwise("eligible")
    return table(spark, d, "snapshots").select("snapshot_id", state.alias("state"))


@query("FLT-23", "with r as (select *, row_number() over (partition by project_id order by created_at desc, snapshot_id) as rn from snapshots) select snapshot_id from r where rn > 3 and parsed and snapshot_id not in (select snapshot_id from samples where snapshot_id is not null)")
def flt_23(spark, d):
    """What a clean-up may delete: parsed, not among the newest three of its project, referred to by nothing."""
    t = table(spark, d, "snapshots").select("project_id", "created_at", "snapshot_id", "parsed")
    old = numbered(t, ["project_id"], [F.desc("created_at"), F.col("snapshot_id")], "rn").where("rn > 3 and parsed")
    return old.join(table(spark, d, "samples").select("snapshot_id"), "snapshot_id", "left_anti").select("snapshot_id")


@query("SRT-07", "select project_id, arg_max(snapshot_id, (created_at, snapshot_id)) as snapshot_id from snapshots where has_observations and deleted_at is null group by 1")
def srt_07(spark, d):
    ok = table(spark, d, "snapshots").where("has_observations and deleted_at is null")
    return ok.groupBy("project_id").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))


@query("SRT-08", "select snapshot_id, snapshot_type || ' ' || strftime(created_at, '%Y-%m-%d') || ' (' || coalesce(trace_count, 0) || ')' as label from snapshots where deleted_at is null")
def srt_08(spark, d):
    label = F.concat("snapshot_type", F.lit(" "), F.date_format("created_at", "yyyy-MM-dd"), F.lit(" ("), F.coalesce("trace_count", F.lit(0)).cast("string"), F.lit(")"))
    return table(spark, d, "snapshots").where("deleted_at is null").select("snapshot_id", label.alias("label"))


@query("SRC-29", "select dataset_id, document_id, created_at from create_document where dataset_id is not null")
def src_29(spark, d):
    """The ledgers of all datasets; a filter on one dataset reaches the scan."""
    return table(spark, d, "create_document").where("dataset_id is not null").select("dataset_id", "document_id", "created_at")


@query("SRC-34", "select config_id, count(distinct run_id) as n_runs from samples where config_id is not null group by 1")
def src_34(spark, d):
    return table(spark, d, "samples").where("config_id is not null").groupBy("config_id").agg(F.countDistinct("run_id").alias("n_runs"))


@query("RNK-01", """with n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), p as (select a.vec_id as query_id, b.vec_id as row_id, list_cosine_similarity(a.e, b.e) as s from n a join n b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(rn as integer) as rank, row_id from (select *, row_number() over (partition by query_id order by s desc, row_id) as rn from p) where rn <= 10""")
def rnk_01(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    return top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).select("query_id", "rank", "row_id")


@query("PRJ-14", """with n as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), p as (select a.vec_id as query_id, b.vec_id as row_id, a.label = b.label as same, list_cosine_similarity(a.e, b.e) as s from n a join n b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(min(case when same then rn end) as integer) as first_hit from (select *, row_number() over (partition by query_id order by s desc, row_id) as rn from p) where rn <= 20 group by 1""")
def prj_14(spark, d):
    """The rank of the first relevant row (same label) among the twenty nearest."""
    e = table(spark, d, "embeddings")
    near = top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 20)
    labels = e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("row_label"))
    own = e.select(F.col("vec_id").alias("query_id"), "label")
    return near.join(labels, "row_id").join(own, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("row_label"), F.col("rank"))).alias("first_hit"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
