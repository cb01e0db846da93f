"""Sinks and sources as round trips through the shared folder, and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, non_blank
from ..runtime import new_path, table
from ..sources import files
from ..sources.documents import file_fingerprints, read_documents
from ..sources.jsonl import read_jsonl, write_jsonl
from ..streaming.dedup import read_stream
from ..streaming.sync import sync, synced, windowed
from .define import Registry

R = Registry()
query = R.query


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("sample_id", "trace_id", "run_id", "question", "final_answer", "reference_answer")


@query("SNK-01", "select sample_id, trace_id, run_id, question, final_answer, reference_answer from samples")
def snk_01(spark, d):
    """JSON lines and back."""
    path = new_path(spark, "jsonl")
    write_jsonl(_rows(spark, d), path)
    good, _ = read_jsonl(spark, path, _rows(spark, d).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), "trace_id")
    return good.drop("file_name")


@query("SNK-02", "select count(*) as n_samples, count(distinct run_id) as n_runs, count(*) filter (coalesce(final_answer, '') = '') as n_unanswered, count(*) as n_stored from samples")
def snk_02(spark, d):
    """The summary that is stored beside the samples: a one-row envelope and the rows it speaks of, both read back."""
    path = new_path(spark, "summary")
    rows = _rows(spark, d)
    s = rows.agg(F.count("*").alias("n_samples"), F.countDistinct("run_id").alias("n_runs"), F.count_if(F.coalesce("final_answer", F.lit("")) == "").alias("n_unanswered"))
    write_jsonl(rows, f"{path}/samples")
    s.coalesce(1).write.json(f"{path}/summary")
    stored = spark.read.schema("sample_id bigint").json(f"{path}/samples").agg(F.count("*").alias("n_stored"))
    return spark.read.schema(s.schema).json(f"{path}/summary").crossJoin(stored)  # one row each


@query("SNK-03", "select sample_id, question from samples")
def snk_03(spark, d):
    path = new_path(spark, "batch")
    write_jsonl(_rows(spark, d).select("sample_id", "question"), path)
    return spark.read.schema("sample_id bigint, question string").json(path)


@query("SNK-04", "select sample_id from samples where coalesce(final_answer, '') <> ''")
def snk_04(spark, d):
    """Only rows that succeeded."""
    path = new_path(spark, "raw")
    write_jsonl(_rows(spark, d).where("coalesce(final_answer, '') != ''").select("sample_id"), path)
    return spark.read.schema("sample_id bigint").json(path)


@query("SNK-05", "select sample_id, coalesce(question, '') as question, coalesce(final_answer, '') as final_answer from samples")
def snk_05(spark, d):
    """CSV with quoting that survives line breaks and quotes, and back."""
    path = new_path(spark, "csv")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("question", "final_answer")]
    files.write_csv(_rows(spark, d).select("sample_id", *blank), path)
    return files.read_csv(spark, path, "sample_id bigint, question string, final_answer string")


#: The survey's columns of a catalog export, all but index_node_id and index_node_hash, which the table hasn't.
_EXPORT = ["segment_id", "chunk_position", "document_id", "document_name", "dataset_id", "content", "summary", "tokens", "word_count", "enabled", "status", "content_hash"]
_TEXTS = [c for c in _EXPORT if c not in ("chunk_position", "tokens", "word_count", "enabled")]


@query("SNK-06", f"select chunk_row, {', '.join(f"coalesce({c}, '') as {c}" if c in _TEXTS else c for c in _EXPORT)} from chunk_catalog")
def snk_06(spark, d):
    """The catalog of all datasets as CSV, and back; NULL texts come back empty."""
    path = new_path(spark, "csv")
    c = table(spark, d, "chunk_catalog").select("chunk_row", *_EXPORT)
    files.write_csv(c.fillna("", _TEXTS), path)
    return files.read_csv(spark, path, ", ".join(f"{x} {t}" for x, t in c.dtypes))


@query("SNK-08", "select dataset_id, count(*) as n, sum(tokens) as tokens from chunk_catalog group by 1")
def snk_08(spark, d):
    """The whole catalog as CSV, partitioned by dataset."""
    path = new_path(spark, "csv")
    table(spark, d, "chunk_catalog").select("dataset_id", "chunk_row", "tokens").write.partitionBy("dataset_id").option("header", "true").csv(path)
    return spark.read.schema("chunk_row bigint, tokens bigint, dataset_id string").option("header", "true").csv(path).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SNK-07", "select chunk_row, content_hash from chunk_catalog")
def snk_07(spark, d):
    path = new_path(spark, "json")
    c = table(spark, d, "chunk_catalog").select("chunk_row", "content_hash")
    write_jsonl(c, path)
    return spark.read.schema(c.schema).json(path)


@query("SNK-09", "select dataset_id, count(*) as n_chunks, cast(sum(tokens) as bigint) as n_tokens, count(*) as n_stored from chunk_catalog group by 1")
def snk_09(spark, d):
    """The catalog with its metadata: counters per dataset stored beside the rows of each, both read back."""
    path = new_path(spark, "json")
    c = table(spark, d, "chunk_catalog").select("dataset_id", "chunk_row", "segment_id", "content", "tokens")
    write_jsonl(c, f"{path}/chunks")
    c.groupBy("dataset_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("n_tokens")).write.json(f"{path}/metadata")
    meta = spark.read.schema("dataset_id string, n_chunks bigint, n_tokens bigint").json(f"{path}/metadata")
    stored = spark.read.schema("dataset_id string, chunk_row bigint").json(f"{path}/chunks").groupBy(F.col("dataset_id").alias("own")).agg(F.count("*").alias("n_stored"))
    return meta.join(stored, F.col("dataset_id").eqNullSafe(F.col("own"))).drop("own")


@query("SNK-10", "select question_set_id, count(*) as n from questions group by 1")
def snk_10(spark, d):
    """Question sets as partitions; reading one set only lists its folder."""
    path = new_path(spark, "sets")
    table(spark, d, "questions").select("question_set_id", "question_row", "question").write.partitionBy("question_set_id").parquet(path)
    return spark.read.schema("question_row bigint, question string, question_set_id string").parquet(path).groupBy("question_set_id").agg(F.count("*").alias("n"))


@query("SNK-11", "select question_row, coalesce(question, '') as question from questions")
def snk_11(spark, d):
    path = new_path(spark, "csv")
    files.write_csv(table(spark, d, "questions").select("question_row", F.coalesce("question", F.lit("")).alias("question")), path)
    return files.read_csv(spark, path, "question_row bigint, question string")


@query("SNK-12", "select question_row, question from questions")
def snk_12(spark, d):
    path = new_path(spark, "json")
    write_jsonl(table(spark, d, "questions").select("question_row", "question"), path)
    return spark.read.schema("question_row bigint, question string").json(path)


@query("SNK-13", "select question_set_id, count(*) as n, count(*) filter (coalesce(trim(expected_segment_id), '') <> '') as n_bound from questions where question_mode = 'chunk_exact' group by 1")
def snk_13(spark, d):
    """Exact-match sets with their manifest rows."""
    path = new_path(spark, "manifest")
    t = table(spark, d, "questions").where("question_mode = 'chunk_exact'")
    t.groupBy("question_set_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("expected_segment_id"), F.lit("")) != "").alias("n_bound")).write.json(path)
    return spark.read.schema("question_set_id string, n bigint, n_bound bigint").json(path)


@query("SNK-21", "select document_id, dataset_id from create_document union all select document_id, dataset_id from create_document where deleted_at is not null")
def snk_21(spark, d):
    """An append-only history: a second append leaves the first as it was."""
    path = new_path(spark, "history")
    t = table(spark, d, "create_document")
    t.select("document_id", "dataset_id").write.mode("append").json(path)
    t.where("deleted_at is not null").select("document_id", "dataset_id").write.mode("append").json(path)
    return spark.read.schema("document_id string, dataset_id string").json(path)


@query("SNK-22", "select document_id, case when coalesce(trim(text), '') = '' then '' else 'hashed' end as state from create_document")
def snk_22(spark, d):
    """The consistency ledger: content hash per stored document."""
    path = new_path(spark, "ledger")
    t = table(spark, d, "create_document").select("document_id", content_hash("text").alias("h"))
    t.write.mode("append").parquet(path)
    return spark.read.parquet(path).select("document_id", F.when(F.col("h") == "", "").otherwise("hashed").alias("state"))


@query("SNK-25", "select count(*) as n_written, 0 as n_rejected_runs from samples where question_mode = 'chunk_exact' and coalesce(trim(expected_segment_id), '') || coalesce(trim(expected_content_hash), '') <> '' and coalesce(trim(trace_id), '') <> '' and trace_id not like 'batch_qa_%'")
def snk_25(spark, d):
    """All or nothing: the writer refuses a batch with one invalid row, and writes the valid one into a new folder only."""
    bad = (F.coalesce(F.concat(F.coalesce(F.trim("expected_segment_id"), F.lit("")), F.coalesce(F.trim("expected_content_hash"), F.lit(""))), F.lit("")) == "") | non_blank("trace_id").isNull() | F.col("trace_id").startswith("batch_qa_")
    t = table(spark, d, "samples").where("question_mode = 'chunk_exact'").select("sample_id", "trace_id", "expected_segment_id", "expected_content_hash")
    path = new_path(spark, "retry")
    refused = 0
    try:
        files.write_all_or_nothing(t.withColumn("trace_id", F.lit("batch_qa_0")), new_path(spark, "refused"), bad)
    except ValueError:
        refused = 1
    files.write_all_or_nothing(t.where(~bad), path, bad)
    return spark.read.parquet(path).agg(F.count("*").alias("n_written")).withColumn("n_rejected_runs", F.when(F.col("n_written") > 0, 1 - refused).otherwise(0))


@query("SNK-27", "select 'trace' as kind, count(*) as n from traces union all select 'observation', count(*) from observations")
def snk_27(spark, d):
    """Traces and observations exported as one set of JSON lines."""
    path = new_path(spark, "export")
    t = table(spark, d, "traces").select(F.lit("trace").alias("kind"), F.to_json(F.struct("delivery_id", "trace_id", "input")).alias("row"))
    o = table(spark, d, "observations").select(F.lit("observation").alias("kind"), F.to_json(F.struct("obs_key", "traceid", "output")).alias("row"))
    write_jsonl(t.unionByName(o), path)
    return spark.read.schema("kind string, row string").json(path).groupBy("kind").agg(F.count("*").alias("n"))


@query("SRC-14", "select count(*) as n_files, count(*) filter (trim(text, ' ' || chr(10) || chr(13) || chr(9)) = '') as n_empty from create_document where text is not null")
def src_14(spark, d):
    """Documents as files: text files written, listed and parsed into blocks."""
    path = new_path(spark, "docs")
    files.write_text_files(table(spark, d, "create_document").where("text is not null").select("document_id", "text"), "document_id", "text", path)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path")
    parsed = read_documents(spark, path, "*.txt").where("error is null").select("path").distinct().withColumn("filled", F.lit(1))
    return names.join(parsed, "path", "left").agg(F.count("*").alias("n_files"), F.count_if(F.col("filled").isNull()).alias("n_empty"))


@query("PRJ-31", "select count(*) as n_files, count(distinct content) as n_distinct from (select text as content from create_document where text is not null)")
def prj_31(spark, d):
    """Fingerprints of files: as many as there are different contents (sizes and both ends tell them apart here)."""
    path = new_path(spark, "docs")
    files.write_text_files(table(spark, d, "create_document").where("text is not null").select("document_id", "text"), "document_id", "text", path)
    return file_fingerprints(spark, path).agg(F.count("*").alias("n_files"), F.countDistinct("fingerprint").alias("n_distinct"))


@query("SRC-15", r"select document_id, cast(len(list_filter(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n[\s\x{3000}\x{a0}]*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) <> '')) as bigint) as n_blocks from create_document where text is not null and trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) <> ''")
def src_15(spark, d):
    path = new_path(spark, "docs")
    files.write_text_files(table(spark, d, "create_document").where("text is not null").select("document_id", "text"), "document_id", "text", path)
    b = read_documents(spark, path, "*.txt").where("error is null")
    return b.groupBy(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("document_id")).agg(F.count("*").alias("n_blocks"))


@query("STR-01", "select 'roots' as store, count(distinct id) as n from observations where type = 'TRACE' union all select 'rest', count(distinct id) from (select id, bool_or(type = 'TRACE') over (partition by id) as root from observations) where root is distinct from true")
def str_01(spark, d):
    """Incremental synchronisation: each id once, roots and the rest in two stores."""
    folder = new_path(spark, "sync")
    sync(read_stream(spark, f"{d}/observations.parquet").select("id", "type", "obs_key"), folder, "id", "type", "TRACE", "obs_key")
    return synced(spark, folder, "roots").select(F.lit("roots").alias("store"), "id").unionByName(synced(spark, folder, "rest").select(F.lit("rest").alias("store"), "id")).where("id is not null").groupBy("store").agg(F.count("*").alias("n"))


def _events(spark, d):
    return read_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "user_id", "value")


@query("events_tumbling", "select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n from events group by all")
def events_tumbling(spark, d):
    return windowed(_events(spark, d), new_path(spark, "windows"), "at", F.window("at", "1 hour"), ["event_type"], [F.count("*").alias("n")])


@query("events_sliding", "select time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' as window_start, time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' + interval '1 hour' as window_end, count(*) as n from events, (values (0), (1), (2), (3)) v(k) group by all")
def events_sliding(spark, d):
    return windowed(_events(spark, d), new_path(spark, "windows"), "at", F.window("at", "1 hour", "15 minutes"), [], [F.count("*").alias("n")])


@query("events_sessions", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as opened from events), s as (select *, sum(opened) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select min(ts) as window_start, max(ts) + interval '30 minutes' as window_end, user_id, count(*) as n from s group by user_id, k""")
def events_sessions(spark, d):
    return windowed(_events(spark, d), new_path(spark, "windows"), "at", F.session_window("at", "30 minutes"), ["user_id"], [F.count("*").alias("n")], sessions=True)


@query("STR-02", "select snapshot_id, cast(1 as integer) as version from snapshots union all select snapshot_id, 2 from snapshots where deleted_at is null")
def str_02(spark, d):
    """Versions of a store: an older version stays as it was when a newer one is written."""
    path = new_path(spark, "versions")
    s = table(spark, d, "snapshots")
    files.write_version(s.select("snapshot_id"), path, 1)
    files.write_version(s.where("deleted_at is null").select("snapshot_id"), path, 2)
    return files.read_version(spark, path, 1).withColumn("version", F.lit(1)).unionByName(files.read_version(spark, path, 2).withColumn("version", F.lit(2)))


@query("STR-04", "select run_id, arg_min(source_file_name, (created_at, sample_id)) as file_name from samples where run_id is not null and source_file_name is not null group by 1")
def str_04(spark, d):
    """The run index: the first file of a run wins."""
    t = table(spark, d, "samples").where("run_id is not null and source_file_name is not null")
    return t.groupBy("run_id").agg(F.min_by("source_file_name", F.struct("created_at", "sample_id")).alias("file_name"))


@query("STR-05", "select snapshot_id, parsed or (has_observations and deleted_at is null) as parsed from snapshots")
def str_05(spark, d):
    return table(spark, d, "snapshots").select("snapshot_id", (F.col("parsed") | (F.col("has_observations") & F.col("deleted_at").isNull())).alias("parsed"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
