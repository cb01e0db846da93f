"""CSV, text files, versioned folders, and writers that refuse invalid batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, every text quoted, so that quotes, commas and line breaks survive."""
    df.write.options(header="true", quoteAll="true", escape='"', emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Counterpart of ``write_csv``; records may span lines, NULL and the empty text are not told apart (both read as '')."""
    options = {"header": "true", "escape": '"', "multiLine": "true", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    out = spark.read.schema(schema).options(**options).csv(path)
    return out.fillna("")


def write_files(df: DataFrame, name: str, content: str, path: str) -> None:
    """One file per row, named and filled by two columns (texts are written as UTF-8), by the tasks themselves.

    Works on every file system that pyarrow knows (local, hdfs, s3, gs). A file is written under another name and moved to its
    own, so a task that runs twice leaves the same file.
    """

    def run(parts):
        import uuid

        import pandas as pd
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for part in parts:
            for n, data in zip(part["name"], part["content"]):
                draft = f"{root}/_{uuid.uuid4().hex}.part"
                with fs.open_output_stream(draft) as out:
                    out.write(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else bytes(data))
                fs.move(draft, f"{root}/{n}")
            yield pd.DataFrame({"n": [len(part)]})

    df.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def write_text_files(df: DataFrame, key: str, text: str, path: str) -> None:
    """One text file per row, named by its key."""
    write_files(df.select(F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("name"), F.col(text).alias("content")), "name", "content", path)


def write_all_or_nothing(df: DataFrame, path: str, invalid: Column) -> None:
    """Write a batch into a new folder only if no row of it is invalid; an existing folder is an error."""
    n = df.where(invalid).limit(1).count()
    if n:
        raise ValueError("the batch holds invalid rows; nothing was written")
    df.write.mode("errorifexists").parquet(path)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """An immutable version of a table; writing it again is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")
