"""JSON lines: scan with quarantine, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_blank


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine). A line is bad if it isn't a JSON object or lacks ``key``; blank lines are skipped.

    The quarantine keeps the line, its file and the reason. gzip is read transparently, but such a file is one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name")).where(non_blank("value").isNotNull())
    parsed = lines.withColumn("row", F.when(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.from_json("value", schema)))
    good = F.col("row").isNotNull() & non_blank(f"row.{key}").isNotNull()
    error = F.when(F.col("row").isNull(), "invalid json").otherwise(f"missing {key}")
    return parsed.where(good).select("row.*", "file_name"), parsed.where(~F.coalesce(good, F.lit(False))).select(F.col("value").alias("line"), error.alias("error"), "file_name")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, NULL fields kept, text as it is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
