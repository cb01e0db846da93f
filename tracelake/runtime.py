"""Session-level helpers: the shared folder, lineage cuts and table access.

Lineage is only ever cut through files in the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read, never the result.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_shipping = threading.Lock()
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors.

    ``spark.checkpoint.dir`` of the session wins. Only where it is unset (tests, a single machine) a temporary
    folder is made once per process.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tracelake-shared-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder; it is removed when the process ends."""
    path = f"{shared_dir(spark)}/tracelake/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _status(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(target) if fs.exists(target) else None


def path_exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes of one file; 0 where it is gone."""
    status = _status(spark, path)
    return status.getLen() if status else 0


def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session is gone; the cluster's own clean-up has to do it
            return


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and serves several consumers."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever they run: once per Spark context."""
    sc = spark.sparkContext
    with _shipping:
        if getattr(sc, "_tracelake_shipped", False):
            return
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tracelake-package-"), "tracelake.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        sc._tracelake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
