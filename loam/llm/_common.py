"""What the operators of this subpackage share: shipping, batch sizes, shared folders, id hashes."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.files import settings

#: Arrow batches hold at most so many rows and about so many bytes, so that long texts can't fill a worker's memory.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
#: A table that is written whole needs the shuffles behind it no more: executors drop them when the write ends.
_DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_own_dir: list[str] = []
_runs: dict[str, str] = {}
_before: dict[int, dict[str, str | None]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches and makes this package importable on executors; cheap to call again.

    Results are lazy, so the bounds stay set until restore(); smaller bounds of the caller's own are left alone.
    """
    held = _before.setdefault(id(spark._jsparkSession), {})
    for key, most in _BATCHES.items():
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            held.setdefault(key, now)
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if not getattr(context, "_loam_shipped", False):
        package = Path(__file__).resolve().parents[1]
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
        folder = tempfile.mkdtemp(prefix="loam-ship-")  # Spark takes the file from here to all executors
        atexit.register(shutil.rmtree, folder, True)
        target = os.path.join(folder, "loam.zip")
        Path(target).write_bytes(body.getvalue())
        context.addPyFile(target)
        context._loam_shipped = True
    return spark


def restore(spark: SparkSession) -> None:
    """Puts back what prepare() set, for callers who are done with the operators' results."""
    for key, value in _before.pop(id(spark._jsparkSession), {}).items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="loam-shared-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def _run_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, deleted when the driver's process ends."""
    top = f"{shared_dir(spark)}/loam/{spark.sparkContext.applicationId}"
    if top not in _runs:
        _runs[top] = top
        atexit.register(_delete, spark, top)
    return top


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, older_than_hours: float = 168) -> int:
    """Deletes folders of intermediate tables that applications which ended badly have left; how many."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loam")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s for s in (fs.listStatus(top) if fs.exists(top) else ()) if s.getModificationTime() / 1000 < time.time() - older_than_hours * 3600 and s.getPath().getName() != spark.sparkContext.applicationId]
    for status in old:
        fs.delete(status.getPath(), True)
    return len(old)


def settle(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing.

    by: a column to write in folders of its own for each value, so that later reads take only the values they need.
    The tables of an application go when its driver ends, or before that by drop(); see sweep() for what crashes leave.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with settings(spark, _DROP_SHUFFLES):
        (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def settle_dealt(df: DataFrame, label: str, by: str, key: str, buckets: int) -> DataFrame:
    """settle() in folders by one column and dealt into buckets by another: what groups by that key doesn't shuffle it.

    Buckets need an entry in the session's catalog: drop() such a table when it is done with.
    """
    spark = df.sparkSession
    name = f"loam_{label}_{uuid.uuid4().hex}"
    path = f"{_run_dir(spark)}/{name}"
    writer = df.write.option("compression", "zstd").option("path", path).format("parquet").partitionBy(by).bucketBy(buckets, key)
    with settings(spark, _DROP_SHUFFLES):
        writer.saveAsTable(name)
    out = spark.table(name)
    out._loam_path, out._loam_name = path, name
    return out


def drop(settled: DataFrame) -> None:
    """Deletes a table made by settle() or settle_dealt() that nothing will read any more."""
    if name := getattr(settled, "_loam_name", None):
        settled.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(settled.sparkSession, settled._loam_path)


def id_mod(column: Column, modulus: int) -> Column:
    """crc32 of an id as decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
