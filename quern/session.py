"""What this package needs of a Spark session."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_SHIPPED: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's own, else spark.checkpoint.dir, else, locally, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quern-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def ensure_workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package: on this machine by its folder; on a cluster that names a
    shared folder, by an archive there; else it must be installed on the workers."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        env = sc.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    elif sc.applicationId not in _SHIPPED and (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        ship(spark)
        _SHIPPED.add(sc.applicationId)


def ship(spark: SparkSession) -> str:
    """Writes the package as an archive into the shared folder and adds it to the workers' path."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(Path(ROOT, "quern").rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(ROOT))), p.read_bytes())
    at = f"{ensure_checkpoint_dir(spark)}/quern-{hashlib.sha256(body.getvalue()).hexdigest()[:16]}.zip"
    fs, path = file_system(spark, at)
    if not fs.exists(path):
        out = fs.create(path)
        out.write(bytearray(body.getvalue()))
        out.close()
        fs.deleteOnExit(path)
    spark.sparkContext.addPyFile(at)
    return at


def file_system(spark: SparkSession, at: str):
    """The Hadoop file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _write(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again; it goes when the application ends."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4()}"
    out = _write(df, at)
    fs, path = file_system(spark, at)
    fs.deleteOnExit(path)
    return out


@contextmanager
def settle(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like written, whose tables go when the block ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4()}"
    try:
        yield lambda df: _write(df, f"{folder}/{uuid.uuid4()}")
    finally:
        fs, path = file_system(spark, folder)
        fs.delete(path, True)
