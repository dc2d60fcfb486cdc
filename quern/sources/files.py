"""A directory tree as a table of assets, and assets written back as files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.errors import InvalidInput, StalePlan
from quern.functions.paths import is_canonical
from quern.session import ensure_workers_import, written

#: Files that begin so hold keys and must not be packed.
KEY_MAGIC = b"QRNKEY"


LISTING = "path string, file string, len bigint, mtime timestamp, link boolean, key boolean"


class Tree(DataSource):
    """The files below a folder that all executors share, as rows of LISTING: spark.read.format("quern_tree").

    The driver lists the folder itself and, where that gives few folders, those in it; tasks walk the
    rest. Links are listed as such and not followed; key: whether the file begins like one of keys.
    """

    @classmethod
    def name(cls) -> str:
        return "quern_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> "TreeReader":
        return TreeReader(self.options["root"])


@dataclass
class Part(InputPartition):
    """Files of folders to list, of these alone or of all below."""

    folders: tuple[str, ...]
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = os.path.realpath(root)

    def partitions(self) -> list[Part]:
        level, above = [self.root], []
        while level and len(level) < 64 and len(above) < 64:
            above += level
            level = [e.path for folder in level for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)]
        return [Part(tuple(above), False), *(Part((folder,), True) for folder in level)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for top in partition.folders:
            for folder, folders, files in os.walk(top):
                for name in (*files, *(f for f in folders if os.path.islink(os.path.join(folder, f)))):
                    yield self._row(os.path.join(folder, name))
                if not partition.deep:
                    break

    def _row(self, at: str) -> tuple:
        stat, link = os.lstat(at), os.path.islink(at)
        begin = b""
        if not link and stat.st_size >= len(KEY_MAGIC):
            with open(at, "rb") as f:
                begin = f.read(len(KEY_MAGIC))
        return os.path.relpath(at, self.root).replace(os.sep, "/"), at, stat.st_size, datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, timezone.utc), link, begin == KEY_MAGIC


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder as rows (path, file, len, mtime, link, key), path being relative to it; no
    content but the beginning of each is read. Bodies of any length are read where they are cut."""
    ensure_workers_import(spark)
    spark.dataSource.register(Tree)
    return spark.read.format("quern_tree").option("root", root).load()


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below root as rows (path, content, len, mtime), empty ones too, for what needs contents whole."""
    rows = listed(spark, root).where("NOT link")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                one = pdf.iloc[k : k + 1]
                with open(one["file"].iloc[0], "rb") as f:
                    yield pd.DataFrame({"path": one["path"], "content": [f.read()], "len": one["len"], "mtime": one["mtime"]})

    return rows.select("path", "file", "len", "mtime").mapInPandas(run, "path string, content binary, len bigint, mtime timestamp")


def check_sources(root: str, sources: DataFrame) -> None:
    """Raises InvalidInput for links below root, for paths that are not canonical, and for key files.
    sources: what listed or scan gave; the folder is listed again by tasks where it gave no marks."""
    marked = sources if {"link", "key"} <= set(sources.columns) else listed(sources.sparkSession, root)
    bad = marked.select("path", "link", "key", (~is_canonical(F.col("path"))).alias("odd")).where("link OR key OR odd").limit(3).collect()
    for what, rows in (("links", [r for r in bad if r.link]), ("paths that are not canonical", [r for r in bad if r.odd]), ("key files", [r for r in bad if r.key])):
        if rows:
            raise InvalidInput(f"{what}: {[r.path for r in rows]}")


def changed_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose length or time of change differ between two listings, or that only one has."""
    b, n = before.select("path", F.struct("len", "mtime").alias("b")), now.select("path", F.struct("len", "mtime").alias("n"))
    return b.join(n, "path", "full_outer").where(~F.col("b").eqNullSafe(F.col("n"))).select("path")


def check_unchanged(before: DataFrame, now: DataFrame) -> None:
    gone = changed_since(before, now).limit(3).collect()
    if gone:
        raise StalePlan(f"sources changed during the build: {[r.path for r in gone]}")


def extract(assets: DataFrame, block_contents: DataFrame, target: str) -> DataFrame:
    """Writes each asset of a release to a file below target and returns (path, bytes) of them.

    target must be a folder that all executors share. Files are created, never overwritten, and a
    path that leads out of target raises InvalidInput. An asset's blocks meet in one task, which
    writes them in order, so no asset is held whole.
    """
    ensure_workers_import(assets.sparkSession)
    base = os.path.realpath(target)
    rows = assets.select("path").join(block_contents.select("path", "block_no", "content"), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file, size, done = None, None, 0, []
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                if p != path:
                    if file:
                        file.close()
                        done.append((path, size))
                    at = os.path.realpath(os.path.join(base, p))
                    if not at.startswith(base + os.sep):
                        raise InvalidInput(f"path leads out of the target: {p}")
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    path, file, size = p, open(at, "xb"), 0
                if content is not None:
                    size += file.write(content)
        if file:
            file.close()
            done.append((path, size))
        yield pd.DataFrame(done, columns=["path", "bytes"])

    return written(rows.repartition("path").sortWithinPartitions("path", "block_no").mapInPandas(run, "path string, bytes bigint"))


def import_files(files: list[str], root: str) -> list[str]:
    """Copies files into root, none over another; on an error those already copied go again."""
    names = [os.path.basename(f) for f in files]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise InvalidInput(f"same name twice: {sorted(twice)}")
    done: list[str] = []
    try:
        for f, n in zip(files, names):
            at = os.path.join(root, n)
            with open(f, "rb") as src, open(at, "xb") as dst:
                done.append(at)
                while part := src.read(1 << 20):
                    dst.write(part)
    except OSError:
        for at in done:
            os.unlink(at)
        raise
    return done


def replace_file(new: str, target: str) -> None:
    """Puts a file in another's place; the old one comes back if that fails."""
    backup = target + ".backup"
    had = os.path.exists(target)
    if had:
        os.replace(target, backup)
    try:
        os.replace(new, target)
    except OSError:
        if had:
            os.replace(backup, target)
        raise
    if had:
        os.unlink(backup)

