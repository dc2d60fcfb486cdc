"""Releases as Parquet tables in a folder, with a pointer to the current one.

    root/release_sequence=N/{assets,blocks,segments}    one folder for each release
    root/release_sequence=N/release.json                its head: the length and digest of each file of the tables, signed
    root/CURRENT                                        the sequence in force

A release is written whole before the pointer moves; what the pointer does not name is not a
release and may be deleted. The folder is one that all executors share, as a mounted file system.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import AssetNotFound, BuildLocked, IntegrityError, InvalidFormat, OutOfRange
from quern.operators import lookup, verify
from quern.plans.pack import Release
from quern.session import ensure_workers_import
from quern.sources.identity import Publisher, ReaderKeys
from quern.sources.identity import verify as check_signature

TABLES = ("assets", "blocks", "segments")
VERSION = 2


def release_dir(root: str, sequence: int) -> str:
    return os.path.join(root, f"release_sequence={sequence}")


def current(root: str) -> int | None:
    try:
        with open(os.path.join(root, "CURRENT")) as f:
            return int(f.read())
    except FileNotFoundError:
        return None
    except ValueError as e:
        raise InvalidFormat("CURRENT is not a number") from e


def file_digests(spark: SparkSession, at: str) -> list[list]:
    """[path, length, SHA-256] of each file of the tables below a release's folder, in order; hashed by tasks."""
    names = [os.path.relpath(os.path.join(folder, f), at) for t in TABLES for folder, _, files in os.walk(os.path.join(at, t)) for f in files if f.endswith(".parquet")]
    if not names:
        return []
    ensure_workers_import(spark)
    base = os.path.realpath(at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["name"]:
                digest, size = hashlib.sha256(), 0
                with open(os.path.join(base, name), "rb") as f:
                    while part := f.read(1 << 20):
                        digest.update(part)
                        size += len(part)
                rows.append((name, size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "size", "digest"])

    frame = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 64))
    return sorted([r.name, r["size"], r.digest] for r in frame.mapInPandas(run, "name string, size bigint, digest string").collect())


def _message(head: dict) -> bytes:
    return json.dumps({k: v for k, v in head.items() if k != "signature"}, sort_keys=True).encode()


def write(release: Release, root: str, project: str, identity: Publisher | None = None) -> str:
    """Writes the tables and the head, signed if there is an identity; the release is not in force before commit."""
    spark = release.assets.sparkSession
    at = release_dir(root, release.sequence)
    release.assets.repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{at}/assets")
    release.blocks.repartitionByRange("path", "block_no").sortWithinPartitions("path", "block_no").write.parquet(f"{at}/blocks")
    release.segments.write.partitionBy("availability", "access").parquet(f"{at}/segments")
    head = {"version": VERSION, "project": project, "release_sequence": release.sequence, "source_fingerprint": release.fingerprint, "sealed": identity is not None, "files": file_digests(spark, at)}
    if identity is not None:
        head["signature"] = identity.sign(spark, _message(head)).hex()
    with open(f"{at}/release.json", "x") as f:
        json.dump(head, f)
        f.flush()
        os.fsync(f.fileno())
    return at


def commit(root: str, sequence: int) -> None:
    """Moves the pointer in one step."""
    if not os.path.exists(f"{release_dir(root, sequence)}/release.json"):
        raise InvalidFormat(f"release {sequence} is not whole")
    with open(os.path.join(root, "CURRENT.new"), "w") as f:
        f.write(str(sequence))
        f.flush()
        os.fsync(f.fileno())
    os.replace(os.path.join(root, "CURRENT.new"), os.path.join(root, "CURRENT"))


def recover(root: str) -> list[str]:
    """Deletes what an interrupted build left: a half-written pointer, staged data and releases after the
    current one; data that no release refers to is for clear_data."""
    now = current(root) or 0
    gone = [n for n in os.listdir(root) if n == "CURRENT.new" or n.startswith("staged-") or n.startswith("release_sequence=") and int(n.partition("=")[2]) > now]
    for n in gone:
        at = os.path.join(root, n)
        shutil.rmtree(at) if os.path.isdir(at) else os.unlink(at)
    return sorted(gone)


@contextmanager
def locked(root: str) -> Iterator[None]:
    """One build at a time."""
    at = os.path.join(root, "BUILD.lock")
    try:
        os.close(os.open(at, os.O_CREAT | os.O_EXCL))
    except FileExistsError as e:
        raise BuildLocked(at) from e
    try:
        yield
    finally:
        os.unlink(at)


def open_release(spark: SparkSession, root: str, project: str | None = None, at_least: int | None = None, keys: Publisher | ReaderKeys | None = None) -> "OpenRelease":
    """The current release: its signature is checked first, then its files against the head, the project,
    and rollback. Without keys a release that is signed is read as tables, but its blocks stay sealed."""
    sequence = current(root)
    if sequence is None:
        raise InvalidFormat("no release")
    at = release_dir(root, sequence)
    try:
        with open(f"{at}/release.json") as f:
            head = json.load(f)
    except (FileNotFoundError, ValueError) as e:
        raise InvalidFormat("release.json") from e
    if head.get("version") != VERSION or head.get("release_sequence") != sequence:
        raise InvalidFormat("release.json")
    if keys is not None:
        try:
            signature = bytes.fromhex(head.get("signature", ""))
        except (TypeError, ValueError) as e:
            raise InvalidFormat("signature") from e
        check_signature(spark, keys.public, _message(head), signature)
        verify.check_project(keys.project, head["project"])
    if file_digests(spark, at) != head["files"]:
        raise IntegrityError("files of the release are not those that its head names")
    verify.check_rollback(sequence, at_least)
    if project is not None:
        verify.check_project(project, head["project"])
    tables = {t: spark.read.parquet(f"{at}/{t}") for t in TABLES}
    return OpenRelease(sequence=sequence, fingerprint=head["source_fingerprint"], sealed=head["sealed"], **tables)


@dataclass
class OpenRelease(Release):
    """A release that is read: listings, lookups and byte ranges."""

    sealed: bool = False

    def list_assets(self) -> DataFrame:
        return self.assets.select("file_index", "path", "len", "access").orderBy("file_index")

    def list_segments(self) -> DataFrame:
        return self.segments.select("segment_id", "file_len", "availability").orderBy("segment_id")

    def contains(self, path: str) -> bool:
        return not self.assets.where(F.col("path") == path).isEmpty()

    def asset(self, path: str) -> dict:
        row = self.assets.where(F.col("path") == path).head()
        if row is None:
            raise AssetNotFound(path)
        return row.asDict()

    def reuse_records(self) -> DataFrame:
        """Chunk ids and places alone; column pruning leaves the rest unread."""
        return self.blocks.select("chunk_id", "availability", "plain_len", "codec", "stored_len", "segment_id", "segment_block_ordinal", "physical_offset")

    def check(self) -> None:
        verify.check_catalog(self.assets, self.blocks, self.segments)

    def cursor(self, path: str, contents: DataFrame) -> "Cursor":
        return Cursor(self, path, contents)


class Cursor:
    """A file-like reader of one asset. Each read is a query; read many ranges with read_ranges at once."""

    def __init__(self, release: OpenRelease, path: str, contents: DataFrame) -> None:
        self.path, self.length, self.at = path, release.asset(path)["len"], 0
        blocks = release.blocks.where(F.col("path") == path)
        self._blocks = blocks.join(contents.where(F.col("path") == path).select("path", "block_no", "content"), ["path", "block_no"])
        self._assets = release.assets.where(F.col("path") == path)

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        at = offset + (0, self.at, self.length)[whence]
        if not 0 <= at <= self.length:
            raise OutOfRange(f"{at} of {self.length}")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def read_at(self, offset: int, n: int) -> bytes:
        if not 0 <= offset <= self.length:
            raise OutOfRange(f"{offset} of {self.length}")
        spark = self._assets.sparkSession
        request = spark.createDataFrame([(0, self.path, offset, n)], "request_id bigint, path string, offset bigint, n bigint")
        return bytes(lookup.read_ranges(request, self._assets, self._blocks).first().data)

    def read(self, n: int = -1) -> bytes:
        out = self.read_at(self.at, self.length - self.at if n < 0 else n)
        self.at += len(out)
        return out


def collect_garbage(root: str, segment_files: DataFrame, active: DataFrame, delete: bool = True) -> list[str]:
    """Names of segment files below root/data that no release refers to; deletes them if asked."""
    gone = [r.name for r in verify.unreferenced(segment_files, active).select("name").toLocalIterator()]
    for name in gone if delete else ():
        os.unlink(os.path.join(root, "data", name))
    return sorted(gone)


def save_cache(entries: DataFrame, root: str, project: str, sequence: int) -> None:
    """The build cache (path, len, mtime, access, compression, chunks) of a release."""
    at = os.path.join(root, "build-cache")
    tagged = entries.withColumn("project", F.lit(project)).withColumn("release_sequence", F.lit(sequence))
    tagged.write.mode("overwrite").parquet(at + ".new")
    shutil.rmtree(at, ignore_errors=True)
    os.replace(at + ".new", at)


def load_cache(spark: SparkSession, root: str, project: str, sequence: int) -> DataFrame | None:
    """The build cache, or None, never an error, if it is missing, damaged, of another project or
    release, or has a path twice."""
    try:
        df = spark.read.parquet(os.path.join(root, "build-cache"))
        wrong = (F.col("project") != project) | (F.col("release_sequence") != sequence)
        if not df.where(wrong).isEmpty() or not df.groupBy("path").count().where("count > 1").isEmpty():
            return None
        return df.drop("project", "release_sequence")
    except PySparkException:
        return None
