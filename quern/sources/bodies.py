"""Bodies of assets, from a column or from files, cut and encoded where they are read.

A source is a row (path, content) or (path, file), file being a path that all executors can open.
Bodies in files are read piece by piece, so that no file is held whole, nor bounded by what a cell
can hold; only a piece of the largest block, or a body that is cut by content, is in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import StalePlan
from quern.operators.chunk import cut_points
from quern.schema import AUTO, CONTENT_DEFINED, RAW, ZSTD, Limits
from quern.session import ensure_workers_import

#: Encoded blocks leave a task in batches of about so many bytes.
BATCH_BYTES = 16 << 20


def body_column(sources: DataFrame) -> str:
    return "content" if "content" in sources.columns else "file"


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data = data
        self.size = len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class _File:
    def __init__(self, f, size: int) -> None:
        self.f, self.size = f, size

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)


@contextmanager
def _open(value) -> Iterator[_Bytes | _File]:
    if isinstance(value, str):
        import os

        with open(value, "rb") as f:
            yield _File(f, os.fstat(f.fileno()).st_size)
    else:
        yield _Bytes(bytes(value or b""))


def cut(classified: DataFrame, limits: Limits) -> DataFrame:
    """Blocks (path, access, availability, compression, block_no, logical_offset, plain_len, chunk_id)
    of classified sources, each cut by its own layout, in one pass over the bodies. A body whose
    length is no longer that of its row raises StalePlan."""
    ensure_workers_import(classified.sparkSession)
    body = body_column(classified)
    kept = ["path", "access", "availability", "compression"]
    least, average, most = limits.chunk_min, limits.chunk_avg, limits.chunk_max

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *own, value, size, layout, block in zip(*(pdf[c] for c in kept), pdf[body], pdf["len"].tolist(), pdf["layout"], pdf["fixed_block_len"].tolist()):
                with _open(value) as b:
                    if b.size != size:
                        raise StalePlan(f"{own[0]} has {b.size} bytes, not {size}")
                    if layout == CONTENT_DEFINED:
                        data = b.read(0, size)
                        ends = cut_points(data, least, average, most)
                        spans = list(zip([0, *ends], ends))
                        rows += [(*own, no, lo, hi - lo, hashlib.sha256(data[lo:hi]).hexdigest()) for no, (lo, hi) in enumerate(spans)]
                    else:
                        for no, lo in enumerate(range(0, size, block or 1)):
                            piece = b.read(lo, min(block, size - lo))
                            rows.append((*own, no, lo, len(piece), hashlib.sha256(piece).hexdigest()))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = [*kept, "block_no", "logical_offset", "plain_len", "chunk_id"]
    schema = "path string, access string, availability string, compression string, block_no bigint, logical_offset bigint, plain_len bigint, chunk_id string"
    return classified.select(*kept, body, "len", "layout", "fixed_block_len").mapInPandas(run, schema)


def encode(blocks: DataFrame, sources: DataFrame, *, level: int, least_gain: int, compress: bool = True, few: int = 200_000) -> DataFrame:
    """Blocks (path, block_no, codec, encoded) for blocks (path, block_no, logical_offset, plain_len,
    chunk_id, compression): Zstandard where the policy allows it and it saves more than the least
    gain. Bodies stay where they are if the files that have blocks to encode are few. A piece whose
    digest is not the block's raises StalePlan."""
    ensure_workers_import(blocks.sparkSession)
    body = body_column(sources)
    wanted = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block_no", "logical_offset", "plain_len", "chunk_id", "compression"))).alias("wanted"))
    wanted = F.broadcast(wanted) if wanted.limit(few + 1).count() <= few else wanted
    names = ["path", "block_no", "codec", "encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        size = 0
        for batch in batches:
            for path, value, listed in zip(*(batch.column(k) for k in range(3))):
                with _open(value.as_py()) as b:
                    for w in listed.as_py():
                        piece = b.read(w["logical_offset"], w["plain_len"])
                        if hashlib.sha256(piece).hexdigest() != w["chunk_id"]:
                            raise StalePlan(f"{path.as_py()} changed during the build")
                        codec, encoded = RAW, piece
                        if compress and w["compression"] == AUTO and len(small := packer.compress(piece)) + least_gain < len(piece):
                            codec, encoded = ZSTD, small
                        rows.append((path.as_py(), w["block_no"], codec, encoded))
                        size += len(encoded)
                        if size > BATCH_BYTES:
                            yield out()
                            rows, size = [], 0
        yield out()

    return sources.select("path", body).join(wanted, "path").select("path", body, "wanted").mapInArrow(run, "path string, block_no bigint, codec string, encoded binary")
