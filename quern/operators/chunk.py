"""Contents cut into blocks: of fixed length, or where the content says."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.codec import chunk_id
from quern.schema import CONTENT_DEFINED, Limits
from quern.session import ensure_workers_import


def fixed_chunks(assets: DataFrame, block_len: Column, content: str = "content") -> DataFrame:
    """The rows of assets, one for each block: block_no, logical_offset, plain_len, chunk_id.

    The content is hashed block by block and not carried on; an empty one has no block.
    """
    n = F.octet_length(F.col(content)).cast("bigint")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block_len).cast("bigint")))
    cut = lambda i: F.substring(F.col(content), (i * block_len + 1).cast("int"), block_len.cast("int"))
    kept = [F.col(c) for c in assets.columns if c != content]
    pieces = F.transform(
        starts,
        lambda i: F.struct(i.alias("block_no"), (i * block_len).alias("logical_offset"), F.octet_length(cut(i)).cast("bigint").alias("plain_len"), chunk_id(cut(i)).alias("chunk_id")),
    )
    return assets.select(*kept, F.inline(pieces))


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 64-bit numbers, one for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


_GEAR = gear_table()


def _masks(average: int) -> tuple[int, int]:
    """The stricter mask before the average length and the laxer one after it, in the top bits."""
    bits = max(2, int(average).bit_length() - 1)
    top = lambda k: ((1 << k) - 1) << (64 - k)
    return top(bits + 2), top(bits - 2)


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of the chunks of a gear-hash chunker with normalised chunk lengths.

    The hash of a place covers the 64 bytes before it, so it is computed for all places at once;
    places are then taken in order. Chunks have least..most bytes, the last perhaps fewer.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    g = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    h, length = g.copy(), 1
    while length < 64:
        h[length:] = h[length:] + (h[:-length] << np.uint64(length))
        length *= 2
    strict, lax = _masks(average)
    hard, soft = np.flatnonzero(h & np.uint64(strict) == 0), np.flatnonzero(h & np.uint64(lax) == 0)
    out, start = [], 0
    while n - start > least:
        end = min(n, start + most)
        middle = min(end, start + average)
        i = int(np.searchsorted(hard, start + least))
        j = int(np.searchsorted(soft, middle))
        if i < len(hard) and hard[i] < middle:
            end = int(hard[i]) + 1
        elif j < len(soft) and soft[j] < end:
            end = int(soft[j]) + 1
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def content_chunks(assets: DataFrame, limits: Limits, content: str = "content") -> DataFrame:
    """Like fixed_chunks, cut by content; equal stretches of two contents mostly get equal chunks."""
    import hashlib

    ensure_workers_import(assets.sparkSession)
    kept = [c for c in assets.columns if c != content]
    types = {f.name: f.dataType.simpleString() for f in assets.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "block_no bigint, logical_offset bigint, plain_len bigint, chunk_id string"])
    least, average, most = limits.chunk_min, limits.chunk_avg, limits.chunk_max

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, at = [], []
            for k, data in enumerate(pdf[content]):
                start = 0
                for no, end in enumerate(cut_points(bytes(data or b""), least, average, most)):
                    rows.append((no, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    at.append(k)
                    start = end
            left = pdf[kept].iloc[at].reset_index(drop=True)
            yield pd.concat([left, pd.DataFrame(rows, columns=["block_no", "logical_offset", "plain_len", "chunk_id"])], axis=1)

    return assets.select(*kept, F.col(content).cast("binary").alias(content)).mapInPandas(run, schema)


def chunks(classified: DataFrame, limits: Limits, content: str = "content") -> DataFrame:
    """Blocks of classified assets, each by its own layout."""
    by_content = F.col("layout") == CONTENT_DEFINED
    fixed = fixed_chunks(classified.where(~by_content).withColumn(content, F.col(content).cast("binary")), F.col("fixed_block_len"), content)
    return fixed.unionByName(content_chunks(classified.where(by_content), limits, content))


def length_mismatches(assets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Assets (path, len, chunked_len) whose blocks do not add up to their length."""
    total = blocks.groupBy("path").agg(F.sum("plain_len").alias("chunked_len"))
    joined = assets.select("path", "len").join(total, "path", "left").withColumn("chunked_len", F.coalesce("chunked_len", F.lit(0)))
    return joined.where("len <> chunked_len")
