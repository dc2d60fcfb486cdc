"""Helpers that the corpus operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ensure_workers_import as prepare
from quern.session import settle, written

__all__ = ["fits", "free_name", "mix", "normal", "normal_places", "prepare", "quoted", "read", "settle", "text_of", "token_count", "written"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores added until no column has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    return F.coalesce(quoted(name), F.lit(""))


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed and carriage return."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("bigint")


def fits(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


SPACE = 32


def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x30000):
        c = chr(i)
        table[i] = ord(c.lower()[0]) if c.isalnum() else SPACE
    table[0xE0000:] = SPACE
    return table


_FOLD: list[np.ndarray] = []
_LATIN = bytes(ord(chr(i).lower()[0]) if chr(i).isalnum() else SPACE for i in range(256))


def normal_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of a text (see normal) and the place in it of each code point."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    p = _FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = p != SPACE
    if not keep.any():
        return p[:0], np.empty(0, dtype=np.int64)
    last = len(keep) - int(keep[::-1].argmax())
    keep[1:] |= keep[:-1].copy()
    at = np.flatnonzero(keep[:last])
    return p[at], at


def normal(text: str) -> np.ndarray:
    """Code points of the text's letters and digits in lower case, each run of others being one
    space, without a space at either end; bytes where that is enough."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return normal_places(text)[0]
    return np.frombuffer(b" ".join(raw.translate(_LATIN).split()), dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser (murmur)."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))
