"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to lower-case letters and digits with single spaces. A
passage within e edits of an item of m characters shares m + 1 - q (e + 1) of its q-grams with
it at least, all in a band of e + 1 diagonals (place in the text less place in the item). Shared
q-grams are counted in overlapping bands of diagonals; where a band meets the bound, its region
is aligned with the item, and kept if the edits are within budget. Items of all lengths are sought in
overlapping windows of SPAN and of PART characters, the whole being a window where it is shorter,
so that a leaked part is found. An item without a q-gram is sought among the texts that are as short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import mix, normal, normal_places, prepare, quoted

Q = 12
#: Edits allowed for each character of a window, if the lemma allows so many.
EDIT_RATE = 0.06
#: Characters of the windows in which items are sought, half overlapping; a shorter item is its own
#: window. Any part of 3 / 2 PART - 1 characters holds a window.
SPAN = 400
PART = 100
#: Items are indexed so many characters at a time; a longer benchmark takes several passes.
INDEX_CHARS = 2_000_000
#: Shared q-grams of a text are counted about so many at a time.
HITS = 1_000_000

_BASE = 0x9E3779B1


def qgrams(p: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hashes of all q-grams, by doubling; a rare clash only costs an alignment."""
    if len(p) < q:
        return np.empty(0, dtype=np.uint32)
    power, base, length, done = p.astype(np.uint32), _BASE, 1, 0
    out: np.ndarray | None = None
    n = len(p) - q + 1
    while True:
        if q & length:
            part = power[done : done + n]
            out = part if out is None else out * np.uint32(base) + part
            done += length
        if done == q:
            return mix(out)
        power = power[:-length] * np.uint32(base) + power[length:]
        base, length = base * base & 0xFFFFFFFF, 2 * length


def budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed in a window of m characters; negative if it has no q-gram."""
    return min(int(m * rate), (m + 1) // q - 1)


def locate(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the place in text nearest to the pattern, the first of equals, if its
    edits are at most `most`: a bit-parallel alignment (Myers) whose ends in the text are free."""
    m = len(pattern)
    if pattern.dtype == text.dtype:
        size = pattern.dtype.itemsize
        raw, whole = pattern.tobytes(), text.tobytes()
        same = whole.find(raw)
        while same % size and same >= 0:
            same = whole.find(raw, same + 1)
        if same >= 0:
            return same // size, same // size + m, 0
    end, best = _ends(pattern.tolist(), text.tolist(), m, most)
    if end < 0:
        return None
    back, _ = _ends(pattern[::-1].tolist(), text[:end][::-1].tolist(), m, best)
    return (end - back if back > 0 else 0), end, best


def _ends(pattern: list[int], text: list[int], m: int, most: int) -> tuple[int, int]:
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        match = where.get(c, 0)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, j + 1
    return end, best


@dataclass
class Index:
    """Windows of the items and their q-grams: the grams of keys[k] are entries[first[k]:first[k + 1]].
    short: the items that have no q-gram, by their normal form."""

    items: list
    windows: list[np.ndarray]
    items_of: list[list[int]]
    lengths: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    window_of: np.ndarray
    place_of: np.ndarray
    bits: int
    seen: np.ndarray
    q: int
    short: dict[tuple[bytes, str], list[int]]


def build_index(items: list[tuple], *, q: int = Q, rate: float = EDIT_RATE, span: int = SPAN, part: int = PART) -> Index:
    owners: dict[tuple[bytes, str], list[int]] = {}
    short: dict[tuple[bytes, str], list[int]] = {}
    windows: list[np.ndarray] = []
    for k, (_, text) in enumerate(items):
        p = normal(text or "")
        if 0 < len(p) < q:
            short.setdefault((p.tobytes(), p.dtype.str), []).append(k)
        sizes = {min(span, len(p)), min(part, len(p))}
        cuts = [(s, size) for size in sorted(sizes) for s in sorted({*range(0, len(p) - size, max(1, size // 2)), len(p) - size})]
        for s, size in cuts:
            if size < q or budget(size, q, rate) < 0:
                continue
            w = p[s : s + size]
            name = (w.tobytes(), w.dtype.str)
            if name not in owners:
                windows.append(w)
            of = owners.setdefault(name, [])
            if not of or of[-1] != k:
                of.append(k)
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    edits = np.array([budget(m, q, rate) for m in lengths], dtype=np.int64)
    hashes = [qgrams(w, q) for w in windows]
    flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint32)
    window_of = np.repeat(np.arange(len(windows), dtype=np.int32), [len(h) for h in hashes])
    place_of = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.empty(0, dtype=np.int32)
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    bits = int(min(26, max(10, np.ceil(np.log2(max(1, len(keys)) * 32)))))
    seen = np.zeros(1 << bits, dtype=bool)
    seen[keys >> np.uint32(32 - bits)] = True
    return Index([i for i, _ in items], windows, list(owners.values()), lengths, edits, lengths + 1 - q * (edits + 1), keys, np.append(first, len(flat)), window_of[order], place_of[order], bits, seen, q, short)


def _bands(p: np.ndarray, index: Index) -> np.ndarray:
    """Codes (window, band) of the bands of diagonals that share enough q-grams with the text, in order."""
    none = np.empty(0, dtype=np.int64)
    h = qgrams(p, index.q)
    pos = np.flatnonzero(index.seen.take(h >> np.uint32(32 - index.bits)))
    if not len(pos):
        return none
    k = np.searchsorted(index.keys, h[pos])
    k[k == len(index.keys)] = 0
    real = index.keys[k] == h[pos]
    pos, k = pos[real], k[real]
    n = index.first[k + 1] - index.first[k]
    until = np.cumsum(n)
    reach = int((2 * (index.edits + 1) + index.lengths).max())
    found, lo = [none], 0
    while lo < len(pos):
        # all bands that begin before pos[cut], with all of their q-grams
        cut = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + HITS)))
        hi = len(pos) if cut >= len(pos) else int(np.searchsorted(pos, pos[cut] + reach))
        m = n[lo:hi]
        entry = np.repeat(index.first[k[lo:hi]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        window = index.window_of[entry].astype(np.int64)
        diagonal = np.repeat(pos[lo:hi], m) - index.place_of[entry]
        code = (window << 40) + diagonal // (index.edits[window] + 1) + (1 << 20)
        codes, counts = np.unique(np.concatenate((code, code - 1)), return_counts=True)
        found.append(codes[counts >= index.bound[codes >> 40]])
        lo = cut
    return np.unique(np.concatenate(found))


def find_leaks(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(number of the item, start, end, edits) of each passage; spans are of the source text. Of
    overlapping places of a window the first counts; overlapping windows of an item are joined."""
    if not len(index.keys) and not index.short:
        return []
    p = normal(text)
    if len(p) < index.q:
        same = index.short.get((p.tobytes(), p.dtype.str), []) if len(p) else []
        _, at = normal_places(text) if same else (p, None)
        return [(k, int(at[0]), int(at[-1]) + 1, 0) for k in same]
    if not len(index.keys):
        return []
    codes = _bands(p, index)
    if not len(codes):
        return []
    _, at = normal_places(text)
    found: list[tuple[int, int, int, int]] = []
    last, done = -1, 0
    for c in codes.tolist():
        w, b = c >> 40, (c & ((1 << 40) - 1)) - (1 << 20)
        e, pattern = int(index.edits[w]), index.windows[w]
        if w != last:
            last, done = w, 0
        if (b + 2) * (e + 1) + e <= done:
            continue
        lo, hi = max(0, b * (e + 1) - e), min(len(p), (b + 2) * (e + 1) + len(pattern) + e)
        if place := locate(pattern, p[lo:hi], e):
            start, end, edits = lo + place[0], lo + place[1], place[2]
            done = max(done, end)
            found += [(k, int(at[start]), int(at[end - 1]) + 1, edits) for k in index.items_of[w]]
    found.sort()
    out: list[tuple[int, int, int, int]] = []
    for item, start, end, edits in found:
        if out and out[-1][0] == item and start < out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]), max(edits, out[-1][3]))
        else:
            out.append((item, start, end, edits))
    return out


def indexes(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", index_chars: int = INDEX_CHARS, **how) -> Iterator[Index]:
    """Indexes of the benchmark's items that have a text, index_chars characters in each."""
    part: list[tuple] = []
    size = 0
    for item, text in benchmark.select(quoted(id_col), quoted(text_col)).where(quoted(text_col).isNotNull()).toLocalIterator():
        if part and size + len(text) > index_chars:
            yield build_index(part, **how)
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    if part:
        yield build_index(part, **how)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", index_chars: int = INDEX_CHARS, **how) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits), one for each passage of docs that is an item, or
    windows of one, within the edit budget; of overlapping places of a window the first. edits are
    those of the joined window that has most.

    start and end count characters of the text from 0, end not included. A null or empty text has
    none; items without letters or digits are not sought, and one with fewer normal characters than
    a q-gram only in texts that are, but for case and punctuation, the item; repeated items each
    give rows, repeated documents and null ids too; other columns are ignored; an empty table on
    either side gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).where(F.col("text").isNotNull())
    item_type = benchmark.select(quoted("item_id").alias("item_id")).schema["item_id"].dataType.simpleString()
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, start bigint, end bigint, edits int"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, text_col="text", index_chars=index_chars, **how):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    if got := find_leaks(text.as_py(), index):
                        at += [i] * len(got)
                        rows += got
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int32())), pa.array([index.items[r[0]] for r in rows], item_arrow), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32())))],
                    names=["doc_id", "item_id", "start", "end", "edits"],
                )

        item_arrow = _arrow(benchmark, "item_id")
        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", index_chars: int = INDEX_CHARS, **how) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark; see leaks.
    Null and empty texts stay, null ids and repeated rows are judged by their texts."""
    spark = docs.sparkSession
    prepare(spark)
    place = docs.columns.index(text_col)
    for index in indexes(benchmark, index_chars=index_chars, **how):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                clean = [not (t.is_valid and find_leaks(t.as_py(), index)) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
