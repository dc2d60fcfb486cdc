"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of words (runs of letters and digits, lower case). Its word k-mers are
labelled with their occurrence (the first "of the end" is not the second), and for each of
SKETCHES hash functions the L least labelled k-mers, kept in text order, make one sketch: two
texts share a sketch with a probability that falls with their edit distance, not merely with
the k-mers they share. Texts that share a sketch are aligned word by word in a band as wide as
the edits allowed; those that pass are linked, and linked texts form groups.

No pair is dropped for a bucket's size. Exact copies are joined by hash and leave before buckets
are made. In each bucket every text is paired with the one of least id, which settles large groups
in linear work; then all texts that still share a bucket but no group are compared, pair by pair, in
a stream ordered by length; a bucket of more than BLOCK such texts is cut into blocks, each pair of
which is a task of its own. Pairs whose lengths or word counts rule them out never leave the
stream, nor fetch texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import SPACE, fits, free_name, mix, normal, prepare, quoted, settle, written

#: So many that texts of MIN_SIMILARITY itself, their edits scattered so that each breaks two k-mers,
#: share a sketch in more than nine cases of ten (about one sketch in twenty; one in 27 if the edits
#: are evenly spaced).
K = 2
L = 3
SKETCHES = 96
#: Least edit similarity of near copies: 1 - edits / words of the longer text.
MIN_SIMILARITY = 0.75
#: Words are counted in so many classes, up to 3 in each, for a lower bound of the edits.
CLASSES = 512
SEED = 5
#: Pairs of a bucket are compared by word counts so many at a time.
PAIRS = 1 << 14
#: Texts of a bucket without a common group are compared so many at a time with so many.
BLOCK = 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, from 0 to n - 1."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        powers = []
        for b in (_BASE, inverse):
            factors = np.full(size, b, dtype=np.uint64)
            factors[0] = 1
            powers.append(np.cumprod(factors))
        _POWERS[:] = powers
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the text's words, in order."""
    p = normal(text)
    if not len(p):
        return np.empty(0, dtype=np.uint32)
    spaces = np.flatnonzero(p == SPACE)
    start, end = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(p)]))
    power, inverse = _powers(len(p) + 1)
    sums = np.zeros(len(p) + 1, dtype=np.uint64)
    np.cumsum(p * power[: len(p)], out=sums[1:])
    return mix((((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)) * np.uint64(_BASE) >> np.uint64(32)).astype(np.uint32))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers, each with the number of its occurrence so far; a shorter text is one k-mer."""
    if len(words) < k:
        words = np.concatenate((words, np.zeros(k - len(words), dtype=np.uint32)))
    n = len(words) - k + 1
    h = words[:n]
    for i in range(1, k):
        h = mix(h * np.uint32(0x9E3779B1) + words[i : i + n])
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return h
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    at = at[np.argsort(h[at], kind="stable")]
    new = np.concatenate(([True], h[at][1:] != h[at][:-1]))
    place = np.arange(len(at))
    occurrence = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint32)
    out = h.copy()
    out[at] = np.where(occurrence > 0, mix(h[at] ^ mix(occurrence)), h[at])
    return out


def multipliers(m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 31, size=m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketches(kmers: np.ndarray, factors: np.ndarray, l: int = L) -> np.ndarray:
    """One 64-bit number for each hash function: its l least k-mers (of equals, the first), in text order."""
    out = np.empty(len(factors), dtype=np.uint64)
    n = len(kmers)
    step = max(1, (1 << 17) // n)
    for lo in range(0, len(factors), step):
        a = factors[lo : lo + step]
        if n > l:
            at = _least(kmers[None, :] * a[:, None], l)
            at.sort(axis=1)
            chosen = kmers[at]
        else:
            chosen = np.broadcast_to(kmers, (len(a), n))
        h = a.astype(np.uint64)
        for i in range(chosen.shape[1]):
            h = (h ^ chosen[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[lo : lo + step] = h
    return out


def _least(h: np.ndarray, l: int) -> np.ndarray:
    """Columns of the l least numbers of each row, of equals the first, by as many passes for the least;
    numbers found are masked meanwhile. Rows that hold the mask itself are sorted."""
    rows, mask = np.arange(len(h)), np.uint32(0xFFFFFFFF)
    out, found = np.empty((len(h), l), dtype=np.int64), []
    for i in range(l):
        at = h.argmin(axis=1)
        out[:, i] = at
        found.append(h[rows, at])
        h[rows, at] = mask
    for i in range(l):
        h[rows, out[:, i]] = np.where(found[i] == mask, h[rows, out[:, i]], found[i])
    if (found[-1] == mask).any():
        return np.argsort(h, axis=1, kind="stable")[:, :l]
    return out


def within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, else None: a bit-parallel
    alignment (Hyyro) of the band of `most` diagonals on either side."""
    lead = 0
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[:n] != b[:n])
        lead = int(differ[0]) if len(differ) else n
        a, b = a[lead:], b[lead:]
        n -= lead
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        trail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - trail], b[: len(b) - trail]
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > most:
        return None
    if m == 0:
        return n
    up = most
    width = min(2 * most + 1, m + most)
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | (1 << (i + up))
    # window at column j holds rows j - up .. j - up + width - 1; rows before the first are virtual
    vp, vn = full & ~((1 << up) - 1), 0
    bottom = width - 1
    score = min(bottom - up, m)
    for j, w in enumerate(b.tolist()):
        match = (where.get(w, 0) >> j) & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        row = j - up + bottom
        if row < m:
            score += 0 if (d0 >> bottom) & 1 else 1
        else:
            at = m - 1 - (j - up)
            if at < 0:
                return None
            score += (hp >> at) & 1
            score -= (hn >> at) & 1
        shifted = d0 >> 1
        vp = (hn | ~(shifted | hp)) & full
        vn = shifted & hp
    return score if score <= most else None


def similar(a: np.ndarray, b: np.ndarray, least: float = MIN_SIMILARITY) -> bool:
    """Whether 1 - edits / words of the longer is `least` or more."""
    longer = max(len(a), len(b))
    return within(a, b, int((1 - least) * longer + 1e-9)) is not None


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def word_counts(words: np.ndarray) -> bytes:
    """Two bits for each class, four classes to a byte."""
    c = np.minimum(np.bincount(words % CLASSES, minlength=CLASSES), 3).astype(np.uint8).reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def _excess() -> np.ndarray:
    """How much the four counts of one byte exceed those of another, all told."""
    c = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int8)
    return np.maximum(c[:, None, :] - c[None, :, :], 0).sum(2).astype(np.uint8).reshape(-1)


_EXCESS = _excess()


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits that rows of packed word counts differ by at least."""
    wide, other = a.astype(np.uint16), b.astype(np.uint16)
    return np.maximum(_EXCESS[wide << 8 | other].sum(1, dtype=np.int64), _EXCESS[other << 8 | wide].sum(1, dtype=np.int64))


def sketch_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, h1, h2, counts, sketch) for each text with words: how many there are, 128 bits that
    equal word sequences share, packed word counts, and sketches."""
    texts = _texts(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(SKETCHES)
        for batch in batches:
            at, size, whole, counts, parts = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = word_hashes(text.as_py())
                if not len(words):
                    continue
                n = np.arange(1, len(words) + 1, dtype=np.uint64)
                wide = words.astype(np.uint64)
                whole.append(((wide * (n * np.uint64(_BASE) | np.uint64(1))).sum(), ((wide + n) * (wide + np.uint64(_BASE)) ^ n).sum()))
                counts.append(word_counts(words))
                parts.append(sketches(labelled_kmers(words), factors))
                at.append(i)
                size.append(len(words))
            both = np.array(whole, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            flat = (np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * SKETCHES, pa.int32()), pa.array(flat))
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(size, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(counts, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "h1", "h2", "counts", "sketch"])

    return texts.mapInArrow(run, f"id {id_type}, n int, h1 bigint, h2 bigint, counts binary, sketch array<bigint>")


def _word_table(texts: DataFrame) -> DataFrame:
    """Rows (id, words): 32-bit word hashes in order."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["id", "words"])

    return texts.mapInArrow(run, f"id {id_type}, words binary")


def _plausible(pairs: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that neither lengths nor word counts rule out."""
    of = lambda side: counts.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("counts").alias(f"c{side}"))
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, CLASSES // 4) for c in ("ca", "cb"))
            step = 4096
            bound = np.concatenate([least_edits(a[i : i + step], b[i : i + step]) for i in range(0, max(1, len(a)), step)])
            yield batch.select(["a", "b"]).filter(pa.array(bound <= (1 - least) * n + 1e-9))

    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.abs(F.col("na") - F.col("nb")) <= F.lit(1 - least) * F.greatest("na", "nb") + F.lit(1e-9))
    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def _apart(rows: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of the rows (key, id, n, root, counts) that share a key but no root, and that
    neither lengths nor word counts rule out. Each bucket is streamed in order of length; only the
    rows that a longer text may still be close to are held. The rows of a bucket of more than BLOCK
    are dealt to blocks, and each of them goes to the cells that its block makes with any other."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "n", "id", "root", "block", "counts")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table, new = pa.Table.from_batches([batch]), 0
            if held is not None:
                table, new = pa.concat_tables([held, table]).combine_chunks(), held.num_rows
            key, one, two, n, root, ids, block = (table.column(c).to_numpy() for c in ("key", "one", "two", "n", "root", "id", "block"))
            n = n.astype(np.int64)
            change = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.uint8).reshape(-1, CLASSES // 4)
            bucket = np.cumsum(np.concatenate(([0], change))) << 32
            # of each row, the first in its bucket that is long enough
            first = np.searchsorted(bucket + n, bucket + np.ceil(n - ((1 - least) * n + 1e-9)).astype(np.int64))
            held = table.slice(first[-1])
            until = np.cumsum(np.arange(new, len(n)) - first[new:])
            for lo in range(0, int(until[-1]), PAIRS):
                pair = np.arange(lo, min(lo + PAIRS, int(until[-1])))
                at = np.searchsorted(until, pair, side="right")
                j = at + new
                i = j - (until[at] - pair)
                other = np.flatnonzero((root[i] != root[j]) & ((one[j] == two[j]) | (block[i] != block[j])))
                i, j = i[other], j[other]
                near = least_edits(counts[i], counts[j]) <= (1 - least) * n[j] + 1e-9
                i, j = pa.array(i[near]), pa.array(j[near])
                if len(i):
                    swap = pa.array(ids[i] > ids[j])
                    x, y = (table.column("id").take(k).combine_chunks() for k in (i, j))
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, y, x), pc.if_else(swap, x, y)], names=["a", "b"])

    ordered = cells.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "n", "id")
    return ordered.mapInArrow(run, f"a {id_type}, b {id_type}").where("a < b").distinct()


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    of = lambda side: words.select(F.col("id").alias(side), F.col("words").alias(f"w{side}"))
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), dtype=np.uint32), np.frombuffer(y.as_buffer(), dtype=np.uint32), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "wa", "wb").mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Rows (id, root) of all ids of the links (a, b) but the roots, a root being the least id of
    its component. Alternates large-star and small-star steps until nothing changes."""
    links = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
        small = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        links = keep(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now


#: A table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_IDS = 2_000_000


def _hinted(table: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    return F.broadcast(table) if fits(table, most) else table


def near_duplicates(docs: DataFrame, *, least: float = MIN_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, duplicate_of), one for each document that a document of lesser id stands for.

    duplicate_of is the least id of the group: of the documents linked, directly or through
    others, by an edit similarity of `least` (over 0, up to 1) or more, counted in words. Texts
    without words, null texts and null ids are in no group. Rows of one id count as one document,
    similar to another if one of its texts is. Ties go to the lesser id; other columns are ignored;
    an empty table, and one without copies, gives an empty one.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    spark = docs.sparkSession
    prepare(spark)
    with settle(spark) as keep:
        sketched = keep(sketch_table(docs, id_col=id_col, text_col=text_col))
        same = ["h1", "h2"]
        firsts = keep(sketched.groupBy(*same).agg(F.min("id").alias("root"), F.max("id").alias("last")).where("root < last").select(*same, "root"))
        copies = keep(sketched.select("id", *same).join(_hinted(firsts), same).where("id <> root").distinct())
        own = sketched.join(_hinted(copies.select("id", *same)), ["id", *same], "left_anti")
        exploded = own.select("id", "n", F.posexplode("sketch").alias("band", "part")).select("id", "n", F.xxhash64("band", "part").alias("key"))
        shared = keep(exploded.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").select("key", "rep"))
        buckets = keep(exploded.join(shared, "key").select("key", "rep", "id", "n").distinct())

        def aligned(likely: DataFrame) -> DataFrame:
            ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            words = keep(_word_table(_texts(docs, id_col, text_col).join(_hinted(ids), "id", "left_semi")))
            return keep(_verified(likely, words, least))

        counts = keep(sketched.select("id", "n", "counts").distinct())
        likely = keep(_plausible(buckets.where("rep < id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), counts, least))
        links = aligned(likely)
        rooted = buckets.join(_hinted(components(links, keep)), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        rows = keep(rooted.join(apart, "key", "left_semi"))
        more = aligned(keep(_apart(rows.join(counts, ["id", "n"]), least).join(likely, ["a", "b"], "left_anti")))

        # a copy with one text follows its first; one with several texts may tie groups together
        several = sketched.groupBy("id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in same)).where("min_h1 < max_h1 OR min_h2 < max_h2").select("id")
        several = _hinted(keep(several))
        ties = copies.join(several, "id", "left_semi").select(F.col("root").alias("a"), F.col("id").alias("b"))
        groups = components(links.unionByName(more).unionByName(ties), keep)
        roots = _hinted(groups.select(F.col("id").alias("root"), F.col("root").alias("__root")))
        follow = copies.join(several, "id", "left_anti").select("id", "root").join(roots, "root", "left").select("id", F.coalesce("__root", "root").alias("root"))
        return written(groups.unionByName(follow).select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of")))


def one_of_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, the least as JSON, of those with one id, null too, and one text; rows
    without a text all stay. Only ids and digests are shuffled, and rows that are repeated."""
    digest, same, h, row = F.md5(quoted(text_col)), *(free_name(docs.columns, n) for n in ("__same", "__digest", "__row"))
    narrow = docs.where(quoted(text_col).isNotNull()).select(quoted(id_col).alias(same), digest.alias(h))
    repeated = written(narrow.groupBy(quoted(same), quoted(h)).count().where("count > 1").drop("count"))
    if repeated.isEmpty():
        return docs
    repeated = _hinted(repeated)
    matched: Column = quoted(id_col).eqNullSafe(quoted(same)) & (digest == quoted(h))
    whole = F.struct(*(quoted(c).alias(c) for c in docs.columns))
    chosen = docs.join(repeated, matched, "left_semi").groupBy(quoted(id_col), digest).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return docs.join(repeated, matched, "left_anti").unionByName(chosen.select(F.col(row + ".*")))


def drop_near_duplicates(docs: DataFrame, *, least: float = MIN_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, without the documents that near_duplicates reports, and with one row of
    those that repeat an id and its text. Rows with a null id are in no group: of those with one text
    one stays. Rows without a text all stay."""
    name = free_name(docs.columns, "__gone")
    gone = near_duplicates(docs, least=least, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(name))
    return one_of_repeated(docs, id_col=id_col, text_col=text_col).join(_hinted(gone), quoted(id_col) == quoted(name), "left_anti")
