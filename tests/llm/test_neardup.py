import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import neardup as N

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def groups_by_brute_force(texts, least=N.MIN_SIMILARITY):
    """{id: least id of its group} of all pairs of (id, text)."""
    words = [(i, N.word_hashes(t)) for i, t in texts if i is not None and t is not None]
    words = [x for x in words if len(x[1])]
    root = {i: i for i, _ in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    counts = np.stack([np.bincount(w % 256, minlength=256) for _, w in words]) if words else np.zeros((0, 256))
    sizes = counts.sum(1)
    for i in range(len(words)):
        over = np.maximum(counts[i] - counts[i + 1 :], 0).sum(1)
        low = np.maximum(over, over + sizes[i + 1 :] - sizes[i])
        for k in np.flatnonzero(low <= (1 - least) * np.maximum(sizes[i], sizes[i + 1 :]) + 1e-9):
            (a, x), (b, y) = words[i], words[i + 1 + k]
            if find(a) != find(b) and N.similar(x, y, least):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in root if find(i) != i}


def test_band_alignment_equals_full_alignment():
    rng = np.random.default_rng(0)
    for t in range(400):
        a = rng.integers(0, 4, rng.integers(0, 14))
        b = list(a) if t % 2 else list(rng.integers(0, 4, rng.integers(0, 14)))
        for _ in range(rng.integers(0, 4)):
            if b:
                b[rng.integers(len(b))] = rng.integers(4)
            if rng.random() < 0.3:
                b.insert(rng.integers(len(b) + 1), rng.integers(4))
        d = edit_distance(list(a), b)
        for most in (0, 1, 2, 3, 5, 8, 20):
            assert N.within(a, np.array(b, dtype=np.int64), most) == (d if d <= most else None)


def test_words_have_hashes_of_their_own():
    words = [f"{a}{b}" for a in ("x", "yz", "été") for b in range(500)]
    h = N.word_hashes(" ".join(words + ["привет"] + words))
    assert len(set(h.tolist())) == 1501 and (h[:1500] == h[1501:]).all()


def test_sketches_see_order_and_occurrence():
    f = N.multipliers(N.SKETCHES)
    sketch = lambda s: set(N.sketches(N.labelled_kmers(N.word_hashes(s)), f).tolist())
    words = [f"w{i}" for i in range(200)]
    same = sketch(" ".join(words))
    assert sketch(" ".join(words)) == same
    moved = sketch(" ".join(words[100:] + words[:100]))
    assert len(same) == N.SKETCHES and len(same & moved) < N.SKETCHES
    assert len(np.unique(N.labelled_kmers(N.word_hashes("a b c " * 20)))) == 60 - N.K + 1
    assert len(sketch("a")) == N.SKETCHES and len(sketch("a b c d")) == N.SKETCHES


@pytest.mark.parametrize("words", (40, 100, 300))
@pytest.mark.parametrize("similarity", (0.75, 0.77, 0.8, 0.85, 0.9))
def test_scattered_edits_share_a_sketch(words, similarity):
    rng = np.random.default_rng(11)
    f = N.multipliers(N.SKETCHES)
    edits = round((1 - similarity) * words)
    for spaced in (False, True):
        met = 0
        for _ in range(100):
            a = rng.integers(0, 1 << 32, words, dtype=np.uint32)
            b = a.copy()
            at = np.arange(edits) * words // edits if spaced else rng.choice(words, edits, replace=False)
            b[at] = rng.integers(0, 1 << 32, edits, dtype=np.uint32)
            assert N.similar(a, b)
            met += (N.sketches(N.labelled_kmers(a), f) == N.sketches(N.labelled_kmers(b), f)).any()
        assert met >= 90


def test_least_rows_agree_with_sorting():
    rng = np.random.default_rng(3)
    for n in (4, 65, 300, 2000):
        h = rng.integers(0, 1 << 32, (16, n), dtype=np.uint32)
        got = np.sort(np.take_along_axis(h, N._least(h, 3), 1), 1)
        assert (got == np.sort(h, 1)[:, :3]).all()


def test_groups_equal_brute_force(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    got = {r.doc_id: r.duplicate_of for r in N.near_duplicates(docs).collect()}
    want = groups_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    same = sum(got.get(k) == v for k, v in want.items())
    assert len(want) > 50 and same >= 0.95 * len(want)
    assert set(got) <= set(want)


def test_word_counts_never_bound_too_high():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 9, rng.integers(1, 600)).astype(np.uint32) for _ in range(2))
        bound = N.least_edits(*(np.frombuffer(N.word_counts(x), dtype=np.uint8)[None, :] for x in (a, b)))[0]
        assert bound <= N.within(a, b, 600)


def planted(n=40, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, truth = [], {}
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        if g % 2:
            base[10:10] = passage
        root = len(rows)
        rows.append((root, " ".join(base)))
        for _ in range(30 if g == 0 else g % 3):
            copy = list(base)
            for i in range(len(copy)):
                if rng.random() < 0.08:
                    copy[i] = rng.choice(vocabulary)
            truth[len(rows)] = root
            rows.append((len(rows), " ".join(copy)))
    return rows, truth


def test_planted_groups_are_found_despite_a_shared_passage(spark):
    rows, truth = planted()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.doc_id: r.duplicate_of for r in got.collect()}
    assert found.items() <= truth.items() and len(found) >= 0.95 * len(truth)


def test_planted_groups_are_found_whole(spark):
    rows, truth = planted()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.duplicate_of for r in got.collect()} == truth


def crowded(families=6, seed=3):
    """In each family two near copies that share little but a passage; most of it stands in many
    texts of lesser ids that come between them by length and id."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows, truth = [], {}
    for _ in range(families):
        passage = [word() for _ in range(61)]
        for _ in range(120):
            at = rng.randrange(2)
            rows.append((len(rows), " ".join(passage[at : at + 60] + [word() for _ in range(21)])))
        for n in (19, 20):
            rows.append((len(rows), " ".join(passage + [word() for _ in range(n)])))
        truth[len(rows) - 1] = len(rows) - 2
    return rows, truth


def test_copies_are_found_in_crowded_buckets(spark):
    rows, truth = crowded()
    assert groups_by_brute_force(rows) == truth
    for id_type in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.format_string("%06d", "doc_id").cast(id_type))
        assert {int(r.doc_id): int(r.duplicate_of) for r in N.near_duplicates(docs).collect()} == truth


def test_pairs_across_batches_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        words = rng.integers(0, 1 << 32, 40 + i % 30, dtype=np.uint32)
        if i % 3:
            words[:36] = np.frombuffer(rows[i - i % 3][-1], dtype=np.uint32)[:36]
        rows.append((i % 2, i, len(words), i % 5, words.tobytes()))
    want = set()
    for x in rows:
        for y in rows:
            if x[1] < y[1] and x[0] == y[0] and x[3] != y[3]:
                longer = max(x[2], y[2])
                counts = [np.frombuffer(N.word_counts(np.frombuffer(z[4], dtype=np.uint32)), dtype=np.uint8)[None, :] for z in (x, y)]
                if abs(x[2] - y[2]) <= 0.25 * longer and N.least_edits(*counts)[0] <= 0.25 * longer:
                    want.add((x[1], y[1]))
    df = spark.createDataFrame([(k, i, n, r, bytearray(N.word_counts(np.frombuffer(w, dtype=np.uint32)))) for k, i, n, r, w in rows], "key bigint, id bigint, n int, root bigint, counts binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [(r.a, r.b) for r in N._apart(df, 0.75).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 5 and sorted(got) == sorted(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.root for r in N.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100, 102: 100}


LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "one two three four five six", "en", "s", 1),
        (2, "one two three four five six", None, None, None),
        (2, "one two three four five six", None, None, None),
        (3, "One, two, three: four five six!", "en", "s", 1),
        (4, None, "en", "s", 1),
        (None, "one two three four five six", "en", "s", 1),
        (5, "", "en", "s", 1),
        (6, "  ...", "en", "s", 1),
        (7, LONG, "en", "s", 1),
        (8, LONG + " end", "en", "s", 1),
        (9, "привет мир это другой текст", "ru", "s", 1),
        (10, "привет мир это другой текст", "ru", "s", 1),
        (11, "solo", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")).withColumn("root", F.lit(1)).withColumn("__gone", F.lit(2))


def test_odd_rows(odd):
    got = {r.doc_id: r.duplicate_of for r in N.near_duplicates(odd).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 10: 9}


def test_dropping_keeps_columns_and_null_ids(odd):
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 11]


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
