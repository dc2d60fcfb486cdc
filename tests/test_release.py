"""The behaviour that a release promises, on literal trees of files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quern import errors
from quern.functions import classify
from quern.functions.codec import nonce, seal, unseal, unzstd_column, zstd_column
from quern.functions.paths import is_canonical
from quern.operators import cache, chunk, dedup, lookup, segments, stats, verify
from quern.operators.ordering import with_index, with_running
from quern.plans import diff as D
from quern.plans import pack as P
from quern.schema import KIB, MIB, SMALL, Limits
from quern.sources import files, store

SIZES = Limits()


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def assets(spark, rows):
    return spark.createDataFrame([(p, c, len(c)) for p, c in rows], "path string, content binary, len bigint")


def contents(spark, release, rows):
    body = assets(spark, rows)
    piece = F.substring("content", (F.col("logical_offset") + 1).cast("int"), F.col("plain_len").cast("int"))
    return release.blocks.join(body, "path").select("path", "block_no", piece.alias("content"))


# classification


@pytest.mark.parametrize(
    ("path", "length", "access", "layout", "block"),
    [
        ("tiny", 0, "hot", "fixed", 1),
        ("MOVIE.MP4", 1, "streaming", "fixed", 256 * KIB),
        ("voice/line.opus", 12 * KIB, "transient", "fixed", 256 * KIB),
        ("bgm/theme.opus", 12 * KIB, "streaming", "fixed", 256 * KIB),
        ("x/Music/theme.wav", 12 * KIB, "streaming", "fixed", 256 * KIB),
        ("voice/long.wav", MIB + 1, "streaming", "fixed", 256 * KIB),
        ("asset.bin", 32 * KIB, "hot", "fixed", 32 * KIB),
        ("asset.bin", 32 * KIB + 1, "normal", "content_defined", 0),
        ("asset.bin", 64 * MIB + 1, "normal", "fixed", MIB),
    ],
)
def test_classes(spark, path, length, access, layout, block):
    row = classify.with_classes(spark.createDataFrame([(path, length)], "path string, len bigint"), SIZES).first()
    assert (row.access, row.layout, row.fixed_block_len) == (access, layout, block)


def test_policies_and_prefixes(spark):
    df = spark.createDataFrame([("background.webp",), ("voice.opus",), ("a.png",), ("a.mp3",), ("opening.webm",), ("audio.wav",), ("x",), ("a/b.c/d",)], "path string")
    assert [r.c for r in df.select(classify.compression(F.col("path")).alias("c")).collect()] == ["raw"] * 5 + ["auto"] * 3
    assert df.select(classify.extension(F.col("path")).alias("e")).collect()[-1].e == "c/d"
    dlc = spark.createDataFrame([("dlc",), ("dlc/movie.mp4",), ("dlc2/movie.mp4",)], "path string")
    assert [r.a for r in dlc.select(classify.availability(F.col("path"), ["dlc"]).alias("a")).collect()] == ["deferred", "deferred", "required"]
    text = spark.createDataFrame([(" a , ,b\n c/d ",)], "t string")
    assert text.select(classify.parse_prefixes(F.col("t")).alias("p")).first().p == ["a", "b", "c/d"]


def test_paths(spark):
    good = ["video/opening.mp4", "a", "console.txt", "com0", "a\x7f", "naïve/ß"]
    bad = ["", "/a", "a/", "a//b", "a/./b", "a/../b", "a\\b", "a\0b", "C:/asset", "a:b", "NUL", "nul.txt", "voice/COM1.ogg", "LPT³.bin", "trailing. ", "trailing.", " leading/name", "bad?/name", "control/\x1f", "a\n"]
    df = spark.createDataFrame([(p,) for p in good + bad], "path string")
    ok = {r.path: r.ok for r in df.select("path", is_canonical(F.col("path")).alias("ok")).collect()}
    assert [p for p in good if not ok[p]] == [] and [p for p in bad if ok[p]] == []


def test_human_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, MIB, 5 * 1024 * MIB)], "n bigint")
    assert [r.s for r in df.select(classify.human_size(F.col("n")).alias("s")).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "5.0 GiB"]


def test_human_sizes_round_as_printf_does(spark):
    """Ties, values beside them, carries into the next digit, lengths that doubles cannot tell apart, and no length."""
    ties = [(2 * k + 1) << (bits - 2) for bits in (10, 20, 30) for k in (2, 3, 4, 5, 1021, 2046)]
    sizes = [m for n in ties for m in (n - 1, n, n + 1)] + [1075, 1076, 1047_552, MIB - 1, (1 << 30) - 1, (1 << 53) + 1, (1 << 63) - 1]
    of = lambda n: next(f"{n / (1 << b):.1f} {unit}" for b, unit in ((10, "KiB"), (20, "MiB"), (30, "GiB")) if b == 30 or n < 1 << (b + 10))
    df = spark.createDataFrame([(n,) for n in [*sizes, None]], "n bigint")
    got = [r.s for r in df.select(classify.human_size(F.col("n")).alias("s")).collect()]
    assert got == [*map(of, sizes), None]
    assert of(1280) == "1.2 KiB" and of(1792) == "1.8 KiB"


# codecs


def test_codecs(spark):
    df = spark.createDataFrame([(b"x" * 5000, 1), (noise(300), 2), (b"", 3)], "content binary, i bigint")
    packed = df.withColumn("packed", zstd_column()(F.col("content"))).withColumn("n", F.length("content"))
    assert packed.where(unzstd_column()(F.col("packed"), F.col("n")) == F.col("content")).count() == 3
    with pytest.raises(Exception, match="bytes|decode"):
        packed.select(unzstd_column()(F.col("packed"), F.col("n") + 1)).collect()
    key, ctx = F.lit(b"k" * 32), F.lit("block")
    iv = nonce(F.lit(b"12345678"), F.col("i"))
    sealed = df.withColumn("iv", iv).withColumn("s", seal(F.col("content"), key, F.col("iv"), ctx))
    assert sealed.where(F.length("s") == F.length("content") + 16).count() == 3
    assert bytes(sealed.first().iv) == b"12345678\x01\0\0\0"
    assert sealed.where(unseal(F.col("s"), key, F.col("iv"), ctx) == F.col("content")).count() == 3


def test_codecs_hold_few_contents_at_once(spark):
    """Rows are not gathered in Arrow batches of up to 10,000 contents; what is null stays null."""
    df = spark.createDataFrame([(b"x" * 5000, 5000), (b"", 0), (None, None)], "content binary, n bigint")
    back = df.withColumn("packed", zstd_column()(F.col("content"))).select("content", unzstd_column()(F.col("packed"), F.col("n")).alias("back"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 2
    assert back.where(F.col("content").eqNullSafe(F.col("back"))).count() == 3
    for row in ((None, 3), (b"x", None)):
        with pytest.raises(Exception, match="no content or no length"):
            spark.createDataFrame([row], "e binary, n bigint").select(unzstd_column()(F.col("e"), F.col("n"))).collect()


# chunking


def test_cut_points():
    data = noise(200_000)
    ends = chunk.cut_points(data, 2048, 8192, 32768)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(2048 <= s <= 32768 for s in sizes[:-1]) and sizes[-1] <= 32768 and 8 < len(sizes) < 80
    moved = chunk.cut_points(b"inserted" + data, 2048, 8192, 32768)
    assert len({e - 8 for e in moved} & set(ends)) > len(ends) // 2
    assert chunk.cut_points(b"", 4, 8, 16) == [] and chunk.cut_points(b"abc", 4, 8, 16) == [3]


def test_blocks_rebuild_contents(spark):
    rows = [("a.bin", noise(50_000)), ("b.txt", b"hello"), ("empty", b""), ("v.mp4", noise(3000, 2))]
    classified = classify.with_classes(assets(spark, rows), SMALL)
    blocks = chunk.chunks(classified.select("path", "content", "layout", "fixed_block_len"), SMALL)
    assert chunk.length_mismatches(assets(spark, rows), blocks).count() == 0
    import hashlib

    body = dict(rows)
    for r in blocks.collect():
        assert r.chunk_id == hashlib.sha256(body[r.path][r.logical_offset : r.logical_offset + r.plain_len]).hexdigest()


# ordering


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    rows = with_running(df, ["k"], {"t": F.col("v")}).orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.t == total
        total += r.v
    assert [r["index"] for r in with_index(df, ["k"]).orderBy("k").collect()] == list(range(1000))


# packing


def test_dedup_of_equal_files(spark):
    same = noise(100_000)
    options = P.Options(Limits(content_defined=0), compress=False)
    release, report = P.pack(assets(spark, [("a.bin", same), ("b.bin", same)]), options)
    assert (report["total_blocks"], report["new_blocks"], report["reused_blocks"]) == (2, 1, 1)
    assert report["retained"] == 100_000 + 16 + 4096 and report["stranded"] == 0


def test_full_incremental_unchanged(spark):
    rows = [("empty.txt", b""), ("script/main.json", b"dialogue line\n" * 20_000), ("video/opening.mp4", noise(700_000))]
    first, report = P.pack(assets(spark, rows))
    assert report["changed"] and report["release_sequence"] == 1 and report["files"] == 3
    rows[1] = ("script/main.json", rows[1][1] + b"more lines\n" * 3)
    second, report = P.pack(assets(spark, rows), previous=first)
    assert report["changed"] and report["new_blocks"] > 0 and report["reused_blocks"] > 0 and report["release_sequence"] == 2
    assert verify.catalog_violations(second.assets, second.blocks, second.segments).where("violations > 0").count() == 0
    third, report = P.pack(assets(spark, rows), previous=second)
    assert not report["changed"] and report["new_blocks"] == 0 and third.sequence == 2
    moved, report = P.pack(assets(spark, rows), P.Options(deferred=["video"]), previous=second)
    assert report["changed"]
    plan = D.diff(D.content_keys(assets(spark, rows)), D.content_keys(assets(spark, rows)), SIZES, ["video"])
    assert {r.change for r in plan.collect()} == {"Unchanged"}


def test_rotation_and_isolation(spark):
    options = P.Options(segment_target=MIB, compress=False)
    _, report = P.pack(assets(spark, [("movie.mp4", noise(2 * MIB))]), options)
    assert report["segments"] == 3
    rows = [("hot.txt", noise(KIB, 3)), ("normal.bin", noise(40 * KIB, 4)), ("stream.mp4", noise(40 * KIB, 5)), ("dlc/stream.mp4", noise(40 * KIB, 6))]
    options = P.Options(deferred=["dlc"], compress=False)
    first, report = P.pack(assets(spark, rows), options)
    assert report["segments"] == 4 and report["stranded"] == 0 and report["retained"] - report["referenced"] == 4 * 4096
    rows[0] = ("hot.txt", noise(KIB, 9))
    _, report = P.pack(assets(spark, rows), options, first)
    assert report["new_blocks"] == 1
    placed = spark.createDataFrame([("a", 0, "r", "hot", 500, 100), ("b", 0, "r", "hot", 10, 100), ("c", 0, "r", "hot", 90, 100), ("d", 0, "r", "hot", 1, 100)], "path string, block_no bigint, availability string, access string, stored_len bigint, target bigint")
    assert [r.segment_no for r in segments.rotate(placed).orderBy("path").collect()] == [0, 1, 1, 2]


def test_options_and_bad_paths(spark):
    for options in (P.Options(segment_target=1), P.Options(zstd_level=23), P.Options(deferred=["/x"])):
        with pytest.raises(errors.InvalidInput):
            P.pack(assets(spark, []), options)
    with pytest.raises(errors.InvalidInput):
        P.pack(assets(spark, [("a//b", b"x")]))


def test_reuse_scope(spark):
    block = lambda p, a, pol: (p, 0, 0, 10, "c", a, "required", pol)
    ours = spark.createDataFrame([block("a", "hot", "auto"), block("b", "normal", "auto"), block("c", "normal", "raw")], "path string, block_no bigint, logical_offset bigint, plain_len bigint, chunk_id string, access string, availability string, compression string")
    old = spark.createDataFrame([("c", "required", 10, "zstd", "s1", 5), ("c", "required", 10, "raw", "s0", 9)], "chunk_id string, availability string, plain_len bigint, codec string, segment_id string, global_index bigint")
    got = {r.path: (r.origin, r.reused_segment_id) for r in dedup.reuse(ours, old).collect()}
    # the released block is compressed, which c does not take
    assert got == {"a": ("release", "s1"), "b": ("release", "s1"), "c": ("new", None)}
    raw = old.where("codec = 'raw'")
    assert {r.path: r.origin for r in dedup.reuse(ours, raw).collect()} == {"a": "release", "b": "release", "c": "self"}


def test_storage_numbers_and_faults(spark):
    table = spark.createDataFrame([("s", 2, 1000, 5096)], "segment_id string, block_count bigint, payload_len bigint, file_len bigint")
    refs = lambda rows: spark.createDataFrame(rows, "segment_id string, segment_block_ordinal bigint, stored_len bigint")
    assert stats.checked_storage(table, refs([("s", 0, 400), ("s", 0, 400)])) == {"retained": 5096, "referenced": 400, "stranded": 600}
    for rows in ([("t", 0, 400)], [("s", 2, 400)], [("s", 0, 400), ("s", 0, 401)], [("s", 0, 2000)]):
        with pytest.raises(errors.IntegrityError):
            stats.checked_storage(table, refs(rows))


def test_storage_reads_the_references_once(spark):
    table = spark.createDataFrame([("s", 2, 1000, 5096)], "segment_id string, block_count bigint, payload_len bigint, file_len bigint")
    seen = spark.sparkContext.accumulator(0)

    def length(n):
        seen.add(1)
        return n

    refs = spark.createDataFrame([("s", k % 2, 400) for k in range(30)], "segment_id string, segment_block_ordinal bigint, n bigint")
    refs = refs.select("segment_id", "segment_block_ordinal", F.udf(length, "bigint")("n").alias("stored_len"))
    assert stats.checked_storage(table, refs) == {"retained": 5096, "referenced": 800, "stranded": 200}
    assert seen.value == 30


def test_report_reads_contents_once(spark, testdata, monkeypatch):
    from quern import queries as Q
    from quern import views as V

    d, seen, plain = f"{testdata}/sf0.001", spark.sparkContext.accumulator(0), V.new_assets

    def content(b):
        seen.add(1)
        return b

    n, want = plain(spark, d).count(), Q.QUERIES["agg7_report"](spark, d).collect()
    monkeypatch.setattr(V, "new_assets", lambda s, d: plain(s, d).withColumn("content", F.udf(content, "binary")("content")))
    assert Q.QUERIES["agg7_report"](spark, d).collect() == want
    assert seen.value == n


# plans


def test_plan(spark):
    old = assets(spark, [("same.txt", b"same"), ("edit.txt", b"old!"), ("remove.txt", b"x"), ("dlc/later.bin", b"1")])
    new = assets(spark, [("same.txt", b"same"), ("edit.txt", b"new!"), ("added.txt", b"added"), ("dlc/later.bin", b"1")])
    plan = D.diff(D.content_keys(new), D.content_keys(old), SIZES, ["dlc"])
    got = {r.path: r for r in plan.collect()}
    assert {p: r.change for p, r in got.items()} == {"same.txt": "Unchanged", "edit.txt": "Modified", "remove.txt": "Removed", "added.txt": "Added", "dlc/later.bin": "Unchanged"}
    assert got["dlc/later.bin"].availability == "deferred" and got["remove.txt"].source_len is None
    assert D.totals(plan).first().changed_source_bytes == 9


def test_stale_plans(spark):
    released = assets(spark, [("asset.bin", b"four")])
    D.check_fresh(assets(spark, [("asset.bin", b"FOUR")]), released)
    for rows in ([("asset.bin", b"four"), ("b", b"")], [("asset.bin", b"fourfive")], []):
        with pytest.raises(errors.StalePlan):
            D.check_fresh(assets(spark, rows), released)


# reading


def test_ranges(spark):
    rows = [("a.bin", noise(5000)), ("empty", b"")]
    release, _ = P.pack(assets(spark, rows), P.Options(SMALL, compress=False))
    body = release.blocks.join(contents(spark, release, rows), ["path", "block_no"])
    wanted = [(1, "a.bin", 0, 5000), (2, "a.bin", 1023, 2), (3, "a.bin", 4990, 99), (4, "a.bin", 5000, 9), (5, "a.bin", 5001, 1), (6, "empty", 0, 4), (7, "none", 0, 1), (8, "a.bin", 7, 0)]
    got = {r.request_id: r for r in lookup.read_ranges(spark.createDataFrame(wanted, "request_id bigint, path string, offset bigint, n bigint"), release.assets, body).collect()}
    data = rows[0][1]
    assert [bytes(got[i].data) for i in (1, 2, 3, 4, 6, 8)] == [data, data[1023:1025], data[4990:], b"", b"", b""]
    assert (got[5].status, got[7].status, got[5].data) == ("out_of_range", "not_found", None)


def test_store(spark, tmp_path):
    rows = [("core/config.json", b"{}" * 40), ("dlc/movie.mp4", noise(700_000))]
    root = str(tmp_path)
    with store.locked(root):
        with pytest.raises(errors.BuildLocked), store.locked(root):
            pass
    release, _ = P.pack(assets(spark, rows), P.Options(deferred=["dlc"]))
    with pytest.raises(errors.InvalidFormat):
        store.open_release(spark, root)
    store.write(release, root, "p1")
    with pytest.raises(errors.InvalidFormat):
        store.commit(root, 7)
    store.commit(root, release.sequence)
    opened = store.open_release(spark, root, "p1", at_least=1)
    opened.check()
    assert [r.path for r in opened.list_assets().collect()] == ["core/config.json", "dlc/movie.mp4"]
    assert {r.availability for r in opened.list_segments().collect()} == {"required", "deferred"}
    with pytest.raises(errors.ReleaseRollback):
        store.open_release(spark, root, at_least=2)
    with pytest.raises(errors.ProjectMismatch):
        store.open_release(spark, root, "p2")
    with pytest.raises(errors.AssetNotFound):
        opened.asset("nothing")
    assert opened.contains("core/config.json") and opened.reuse_records().count() == opened.blocks.count()
    cursor = opened.cursor("dlc/movie.mp4", contents(spark, release, rows))
    assert cursor.read(10) == rows[1][1][:10] and cursor.seek(-5, os.SEEK_END) == 699_995 and cursor.read() == rows[1][1][-5:]
    with pytest.raises(errors.OutOfRange):
        cursor.seek(1, os.SEEK_END)
    os.makedirs(f"{root}/release_sequence=2")
    assert store.recover(root) == ["release_sequence=2"] and store.current(root) == 1
    required = verify.not_installed(release.segments, release.segments.where("availability = 'required'"))
    assert required.count() == 0
    assert verify.not_installed(release.segments, release.segments.where("availability = 'required'"), None).count() == 1


def test_garbage(spark, tmp_path):
    os.makedirs(tmp_path / "data")
    for name in ("a" * 64, "B" * 64, "notes.txt"):
        (tmp_path / "data" / name).write_bytes(b"x")
    names = spark.createDataFrame([(n,) for n in os.listdir(tmp_path / "data")], "name string")
    active = spark.createDataFrame([("b" * 64,)], "segment_id string")
    assert store.collect_garbage(str(tmp_path), names, active) == ["a" * 64]
    assert sorted(os.listdir(tmp_path / "data")) == ["B" * 64, "notes.txt"]


def test_build_cache(spark, tmp_path):
    root = str(tmp_path)
    assert store.load_cache(spark, root, "p", 1) is None
    entry = [("a", 3, 1, "hot", "auto", [(0, 3, "c")])]
    schema = "path string, len bigint, mtime bigint, access string, compression string, chunks array<struct<logical_offset:bigint,plain_len:bigint,chunk_id:string>>"
    entries = spark.createDataFrame(entry, schema)
    store.save_cache(entries, root, "p", 1)
    assert store.load_cache(spark, root, "p", 1).count() == 1
    assert store.load_cache(spark, root, "q", 1) is None and store.load_cache(spark, root, "p", 2) is None
    sources = spark.createDataFrame([("a", 3, 1, "hot", "auto"), ("b", 3, 1, "hot", "auto")], "path string, len bigint, mtime bigint, access string, compression string")
    known = spark.createDataFrame([("c",)], "chunk_id string")
    assert [r.path for r in dedup.unchanged_since(sources, entries, known).collect()] == ["a"]
    assert dedup.unchanged_since(sources.withColumn("mtime", F.lit(2)), entries, known).count() == 0
    assert dedup.unchanged_since(sources, entries, known.limit(0)).count() == 0
    store.save_cache(entries.union(entries), root, "p", 1)
    assert store.load_cache(spark, root, "p", 1) is None


def test_files(spark, tmp_path):
    tree, out = tmp_path / "in", tmp_path / "out"
    (tree / "sub dir").mkdir(parents=True)
    out.mkdir()
    rows = [("a.txt", b"one"), ("sub dir/b+c.bin", noise(5000)), ("empty", b"")]
    for p, c in rows:
        (tree / p).write_bytes(c)
    found = files.scan(spark, str(tree))
    assert sorted((r.path, bytes(r.content), r.len) for r in found.collect()) == sorted((p, c, len(c)) for p, c in rows)
    files.check_sources(str(tree), found)
    files.check_unchanged(found, files.scan(spark, str(tree)))
    release, _ = P.pack(found.select("path", "content", "len"), P.Options(SMALL))
    body = contents(spark, release, rows)
    assert {r.path: r.bytes for r in files.extract(release.assets, body, str(out)).collect()} == {p: len(c) for p, c in rows}
    assert all((out / p).read_bytes() == c for p, c in rows)
    with pytest.raises(Exception, match="exists"):
        files.extract(release.assets, body, str(out))
    evil = spark.createDataFrame([("../x",)], "path string")
    with pytest.raises(Exception, match="leads out"):
        files.extract(evil, body, str(out))
    (tree / "key").write_bytes(files.KEY_MAGIC + b"1")
    with pytest.raises(errors.InvalidInput):
        files.check_sources(str(tree), files.scan(spark, str(tree)))
    with pytest.raises(errors.StalePlan):
        files.check_unchanged(found.where("path <> 'a.txt'"), found)
    os.unlink(tree / "key")
    os.symlink(tree / "a.txt", tree / "link")
    with pytest.raises(errors.InvalidInput):
        files.check_sources(str(tree), found)


def test_import_and_replace(tmp_path):
    src, root = tmp_path / "src", tmp_path / "root"
    src.mkdir(), root.mkdir()
    for n in "ab":
        (src / n).write_text(n)
    assert len(files.import_files([str(src / "a")], str(root))) == 1
    with pytest.raises(FileExistsError):
        files.import_files([str(src / "b"), str(src / "a")], str(root))
    assert sorted(os.listdir(root)) == ["a"]
    with pytest.raises(errors.InvalidInput):
        files.import_files([str(src / "a"), str(root / "a")], str(tmp_path))
    files.replace_file(str(src / "b"), str(root / "a"))
    assert (root / "a").read_text() == "b" and os.listdir(root) == ["a"]


# caches


def test_clock_cache():
    c = cache.ClockCache(10)
    c.insert("a", 4), c.insert("b", 4), c.insert("big", 11)
    assert c.get("a") and c.get("b") and not c.get("big")
    c.insert("c", 4)
    assert not c.get("a") and c.get("b") and c.get("c") and c.used == 8
    c.trim()
    assert c.used == 0 and not c.get("b")


def test_replay_rules():
    r = cache.Replay(cache.Budget(100, 50, 2))
    assert [r.read("h", 10, "hot"), r.read("h", 10, "hot")] == ["backend", "cache"]
    assert [r.read("n", 10, "normal") for _ in range(3)] == ["backend", "backend", "cache"]
    assert [r.read("t", 10, "transient") for _ in range(2)] == ["backend", "backend"]
    assert [r.read(k, 10, "streaming") for k in "ABABC"] == ["backend", "backend", "window", "window", "backend"]
    assert r.prefetch("p", 40) and not r.prefetch("p", 40) and not r.prefetch("q", 51) and r.read("p", 40, "transient") == "prefetch"
    r = cache.Replay(cache.Budget(100, 0, 2))
    assert [r.read(k, 1, "normal") for k in "xyzxx"] == ["backend"] * 5 and r.read("x", 1, "normal") == "cache"
    assert cache.Replay(cache.Budget.disabled()).read("h", 1, "hot") == "backend"


def test_replay_equals_plain(spark, testdata):
    from quern.views import trace

    t = trace(spark, f"{testdata}/sf0.001")
    budget = cache.Budget(20_000, 8_000, 8)
    got = {(r.session, r.seq): r.source for r in cache.replay(t, budget).collect()}
    for session in {s for s, _ in got}:
        state = cache.Replay(budget)
        for r in sorted(t.where(F.col("session") == session).collect(), key=lambda r: r.seq)[:50]:
            want = ("ahead" if state.prefetch(r.block, r["size"]) else "skipped") if r.prefetch else state.read(r.block, r["size"], r.access)
            assert got[r.session, r.seq] == want
        break


def test_stream_of_files(spark, tmp_path):
    from quern.streaming import incoming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp4").write_bytes(b"x")
    q = incoming(spark, str(tmp_path / "in"), SIZES).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.path, r.access) for r in spark.table("seen").collect()] == [("a.mp4", "streaming")]


def test_rotation_by_leaps_equals_block_by_block(spark):
    rng = random.Random(4)
    rows = [(f"p{i:04d}", 0, rng.choice(("r", "d")), rng.choice(("hot", "normal")), rng.choice((1, 10, 40, 99, 100, 101, 250)), 100) for i in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        df = spark.createDataFrame(rows, "path string, block_no bigint, availability string, access string, stored_len bigint, target bigint")
        got = {r.path: (r.segment_no, r.segment_block_ordinal, r.physical_offset) for r in segments.rotate(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    state = {}
    for p, _, a, k, n, target in rows:
        segment, count, payload = state.get((a, k), (0, 0, 0))
        if count and payload + n > target:
            segment, count, payload = segment + 1, 0, 0
        assert got[p] == (segment, count, 4096 + payload)
        state[a, k] = (segment, count + 1, payload + n)


def test_open_segments_and_ranges_ahead():
    held = cache.OpenSegments(2)
    assert [held.use(x) for x in "abacb"] == [False, False, True, False, False]
    assert not cache.OpenSegments(0).use("a")
    r = cache.Replay(cache.Budget(100, 50, 2))
    assert r.prefetch_all([("a", 20), ("b", 20), ("big", 60), ("a", 20)]) == 2 and r.read("a", 20, "transient") == "prefetch"


def test_sums_that_overflow_raise(spark):
    df = spark.createDataFrame([(2**62,), (2**62,)], "len bigint")
    with pytest.raises(Exception, match="OVERFLOW"):
        stats.total_bytes(df).collect()


def test_bodies_in_files_and_columns_are_cut_alike(spark, tmp_path):
    from quern.sources import bodies

    rows = [("a.bin", noise(50_000)), ("b.txt", b"hello"), ("empty", b""), ("v.mp4", noise(3000, 2))]
    for p, c in rows:
        (tmp_path / p).write_bytes(c)
    here = classify.with_classes(assets(spark, rows), SMALL)
    there = files.listed(spark, str(tmp_path))
    there = classify.with_classes(spark.createDataFrame(there.collect(), there.schema), SMALL)
    cut = lambda df: sorted(tuple(r) for r in bodies.cut(df, SMALL).collect())
    assert cut(here) == cut(there)
    old = chunk.chunks(here.select("path", "content", "layout", "fixed_block_len"), SMALL)
    assert sorted((r.path, r.block_no, r.logical_offset, r.plain_len, r.chunk_id) for r in old.collect()) == [(r[0], *r[4:]) for r in cut(here)]
    encode = lambda df: sorted((r.path, r.block_no, r.codec, bytes(r.encoded)) for r in bodies.encode(bodies.cut(here, SMALL), df, level=3, least_gain=64).collect())
    assert encode(here) == encode(there)
    (tmp_path / "a.bin").write_bytes(noise(50_000, 9))
    with pytest.raises(Exception, match="changed during the build"):
        encode(there)
    (tmp_path / "a.bin").write_bytes(b"short")
    with pytest.raises(Exception, match="bytes, not"):
        cut(there)


def test_package_is_shipped_as_an_archive(spark):
    import zipfile

    from quern import session

    at = session.ship(spark)
    with zipfile.ZipFile(at.removeprefix("file:")) as z:
        assert "quern/session.py" in z.namelist()
    assert session.ship(spark) == at


def test_keys_have_one_use_each():
    from quern.sources.identity import KeySchedule

    k = KeySchedule(b"k" * 32, "p")
    made = [k.segment("a"), k.segment("b"), k.snapshot(1), k.snapshot(2), k.paths(), KeySchedule(b"k" * 32, "q").segment("a")]
    assert len(set(made)) == 6 and all(len(x) == 32 for x in made) and k.segment("a") == KeySchedule(b"k" * 32, "p").segment("a")
