import os
import random
import shutil

import pytest

from quern import __main__ as cli
from quern import api, errors
from quern.plans.pack import Options
from quern.schema import SMALL
from quern.sources import identity

OPTIONS = Options(SMALL, deferred=["dlc"])


def test_directory_to_release_and_back(spark, tmp_path):
    source, output, target = (str(tmp_path / n) for n in ("in", "out", "back"))
    os.makedirs(f"{source}/dlc"), os.makedirs(target)
    movie = random.Random(1).randbytes(20_000)
    tree = {"a.txt": b"one\n" * 900, "dlc/movie.mp4": movie, "copy.bin": movie, "empty": b""}
    for p, c in tree.items():
        with open(f"{source}/{p}", "wb") as f:
            f.write(c)
    assert {r.change for r in api.plan_directory(spark, source, output, options=OPTIONS).collect()} == {"Added"}
    report = api.pack_directory(spark, source, output, options=OPTIONS)
    assert report["changed"] and report["release_sequence"] == 1 and report["files"] == 4 and report["stranded"] == 0
    assert api.verify_release(spark, output) == report["total_blocks"]
    assert {r.change for r in api.plan_directory(spark, source, output, options=OPTIONS).collect()} == {"Unchanged"}
    assert api.plan_directory_after_pack(spark, source, output, options=OPTIONS).count() == 4
    assert not api.pack_directory(spark, source, output, options=OPTIONS)["changed"]
    assert api.extract_release(spark, output, target).count() == 4
    for p, c in tree.items():
        with open(f"{target}/{p}", "rb") as f:
            assert f.read() == c

    with open(f"{source}/a.txt", "ab") as f:
        f.write(b"more")
    with pytest.raises(errors.StalePlan):
        api.plan_directory_after_pack(spark, source, output, options=OPTIONS)
    changes = {r.path: r.change for r in api.plan_directory(spark, source, output, options=OPTIONS).collect()}
    assert changes == {"a.txt": "Modified", "dlc/movie.mp4": "Unchanged", "copy.bin": "Unchanged", "empty": "Unchanged"}
    report = api.pack_directory(spark, source, output, options=OPTIONS)
    assert report["release_sequence"] == 2 and report["reused_blocks"] > 0 and report["new_blocks"] > 0
    assert api.verify_release(spark, output, at_least=2) == report["total_blocks"]
    with pytest.raises(errors.ReleaseRollback):
        api.verify_release(spark, output, at_least=3)

    data = f"{output}/data"
    shutil.rmtree(f"{data}/{sorted(n for n in os.listdir(data) if n.startswith('segment_id='))[0]}")
    with pytest.raises(errors.SegmentUnavailable):
        api.verify_release(spark, output)


def test_command_line_arguments():
    assert cli.parser().parse_args(["pack", "a", "b", "--deferred", "dlc"]).deferred == ["dlc"]
    for bad in ([], ["pack"], ["unknown"], ["extract", "a"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def tree(root, files):
    for p, c in files.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "wb") as f:
            f.write(c)


def read_back(spark, output, target, **how):
    os.makedirs(target)
    api.extract_release(spark, output, target, **how)
    out = {}
    for folder, _, names in os.walk(target):
        for n in names:
            with open(f"{folder}/{n}", "rb") as f:
                out[os.path.relpath(f"{folder}/{n}", target)] = f.read()
    return out


SAME = random.Random(7).randbytes(1500)


def test_equal_files_of_two_availabilities(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    files = {"a.bin": SAME, "dlc/a.bin": SAME, "b.txt": b"text " * 400}
    tree(source, files)
    report = api.pack_directory(spark, source, output, options=OPTIONS)
    assert report["stranded"] == 0 and report["segments"] == 2
    assert read_back(spark, output, str(tmp_path / "back")) == files
    assert {r.change for r in api.plan_directory(spark, source, output, options=OPTIONS).collect()} == {"Unchanged"}

    segment = sorted(os.listdir(f"{output}/data"))[0]
    part = next(n for n in os.listdir(f"{output}/data/{segment}") if n.endswith(".parquet"))
    shutil.copy(f"{output}/data/{segment}/{part}", f"{output}/data/{segment}/more-{part}")
    with pytest.raises(errors.IntegrityError, match="more than once"):
        api.verify_release(spark, output)
    with pytest.raises(errors.IntegrityError):
        read_back(spark, output, str(tmp_path / "again"))
    os.unlink(f"{output}/data/{segment}/more-{part}")
    altered(spark, output)
    with pytest.raises(errors.IntegrityError, match="block"):
        api.verify_release(spark, output)


def altered(spark, output):
    """The first byte of every stored block is another."""
    data = [(r.segment_id, r.segment_block_ordinal, bytearray(b"\x01" + bytes(r.content)[1:])) for r in api.stored_data(spark, f"{output}/data").collect()]
    shutil.rmtree(f"{output}/data")
    spark.createDataFrame(data, api.DATA).write.partitionBy("segment_id").parquet(f"{output}/data")


def test_full_after_incremental_and_retry_after_a_failure(spark, tmp_path, monkeypatch):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    tree(source, {"a.bin": SAME})
    with monkeypatch.context() as m:
        m.setattr(api.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("power")))
        with pytest.raises(RuntimeError):
            api.pack_directory(spark, source, output, options=OPTIONS)
    left = os.listdir(f"{output}/data")
    assert left and api.store.current(output) is None
    assert api.pack_directory(spark, source, output, options=OPTIONS)["release_sequence"] == 1
    assert not set(left) & set(os.listdir(f"{output}/data"))
    assert read_back(spark, output, str(tmp_path / "one")) == {"a.bin": SAME}
    assert api.pack_directory(spark, source, output, options=OPTIONS, incremental=False)["release_sequence"] == 2
    assert len(os.listdir(f"{output}/data")) == 1
    assert read_back(spark, output, str(tmp_path / "two")) == {"a.bin": SAME}


def test_policies_that_take_raw_blocks_only(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    files = {n: b"same text " * 150 for n in ("a.txt", "b.webp", "c.txt", "d.png")}
    tree(source, files)
    report = api.pack_directory(spark, source, output, options=OPTIONS)
    release = api.store.open_release(spark, output)
    codecs = {r.path: r.codec for r in release.blocks.collect()}
    # from the first that takes raw blocks only, all share what it stores
    assert codecs == {"a.txt": "zstd", "b.webp": "raw", "c.txt": "raw", "d.png": "raw"} and report["new_blocks"] == 2
    stored = {r.stored_len for r in release.blocks.collect()}
    data = api.stored_data(spark, f"{output}/data").collect()
    assert {len(r.content) for r in data} == stored and len(data) == 2

    # content that does not compress is raw for all policies
    noise = {n: SAME for n in ("e.txt", "f.webp")}
    tree(source, noise)
    report = api.pack_directory(spark, source, output, options=OPTIONS)
    # the raw policy does not take the compressed block that the release before has first of that content
    assert report["new_blocks"] == 2
    assert read_back(spark, output, str(tmp_path / "last")) == files | noise


def test_sealed_and_signed_releases(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    files = {"a.txt": b"secret words " * 300, "dlc/b.bin": SAME, "empty": b""}
    tree(source, files)
    publisher = identity.Publisher.create(spark)
    reader = publisher.reader()
    assert api.pack_directory(spark, source, output, options=OPTIONS, identity=publisher)["release_sequence"] == 1
    for folder, _, names in os.walk(f"{output}/data"):
        for n in names:
            with open(f"{folder}/{n}", "rb") as f:
                assert b"secret words" not in f.read()
    assert api.verify_release(spark, output, keys=reader) > 1 and read_back(spark, output, str(tmp_path / "back"), keys=reader) == files
    assert {r.change for r in api.plan_directory(spark, source, output, options=OPTIONS, keys=reader).collect()} == {"Unchanged"}
    assert not api.pack_directory(spark, source, output, options=OPTIONS, identity=publisher)["changed"]
    with pytest.raises(errors.InvalidInput):
        api.verify_release(spark, output)
    with pytest.raises(errors.IntegrityError):
        api.verify_release(spark, output, keys=identity.Publisher.create(spark).reader())
    tree(source, {"a.txt": files["a.txt"] + b"more"})
    assert api.pack_directory(spark, source, output, options=OPTIONS, identity=publisher)["reused_blocks"] > 0

    altered(spark, output)
    with pytest.raises(errors.IntegrityError, match="block"):
        api.verify_release(spark, output, keys=reader)
    head = f"{output}/release_sequence=2/release.json"
    with open(head) as f:
        body = f.read()
    with open(head, "w") as f:
        f.write(body.replace('"release_sequence": 2', '"release_sequence":  2').replace('"source_fingerprint": "', '"source_fingerprint": "0'))
    with pytest.raises(errors.IntegrityError, match="signature"):
        api.store.open_release(spark, output, keys=reader)
    with open(head, "w") as f:
        f.write(body)
    table = f"{output}/release_sequence=2/blocks"
    part = next(n for n in sorted(os.listdir(table)) if n.endswith(".parquet"))
    with open(f"{table}/{part}", "ab") as f:
        f.write(b"x")
    with pytest.raises(errors.IntegrityError, match="files of the release"):
        api.store.open_release(spark, output, keys=reader)


def test_development_cache(spark, tmp_path, monkeypatch):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    files = {"a.txt": b"one " * 900, "b.bin": SAME * 3, "empty": b""}
    tree(source, files)
    cached = Options(SMALL, deferred=["dlc"], development_cache=True)
    api.pack_directory(spark, source, output, options=cached)
    read = []
    from quern.sources import bodies

    plain = bodies.cut
    monkeypatch.setattr(bodies, "cut", lambda df, limits: (read.append(sorted(r.path for r in df.select("path").collect())), plain(df, limits))[1])
    assert not api.pack_directory(spark, source, output, options=cached)["changed"]
    tree(source, {"a.txt": b"two " * 901})
    assert api.pack_directory(spark, source, output, options=cached)["changed"]
    assert read == [[], ["a.txt"]]
    assert read_back(spark, output, str(tmp_path / "back")) == files | {"a.txt": b"two " * 901}
    with pytest.raises(errors.InvalidInput):
        api.pack_directory(spark, source, output, options=cached, incremental=False)


def test_places_of_output_and_identity(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    os.symlink(source, tmp_path / "link")
    for output in (source, source / "out", tmp_path / "link" / "out"):
        with pytest.raises(errors.InvalidInput):
            api.check_places(str(source), str(output))
    with pytest.raises(errors.InvalidInput):
        api.check_places(str(source), str(tmp_path / "out"), str(source / "key"))
    with pytest.raises(errors.InvalidInput):
        api.check_places(str(tmp_path / "none"), str(tmp_path / "out"))
    api.check_places(str(source), str(tmp_path / "out"), str(tmp_path / "key"))


def test_command_line(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    tree(at("in"), {"a.txt": b"one " * 900})
    assert cli.main(["identity", "create", at("publisher")]) == 0 and cli.main(["identity", "export", at("publisher"), at("reader")]) == 0
    assert cli.main(["--keys", at("publisher"), "pack", at("in"), at("out"), "--zstd-level", "5", "--segment-mib", "2", "--dev-cache"]) == 0
    assert cli.main(["--keys", at("reader"), "verify", at("out"), "--at-least", "1"]) == 0
    assert cli.main(["--keys", at("reader"), "verify", at("out"), "--at-least", "2"]) == 1
    assert cli.main(["--keys", at("reader"), "pack", at("in"), at("out")]) == 1
    assert cli.main(["--keys", at("publisher"), "pack", at("in"), at("in/out")]) == 1
    assert cli.main(["--keys", at("reader"), "plan", at("in"), at("out")]) == 0 and '"Unchanged"' in capsys.readouterr().out
    os.makedirs(at("back"))
    assert cli.main(["--keys", at("reader"), "extract", at("out"), at("back")]) == 0 and os.path.getsize(at("back/a.txt")) == 3600
