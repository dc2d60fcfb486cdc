import stat

import pytest

from quern import errors
from quern.sources import identity as I


def test_keys(spark, tmp_path):
    keys = I.Publisher.create(spark)
    reader = keys.reader()
    assert reader.root().hex() == keys.root_key and reader.shares[0] != keys.root_key
    for k, name in ((keys, "p.key"), (reader, "r.key")):
        at = str(tmp_path / name)
        I.save(k, at)
        assert I.load(at) == k and stat.S_IMODE((tmp_path / name).stat().st_mode) == 0o600
        with pytest.raises(FileExistsError):
            I.save(k, at)
    damaged = (tmp_path / "r.key").read_bytes()[:-1] + b"!"
    (tmp_path / "bad.key").write_bytes(damaged)
    with pytest.raises(errors.InvalidFormat):
        I.load(str(tmp_path / "bad.key"))


def test_signatures(spark):
    keys = I.Publisher.create(spark)
    signature = keys.sign(spark, b"release 1")
    assert len(signature) == 64
    I.verify(spark, keys.public, b"release 1", signature)
    with pytest.raises(errors.IntegrityError):
        I.verify(spark, keys.public, b"release 2", signature)
    with pytest.raises(errors.IntegrityError):
        I.verify(spark, I.Publisher.create(spark).public, b"release 1", signature)
    assert len(I.key_id(keys.public)) == 32


def test_derived_keys_and_shares():
    assert len({I.derive(b"m" * 32, p, c) for p in ("segment", "path") for c in (b"1", b"2")}) == 4
    parts = I.split(b"k" * 32, 3)
    assert I.join(parts) == b"k" * 32 and I.join(parts[:2]) != b"k" * 32
    with pytest.raises(errors.InvalidFormat):
        I.join([b"a", b"bc"])
