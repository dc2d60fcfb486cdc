"""Keys of a publisher and of its readers: made, split, kept in private files, and used to sign.

All of this is driver-side. Signatures are Ed25519, by the JVM that Spark runs on.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from quern.errors import IntegrityError, InvalidFormat
from quern.sources.files import KEY_MAGIC


def derive(master: bytes, purpose: str, *context: bytes) -> bytes:
    """A key of 32 bytes for one purpose and context, by HKDF with SHA-256."""
    extracted = hmac.new(b"quern/1", master, hashlib.sha256).digest()
    info = purpose.encode() + b"".join(len(c).to_bytes(4, "little") + c for c in context)
    return hmac.new(extracted, info + b"\x01", hashlib.sha256).digest()


def split(key: bytes, shares: int = 2) -> list[bytes]:
    """Shares whose exclusive or is the key; any fewer tell nothing of it."""
    parts = [secrets.token_bytes(len(key)) for _ in range(shares - 1)]
    return [*parts, join([key, *parts])]


def join(shares: list[bytes]) -> bytes:
    if len({len(s) for s in shares}) != 1:
        raise InvalidFormat("shares differ in length")
    out = bytes(len(shares[0]))
    for s in shares:
        out = bytes(a ^ b for a, b in zip(out, s))
    return out


class KeySchedule:
    """The keys of a project, each for one use, derived from its root key."""

    def __init__(self, root: bytes, project: str) -> None:
        self._master = derive(root, "master", project.encode())

    def segment(self, segment_id: str) -> bytes:
        return derive(self._master, "segment", segment_id.encode())

    def snapshot(self, sequence: int) -> bytes:
        return derive(self._master, "snapshot", str(sequence).encode())

    def paths(self) -> bytes:
        return derive(self._master, "paths")

    def table(self, spark: SparkSession, segment_ids: list[str]) -> DataFrame:
        """(segment_id, key) of segments; as rows, so that no key stands in a query plan."""
        rows = [(i, bytearray(self.segment(i))) for i in segment_ids]
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "segment_id string, key binary")


@dataclass(frozen=True)
class ReaderKeys:
    """What a reader needs: the project, the root key's shares and the publisher's public key, in hex."""

    project: str
    shares: tuple[str, ...]
    public: str

    def root(self) -> bytes:
        return join([bytes.fromhex(s) for s in self.shares])

    def schedule(self) -> KeySchedule:
        return KeySchedule(self.root(), self.project)


@dataclass(frozen=True)
class Publisher:
    project: str
    root_key: str
    private: str
    public: str

    @staticmethod
    def create(spark: SparkSession) -> "Publisher":
        security = spark._jvm.java.security
        pair, factory = security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair(), security.KeyFactory.getInstance("Ed25519")
        # the keys' own classes are closed to reflection; their specs are not
        form = lambda name: spark._jvm.java.lang.Class.forName(f"java.security.spec.{name}")
        encoded = lambda key, name: bytes(factory.getKeySpec(key, form(name)).getEncoded()).hex()
        return Publisher(secrets.token_hex(16), secrets.token_hex(32), encoded(pair.getPrivate(), "PKCS8EncodedKeySpec"), encoded(pair.getPublic(), "X509EncodedKeySpec"))

    def schedule(self) -> KeySchedule:
        return KeySchedule(bytes.fromhex(self.root_key), self.project)

    def reader(self) -> ReaderKeys:
        return ReaderKeys(self.project, tuple(s.hex() for s in split(bytes.fromhex(self.root_key))), self.public)

    def sign(self, spark: SparkSession, message: bytes) -> bytes:
        security = spark._jvm.java.security
        spec = security.spec.PKCS8EncodedKeySpec(bytearray(bytes.fromhex(self.private)))
        signer = security.Signature.getInstance("Ed25519")
        signer.initSign(security.KeyFactory.getInstance("Ed25519").generatePrivate(spec))
        signer.update(bytearray(message))
        return bytes(signer.sign())


def verify(spark: SparkSession, public: str, message: bytes, signature: bytes) -> None:
    """Raises IntegrityError if the signature is not the key's for the message."""
    security = spark._jvm.java.security
    checker = security.Signature.getInstance("Ed25519")
    spec = security.spec.X509EncodedKeySpec(bytearray(bytes.fromhex(public)))
    checker.initVerify(security.KeyFactory.getInstance("Ed25519").generatePublic(spec))
    checker.update(bytearray(message))
    if len(signature) != 64 or not checker.verify(bytearray(signature)):
        raise IntegrityError("signature")


def key_id(public: str) -> str:
    return hashlib.sha256(bytes.fromhex(public)).hexdigest()[:32]


def save(keys: Publisher | ReaderKeys, path: str) -> None:
    """A file that only its owner can read; never over another."""
    body = json.dumps({"kind": type(keys).__name__} | asdict(keys)).encode()
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
        f.write(KEY_MAGIC + hashlib.sha256(body).digest() + body)


def load(path: str) -> Publisher | ReaderKeys:
    with open(path, "rb") as f:
        magic, digest, body = f.read(len(KEY_MAGIC)), f.read(32), f.read()
    if magic != KEY_MAGIC or hashlib.sha256(body).digest() != digest:
        raise InvalidFormat("key file")
    fields = json.loads(body)
    kind = {"Publisher": Publisher, "ReaderKeys": ReaderKeys}[fields.pop("kind")]
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
