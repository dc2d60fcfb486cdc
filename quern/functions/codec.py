"""Digests, compression and sealing of blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import IntegrityError

NONCE_BYTES, TAG_BYTES = 12, 16


def chunk_id(content: Column) -> Column:
    return F.sha2(content, 256)


def short_digest(hex_digest: Column) -> Column:
    """The first 16 bytes of a hex digest."""
    return F.substring(hex_digest, 1, 32)


def path_hash(path: Column, key: str) -> Column:
    """64 bits of a keyed digest as an unsigned decimal."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key), path), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def segment_file(segment_id: Column, suffix: str = "seg") -> Column:
    return F.concat(F.lower(segment_id), F.lit("." + suffix))


# The codecs are row functions whose rows come pickled, some hundred at a time: an Arrow batch has up to 10,000
# contents or 64 MiB, of which a worker would hold several copies at once.


def zstd_column(level: int = 3):
    """A column function: content compressed with Zstandard; one compressor for each task."""
    own: list = []

    @F.udf("binary", useArrow=False)
    def compressed(b: bytes | None) -> bytes | None:
        import zstandard

        if not own:
            own.append(zstandard.ZstdCompressor(level=level))
        return None if b is None else own[0].compress(b)

    return compressed


def unzstd_column():
    """A column function of (encoded, plain_len): the content, which must have just that length. Null where both
    are null."""
    own: list = []

    @F.udf("binary", useArrow=False)
    def plain(encoded: bytes | None, n: int | None) -> bytes | None:
        import zstandard

        if encoded is None and n is None:
            return None
        if encoded is None or n is None:
            raise IntegrityError("block has no content or no length")
        if not own:
            own.append(zstandard.ZstdDecompressor())
        try:
            out = own[0].decompress(encoded, max_output_size=max(1, n))
        except zstandard.ZstdError as e:
            raise IntegrityError(f"block does not decode: {e}") from e
        if len(out) != n:
            raise IntegrityError(f"block has {len(out)} bytes, not {n}")
        return out

    return plain


def seal(content: Column, key: Column, nonce: Column, context: Column) -> Column:
    """AES-GCM: ciphertext and tag, without the nonce that Spark puts in front."""
    return F.substring(F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, context), NONCE_BYTES + 1, 2**31 - 1)


def unseal(sealed: Column, key: Column, nonce: Column, context: Column) -> Column:
    return F.aes_decrypt(F.concat(nonce, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), context)


def unseal_or_null(sealed: Column, key: Column, nonce: Column, context: Column) -> Column:
    """The content, or null where it was altered or the key is another."""
    return F.try_aes_decrypt(F.concat(nonce, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), context)


def checked(content: Column) -> Column:
    """Content that is not sealed: followed by as many bytes of its digest as a seal has."""
    return F.concat(content, F.unhex(F.substring(F.sha2(content, 256), 1, 2 * TAG_BYTES)))


def unchecked_or_null(stored: Column) -> Column:
    """What checked was given, or null where it was altered."""
    n = F.octet_length(stored) - TAG_BYTES
    body = F.substring(stored, F.lit(1), F.greatest(n, F.lit(0)))
    return F.when((n >= 0) & (checked(body) == stored), body)


def block_context(segment_id: Column, ordinal: Column, codec: Column, plain_len: Column) -> Column:
    """What a block's seal also covers: where the block belongs and how it is to be read."""
    return F.concat_ws("|", F.lit("block"), segment_id, ordinal.cast("string"), codec, plain_len.cast("string"))


def page_context(release: Column, kind: Column, page_id: Column) -> Column:
    return F.concat_ws("|", F.lit("page"), release.cast("string"), kind, page_id.cast("string"))


def catalog_context(project: Column, release: Column) -> Column:
    return F.concat_ws("|", F.lit("catalog"), project, release.cast("string"))


def nonce_prefix(segment_id: Column) -> Column:
    """Eight bytes for all blocks of a segment, whose key is its own."""
    return F.unhex(F.substring(F.sha2(segment_id, 256), 1, 2 * (NONCE_BYTES - 4)))


def nonce(prefix: Column, ordinal: Column) -> Column:
    """Eight bytes of prefix, then the ordinal, four bytes, least first."""
    h = F.lpad(F.hex(ordinal), 8, "0")
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.concat(prefix, F.unhex(le))
