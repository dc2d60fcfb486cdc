"""How an asset is stored and read, from its path and length. Pure column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.schema import AUTO, CONTENT_DEFINED, DEFERRED, FIXED, HOT, NORMAL, RAW, REQUIRED, SEAL, STREAMING, TRANSIENT, ZSTD, Limits

AUDIO = ("flac", "mp3", "ogg", "opus", "wav")
VIDEO = ("m4v", "mkv", "mov", "mp4", "webm")
PACKED = ("avif", "flac", "jpeg", "jpg", "m4v", "mkv", "mov", "mp3", "mp4", "ogg", "opus", "png", "webm", "webp")
MUSIC_FOLDERS = ("bgm", "music")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of the 26 letters alone."""
    return F.translate(c, _UPPER, _LOWER)


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path, folders included; empty without a dot."""
    return ascii_lower(F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise(F.lit("")))


def is_audio(path: Column) -> Column:
    return extension(path).isin(*AUDIO)


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO)


def is_packed(path: Column) -> Column:
    return extension(path).isin(*PACKED)


def compression(path: Column) -> Column:
    return F.when(is_packed(path), F.lit(RAW)).otherwise(F.lit(AUTO))


def in_music_folder(path: Column) -> Column:
    return F.exists(F.split(ascii_lower(path), "/"), lambda part: part.isin(*MUSIC_FOLDERS))


def access(path: Column, length: Column, limits: Limits) -> Column:
    """The media tests come before the size test."""
    return (
        F.when(is_video(path), F.lit(STREAMING))
        .when(is_audio(path), F.when(in_music_folder(path) | (length > limits.short_audio), F.lit(STREAMING)).otherwise(F.lit(TRANSIENT)))
        .when(length <= limits.hot_file, F.lit(HOT))
        .otherwise(F.lit(NORMAL))
    )


def layout(path: Column, length: Column, limits: Limits) -> Column:
    chunked = ~(is_video(path) | is_audio(path)) & (length > limits.hot_file) & (length <= limits.content_defined)
    return F.when(chunked, F.lit(CONTENT_DEFINED)).otherwise(F.lit(FIXED))


def fixed_block_len(path: Column, length: Column, limits: Limits) -> Column:
    """Bytes of a fixed block; 0 where blocks are cut by content."""
    return (
        F.when(is_video(path) | is_audio(path), F.lit(limits.stream_block).cast("bigint"))
        .when(length <= limits.hot_file, F.greatest(length, F.lit(1)).cast("bigint"))
        .when(length <= limits.content_defined, F.lit(0).cast("bigint"))
        .otherwise(F.lit(limits.bulk_block).cast("bigint"))
    )


def availability(path: Column, deferred: Sequence[str]) -> Column:
    """Deferred at a given prefix or below it, else required."""
    hit = F.lit(False)
    for prefix in deferred:
        hit = hit | (path == prefix) | path.startswith(prefix + "/")
    return F.when(hit, F.lit(DEFERRED)).otherwise(F.lit(REQUIRED))


def parse_prefixes(text: Column) -> Column:
    """Prefixes of a list parted by commas or line ends; blanks around them and empty ones go."""
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def segment_target(access_: Column, limits: Limits, configured: int | None = None) -> Column:
    most = configured if configured is not None else limits.segment
    own = F.when(access_ == HOT, limits.hot_segment).when(access_ == NORMAL, limits.normal_segment).when(access_ == TRANSIENT, limits.transient_segment).otherwise(most)
    return F.least(own, F.lit(most)).cast("bigint")


def accepts(policy: Column, codec: Column) -> Column:
    return (policy == AUTO) | (codec == RAW)


def stored_len(encoded_len: Column) -> Column:
    return (encoded_len + SEAL).cast("bigint")


def encoded_len_valid(codec: Column, stored: Column, plain: Column) -> Column:
    return F.when(codec == RAW, stored == plain + SEAL).when(codec == ZSTD, (stored >= SEAL) & (stored < plain + SEAL)).otherwise(F.lit(False))


def human_size(n: Column) -> Column:
    """A length with its unit, to one decimal. Rounded from the exact quotient, ties to the even digit, as printf
    does; format_string would take ties up and write out a null. Beyond 2^53 the length counts as a double."""
    m = n.cast("double").cast("bigint")

    def size(bits: int, name: str) -> Column:
        rest = m.bitwiseAND((1 << bits) - 1) * 10
        tenths, over = F.shiftright(m, bits) * 10 + F.shiftright(rest, bits), rest.bitwiseAND((1 << bits) - 1)
        up = (over > 1 << (bits - 1)) | ((over == 1 << (bits - 1)) & (tenths % 2 == 1))
        tenths = tenths + up.cast("bigint")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" " + name))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, size(10, "KiB")).when(n < 1 << 30, size(20, "MiB")).otherwise(size(30, "GiB"))


def with_classes(assets: DataFrame, limits: Limits, deferred: Sequence[str] = ()) -> DataFrame:
    """assets (path, len, ...) with access, layout, fixed_block_len, compression and availability."""
    p, n = F.col("path"), F.col("len")
    return assets.withColumns({
        "access": access(p, n, limits),
        "layout": layout(p, n, limits),
        "fixed_block_len": fixed_block_len(p, n, limits),
        "compression": compression(p),
        "availability": availability(p, deferred),
    })
