"""Assets, two releases, blocks and requests derived from the driver's tables, in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.classify import segment_target, stored_len, with_classes
from quern.operators import chunk, dedup, segments, stats
from quern.plans.pack import Release
from quern.schema import KIB, RAW, SMALL
from quern.session import written

DEFERRED = ("dlc",)
EXTENSIONS = ("txt", "json", "webp", "opus", "mp4", "wav", "png", "bin")
BLOCK = KIB


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    folder = F.when(F.col("doc_id") % 5 == 0, "bgm/").when(F.col("doc_id") % 9 == 0, "dlc/").otherwise("")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return F.concat(folder, "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("."), ext)


def _assets(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select("doc_id", _path().alias("path"), text.cast("binary").alias("content"), F.octet_length(text).cast("bigint").alias("len"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as (doc_id, path, content, len)."""
    return _assets(read(spark, sf_dir, "documents"), F.col("text"))


def new_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).where("doc_id % 13 <> 0")


def old_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return _assets(read(spark, sf_dir, "documents").where("doc_id % 11 <> 0"), text)


def classified(df: DataFrame) -> DataFrame:
    return with_classes(df, SMALL, DEFERRED)


def blocks(df: DataFrame) -> DataFrame:
    """Fixed blocks of BLOCK bytes of classified assets, stored raw."""
    columns = ["path", "content", "access", "availability", "compression"]
    out = chunk.fixed_chunks(classified(df).select(*columns), F.lit(BLOCK).cast("bigint"))
    return out.withColumn("codec", F.lit(RAW)).withColumn("stored_len", stored_len(F.col("plain_len")))


def stored(df: DataFrame) -> DataFrame:
    """The first block of each kind, with its place in a segment."""
    return _stored(_marked(df))


def _marked(df: DataFrame) -> DataFrame:
    """blocks of df with is_first. They are settled before they are compared, so that contents are hashed once."""
    return written(dedup.first_in_release(written(blocks(df))))


def _stored(marked: DataFrame) -> DataFrame:
    first = marked.where("is_first").withColumn("target", segment_target(F.col("access"), SMALL))
    return segments.rotate(first).join(first.select("path", "block_no", "chunk_id", "plain_len", "codec"), ["path", "block_no"])


def segment_name() -> Column:
    return F.concat_ws("-", "availability", "access", F.col("segment_no").cast("string"))


def placed_blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, segments) of a release of df, segments named by class and number. Contents are hashed once."""
    return _placed(_marked(df))


def _placed(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = written(_stored(marked).withColumn("segment_id", segment_name()))
    place = ["segment_id", "segment_block_ordinal", "physical_offset"]
    refs = marked.drop("is_first").join(first.select(*dedup.WITHIN, *place), list(dedup.WITHIN))
    table = segments.segment_table(first).withColumn("segment_id", segment_name())
    return refs, table


def bodies(df: DataFrame) -> DataFrame:
    """Blocks of assets with their content."""
    piece = F.substring("whole", (F.col("logical_offset") + 1).cast("int"), F.col("plain_len").cast("int"))
    return blocks(df).join(df.select("path", "doc_id", F.col("content").alias("whole")), "path").withColumn("content", piece).drop("whole")


def release(df: DataFrame) -> Release:
    """A release of df, of sequence 1."""
    return marked_release(df)[0]


def marked_release(df: DataFrame) -> tuple[Release, DataFrame]:
    """release, and its blocks with is_first. All tables and the fingerprint come from one pass that hashes contents."""
    marked = _marked(df)
    refs, table = map(written, _placed(marked))
    n = refs.groupBy("path").agg(F.count("*").alias("block_count"))
    listed = written(classified(df).drop("content", "doc_id"))
    counted = listed.join(n, "path", "left").withColumn("block_count", F.coalesce("block_count", F.lit(0).cast("bigint")))
    return Release(1, counted, refs, table.drop("segment_no"), stats.fingerprint(listed, marked).first().source_fingerprint), marked


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of assets asked for, from the events: (request_id, path, offset, n)."""
    a = assets(spark, sf_dir)
    n_docs = a.agg(F.max("doc_id") + 1).first()[0] or 1
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") * 7919 % n_docs).alias("doc_id"), (F.col("event_id") * 104729 % 3000).alias("offset"), (F.col("user_id") % 2000).alias("n"))
    return ev.join(a.select("doc_id", "path"), "doc_id").select("request_id", "path", "offset", "n")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of sessions to assets as whole blocks, in event order: each user goes back to three
    documents, anywhere in the corpus."""
    a = classified(assets(spark, sf_dir))
    n_docs = a.agg(F.max("doc_id") + 1).first()[0] or 1
    ev = read(spark, sf_dir, "events")
    seq = F.struct("ts", "event_id")
    e = ev.select(F.col("user_id").alias("session"), seq.alias("seq"), ((F.col("user_id") * 7919 + F.col("event_id") % 3 * 101) % n_docs).alias("doc_id"), (F.col("event_id") % 10 == 0).alias("prefetch"))
    return e.join(a.select("doc_id", F.col("path").alias("block"), F.col("len").alias("size"), "access"), "doc_id").drop("doc_id")
