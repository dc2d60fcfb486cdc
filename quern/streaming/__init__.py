"""Sources that arrive while a release is being prepared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.classify import with_classes
from quern.schema import Limits


def incoming(spark: SparkSession, root: str, limits: Limits, deferred: Sequence[str] = ()) -> DataFrame:
    """A stream of files that appear below root, classified; contents are hashed and not carried on."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), F.col("length").alias("len"), F.sha2("content", 256).alias("digest"))
    return with_classes(rows, limits, deferred)
