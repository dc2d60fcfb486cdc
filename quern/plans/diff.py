"""What changed between the sources and the last release."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import StalePlan
from quern.functions.classify import access as access_of
from quern.functions.classify import availability as availability_of
from quern.schema import ADDED, MODIFIED, REMOVED, UNCHANGED, Limits


def content_keys(assets: DataFrame) -> DataFrame:
    """(path, len, digest) of assets with content: hashed before the join, so that no content is shuffled."""
    return assets.select("path", F.octet_length("content").cast("bigint").alias("len"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def diff(sources: DataFrame, released: DataFrame, limits: Limits, deferred: Sequence[str] = (), released_access: bool = False) -> DataFrame:
    """Rows (path, change, source_len, released_len, access, availability), one for each path of either side.

    sources, released: (path, len, digest). Content is equal if lengths and digests are. A removed
    path has the access class of the release (a column access of released, if released_access, else
    computed alike) and the availability of the present prefixes.
    """
    s = sources.select("path", F.col("len").alias("source_len"), F.col("digest").alias("__s"))
    old_access = F.col("access") if released_access else access_of(F.col("path"), F.col("len"), limits)
    r = released.select("path", F.col("len").alias("released_len"), F.col("digest").alias("__r"), old_access.alias("__access"))
    change = (
        F.when(F.col("released_len").isNull(), F.lit(ADDED))
        .when(F.col("source_len").isNull(), F.lit(REMOVED))
        .when((F.col("source_len") == F.col("released_len")) & (F.col("__s") == F.col("__r")), F.lit(UNCHANGED))
        .otherwise(F.lit(MODIFIED))
    )
    return s.join(r, "path", "full_outer").select(
        "path",
        change.alias("change"),
        "source_len",
        "released_len",
        F.when(F.col("source_len").isNull(), F.col("__access")).otherwise(access_of(F.col("path"), F.col("source_len"), limits)).alias("access"),
        availability_of(F.col("path"), deferred).alias("availability"),
    )


def totals(plan: DataFrame) -> DataFrame:
    """One row (source_bytes, changed_source_bytes, sources, changes)."""
    moved = F.col("change").isin(ADDED, MODIFIED)
    return plan.agg(
        F.coalesce(F.sum("source_len"), F.lit(0)).alias("source_bytes"),
        F.coalesce(F.sum(F.when(moved, F.col("source_len"))), F.lit(0)).alias("changed_source_bytes"),
        F.count_if(F.col("source_len").isNotNull()).alias("sources"),
        F.count_if(F.col("change") != UNCHANGED).alias("changes"),
    )


def shown(plan: DataFrame, query: str = "", with_unchanged: bool = False) -> DataFrame:
    """The rows that a view of the plan shows, with the size to show: paths that hold the query, case apart."""
    hit = F.contains(F.lower("path"), F.lit(query.lower()))
    seen = plan.where(hit & (F.lit(with_unchanged) | (F.col("change") != UNCHANGED)))
    return seen.withColumn("shown_len", F.coalesce("source_len", "released_len", F.lit(0)))


def stale(sources: DataFrame, released: DataFrame) -> DataFrame:
    """(path, reason) of sources that the release just made does not match in path and length."""
    s, r = sources.select("path", F.col("len").alias("s")), released.select("path", F.col("len").alias("r"))
    reason = F.when(F.col("r").isNull(), F.lit("added")).when(F.col("s").isNull(), F.lit("removed")).otherwise(F.lit("resized"))
    return s.join(r, "path", "full_outer").where(~F.col("s").eqNullSafe(F.col("r"))).select("path", reason.alias("reason"))


def check_fresh(sources: DataFrame, released: DataFrame) -> None:
    """Raises StalePlan with the first stale path."""
    first = stale(sources, released).orderBy("path").limit(1).collect()
    if first:
        raise StalePlan(f"{first[0].reason} since the release: {first[0].path}")
