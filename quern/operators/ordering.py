"""Running totals over a whole table without a single-partition window.

The table is range-partitioned by its order and settled; each partition's totals, one row for
each, are summed on their own and added to windows within the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import written


def with_running(df: DataFrame, order: Sequence[str | Column], totals: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of the column over the rows before, in the order, which must be strict."""
    values = {f"__v{i}": c for i, c in enumerate(totals.values())}
    ranged = written(df.withColumns(values).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*(F.sum(v).alias(v) for v in values))
    # one row for each partition: a window without partitions is no bottleneck here
    starts = sums.select("__part", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__s{i}") for i, v in enumerate(values)))
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), "__part")
    out = joined.withColumns({n: F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__s{i}") for i, (n, v) in enumerate(zip(totals, values))})
    return out.drop("__part", *values, *(f"__s{i}" for i in range(len(values))))


def with_index(df: DataFrame, order: Sequence[str | Column], name: str = "index") -> DataFrame:
    """df with the number of each row in the order, from 0."""
    return with_running(df, order, {name: F.lit(1).cast("bigint")})
