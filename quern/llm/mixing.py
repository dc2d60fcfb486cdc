"""Mixing sources to target weights.

Tokens are summed per source; a source's rate is its share of the token budget over its
tokens. Each document is emitted floor(rate) times, and once more when a number in [0, 1)
drawn from a hash of the seed and its id lies under the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fits, free_name, prepare, quoted, text_of, token_count, written

#: Without given weights a source weighs its tokens to this power, so that large sources give way.
SMOOTHING = 0.7
SEED = "mix-1"
#: A table of rates with more sources than this is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 200_000


def draw(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_tokens: int | None = None,
    *,
    smoothing: float = SMOOTHING,
    default_weight: float = 0.0,
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (source, tokens, rate), one per source, the null source included.

    A source's weight is weights[source], default_weight where it is missing there, or
    tokens ** smoothing where no weights are given; the budget is all tokens of the table
    unless given. A source without tokens, or of weight 0, has rate 0. Names are compared as
    strings, and None names the null source. Weights are joined as a table, however many there are.
    """
    tokens = docs.groupBy(quoted(source_col).alias("source")).agg(F.sum(token_count(text_of(text_col))).alias("tokens"))
    if weights is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(float(smoothing)))
    else:
        rows = [(None if name is None else str(name), float(value)) for name, value in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "__name string, __given double")
        given = F.broadcast(given) if len(rows) <= BROADCAST_SOURCES else given
        tokens = tokens.join(given, F.col("source").cast("string").eqNullSafe(F.col("__name")), "left")
        weight = F.coalesce("__given", F.lit(float(default_weight)))
    weighed = written(tokens.select("source", "tokens", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0)).alias("weight")))
    totals = weighed.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    budget, total = budget_tokens if budget_tokens is not None else totals["t"] or 0, totals["w"] or 0.0
    rate = F.when((F.col("tokens") > 0) & F.lit(total > 0), F.col("weight") / F.lit(total or 1.0) * F.lit(float(budget)) / F.col("tokens"))
    return weighed.select("source", "tokens", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_tokens: int | None = None,
    *,
    seed: str = SEED,
    smoothing: float = SMOOTHING,
    default_weight: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy_col: str | None = "copy",
) -> DataFrame:
    """The documents of docs, repeated to the rates of their sources.

    All columns of docs stay; copy_col (None: left out) numbers a row's copies from 0, with
    underscores added if docs has such a column. A null text has no tokens; a null source is a
    source of its own; rows of one id, null too, draw alike; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    rates = source_rates(docs, weights, budget_tokens, smoothing=smoothing, default_weight=default_weight, text_col=text_col, source_col=source_col)
    rate, key, n = (free_name(docs.columns, x) for x in ("__rate", "__source", "__copies"))
    rates = rates.select(F.col("source").alias(key), F.col("rate").alias(rate))
    if fits(rates, BROADCAST_SOURCES):
        rates = F.broadcast(rates)
    whole = F.floor(quoted(rate))
    extra = (draw(quoted(id_col), seed) < quoted(rate) - whole).cast("bigint")
    counted = docs.join(rates, quoted(source_col).eqNullSafe(quoted(key)), "inner").withColumn(n, (whole + extra).cast("int")).where(quoted(n) > 0)
    copies = F.posexplode(F.array_repeat(F.lit(0), quoted(n)))
    at, unused = free_name(docs.columns, copy_col or "__copy"), free_name(docs.columns, "__unused")
    out = counted.select(*map(quoted, docs.columns), copies.alias(at, unused))
    return out.drop(unused) if copy_col else out.select(*map(quoted, docs.columns))
