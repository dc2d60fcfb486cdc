"""Statistics of a text that quality rules and the quality model read, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import quoted, text_of

FEATURES = (
    "words",
    "mean_word_chars",
    "symbol_ratio",
    "bang_per_word",
    "pipe_per_word",
    "upper_ratio",
    "digit_ratio",
    "stop_per_word",
    "variety",
    "repeat_ratio",
    "lines_per_word",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def text_features(docs: DataFrame, keep: list[Column], text_col: str = "text", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The columns of keep and the features, doubles without nulls; all 0 for a null or empty text.

    A text is split once, and only the counts that the features need are made. They go through a
    generator, so that a filter on them stays above it and makes none of them twice. variety is the
    logarithm of the distinct words over that of all words, which, unlike their ratio, hardly
    depends on a text's length.
    """
    pieces = docs.select(*keep, text_of(text_col).alias("__text"), F.split(text_of(text_col), "[ \\t\\n\\r]+").alias("__parts"))
    kept, t, parts = pieces.columns[:-2], F.col("__text"), F.col("__parts")
    plain = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c)))).cast("double")
    blank_ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    counts = {
        "chars": F.length(t).cast("double"),
        "words": (F.size(parts) - blank_ends).cast("double"),
        "symbols": _count(t, "[#$%&*+=<>^~@\\\\{}]"),
        "bangs": plain("!"),
        "pipes": plain("|"),
        "upper": _count(t, "\\p{Lu}"),
        "digits": _count(t, "[0-9]"),
        "stops": plain("."),
        "lines": plain("\n"),
        "unique": F.size(F.array_distinct(parts)).cast("double"),
        "repeats": _count(t, "(?:^|\\s)(\\S+)(?=\\s+\\1(?:\\s|$))"),
    }
    by = lambda x, y: F.when(n[y] > 0, n[x] / n[y]).otherwise(F.lit(0.0))
    n = {name: F.col("__counts")[name] for name in counts}
    made = {
        "words": n["words"],
        "mean_word_chars": by("chars", "words"),
        "symbol_ratio": by("symbols", "chars"),
        "bang_per_word": by("bangs", "words"),
        "pipe_per_word": by("pipes", "words"),
        "upper_ratio": by("upper", "chars"),
        "digit_ratio": by("digits", "chars"),
        "stop_per_word": by("stops", "words"),
        "variety": F.when(n["words"] > 1, F.least(F.log(n["unique"]) / F.log(n["words"]), F.lit(1.0))).otherwise(F.least(n["words"], F.lit(1.0))),
        "repeat_ratio": by("repeats", "words"),
        "lines_per_word": by("lines", "words"),
    }
    needed = {c for f in features for c in _NEEDS[f]}
    counted = pieces.select(*map(quoted, kept), F.explode(F.array(F.struct(*(c.alias(name) for name, c in counts.items() if name in needed)))).alias("__counts")) if needed else pieces
    return counted.select(*map(quoted, kept), *(made[f].alias(f) for f in features))


_NEEDS = {
    "words": ("words",),
    "mean_word_chars": ("chars", "words"),
    "symbol_ratio": ("symbols", "chars"),
    "bang_per_word": ("bangs", "words"),
    "pipe_per_word": ("pipes", "words"),
    "upper_ratio": ("upper", "chars"),
    "digit_ratio": ("digits", "chars"),
    "stop_per_word": ("stops", "words"),
    "variety": ("unique", "words"),
    "repeat_ratio": ("repeats", "words"),
    "lines_per_word": ("lines", "words"),
}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, label, features) of at most `most` labelled documents, those of the least id hashes.

    Labels that are null or not 0 or 1 are left out, and of repeated labels of a document the
    least counts; of rows of one id the one of least features. `most` bounds what is broadcast and
    the rows of the result.
    """
    named = labels.select(quoted(id_col).alias("__id"), quoted(label).alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull())
    chosen = named.groupBy("__id").agg(F.min("__label").cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    joined = docs.select(quoted(id_col).alias("__doc"), quoted(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    made = text_features(joined, [F.col("__doc").alias("doc"), F.col("__label").alias("label")])
    return made.groupBy("doc").agg(F.min(F.struct("label", *FEATURES)).alias("x")).select("doc", "x.*")
