"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a text's profile bundles (adds) the vectors of its
n-grams. A language's prototype bundles the unit profiles of labelled texts, and a text gets the
language of the prototype nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, normal, prepare, quoted

DIMENSIONS = 512
N = 3
#: Letters are taken modulo this many vectors; the space between words is letter 0.
LETTERS = 48
SEED = 20240517
#: Prototypes are fitted on at most so many labelled texts.
TRAIN_ROWS = 8_000
NONE = "und"

_LETTER = np.array([0 if i == SPACE else 1 + i % (LETTERS - 1) for i in range(256)], dtype=np.int32)
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def gram_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """One row for each n-gram of letters, in the order of gram numbers."""
    if (dimensions, seed) not in _VECTORS:
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, dimensions))
        grams = np.ones((1, dimensions), dtype=np.int8)
        for place in range(N):
            rolled = np.roll(letters, N - 1 - place, axis=1)
            grams = (grams[:, None, :] * rolled[None, :, :]).reshape(-1, dimensions)
        _VECTORS[dimensions, seed] = grams
    return _VECTORS[dimensions, seed]


def grams(p: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams of a text's normal form, with a space at either end."""
    padded = np.zeros(len(p) + 2, dtype=np.int32)
    padded[1:-1] = _LETTER[p] if p.dtype == np.uint8 else np.where(p == SPACE, 0, 1 + p % np.uint32(LETTERS - 1))
    return (padded[:-2] * LETTERS + padded[1:-1]) * LETTERS + padded[2:]


def profile(text: str, vectors: np.ndarray) -> np.ndarray | None:
    """The bundled vector of a text, or None if it has no letters."""
    p = normal(text)
    if not len(p):
        return None
    g = grams(p)
    at, n = np.unique(g, return_counts=True)
    return n.astype(np.float32) @ vectors[at].astype(np.float32)


def fit_prototypes(docs: DataFrame, *, most: int = TRAIN_ROWS, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages of at most `most` labelled rows, those of the least hashes of
    (id, language, text).

    Repeated rows count once; rows of one id and different texts, and of null ids, count each.
    Hashes alone are sorted; the rows up to the last of them are then read again.
    """
    prepare(docs.sparkSession)
    labelled = docs.select(quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    hashed = labelled.select("lang", "text", F.xxhash64("id", "lang", "text").alias("h"))
    last = hashed.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    train = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).select("lang", "text") if last is not None else hashed.limit(0).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        vectors = gram_vectors(dimensions)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, t in enumerate(batch.column(1)):
                v = profile(t.as_py(), vectors)
                if v is not None and v.any():
                    sums[langs[i]] = sums.get(langs[i], np.zeros(dimensions)) + v / np.linalg.norm(v)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    total: dict[str, np.ndarray] = {}
    for row in sorted(train.mapInArrow(bundle, "lang string, v array<double>").collect(), key=lambda r: (r.lang, r.v)):
        total[row.lang] = total.get(row.lang, np.zeros(dimensions)) + np.array(row.v)
    return {k: v / np.linalg.norm(v) for k, v in sorted(total.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", id_col: str = "doc_id", dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows (doc_id, language, cosine, margin), one for each row of docs.

    margin: how far the next language is behind. A null text, one without letters, and any text
    where no language was learned get language "und" and 0 for both figures; of cosines
    equal to six places the language first by name wins. Null ids and repeated rows each give their row; other
    columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, dimensions), dtype=np.float32)
    in_type = docs.select(quoted(id_col).alias("doc_id")).schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = gram_vectors(dimensions)
        for batch in batches:
            language, cosine, margin = [NONE] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(1)):
                v = profile(t.as_py(), vectors) if names and t.is_valid else None
                if v is None or not v.any():
                    continue
                near = (matrix @ (v / np.linalg.norm(v))).astype(np.float64).round(6)
                k = int(near.argmax())
                language[i], cosine[i] = names[k], near[k]
                margin[i] = near[k] - max(np.delete(near, k), default=near[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language), pa.array(cosine), pa.array(margin.round(6))], names=["doc_id", "language", "cosine", "margin"])

    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).mapInArrow(run, f"doc_id {in_type.simpleString()}, language string, cosine double, margin double")


def identify_languages(docs: DataFrame, *, most: int = TRAIN_ROWS) -> DataFrame:
    """Learn the languages from the table's own labels and identify every text; see identify."""
    return identify(docs, fit_prototypes(docs, most=most))
