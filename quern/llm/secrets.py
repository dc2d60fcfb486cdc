"""Secret scan by character Markov models.

Two models of character pairs, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a token whose log-likelihood ratio, for each character, lies
above the threshold chosen on the samples is a finding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import prepare, quoted

#: Identifiers are made of so many words of the corpus, those that most documents hold, and of words
#: that programs use; so many samples of either kind train the models.
TRAIN_WORDS = 4_000
TRAIN_SAMPLES = 6_000
SEED = 11
#: Findings have so many characters at least.
MIN_CHARS = 16
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
PROGRAM_WORDS = (
    "abstract account action adapter address array async base batch block body buffer builder bytes cache callback channel check class client code column command"
    " config connection container content context controller count create cursor data database date default delete device document element entry error event exception"
    " executor factory field file filter format frame function get group handler header host id image index info input instance interface item job key layer length"
    " level list listener load local lock manager map max message method min mode model module name network node number object offset option order output packet page"
    " param parser path pattern pool port process profile provider proxy query queue read reader record reference registry request resource response result retry role"
    " root route row rule schema scope search section select server service session set size socket source spec stack start state status step storage store stream"
    " string system table target task template test text thread time timeout token transaction type unit update upload url user util value version view widget window"
    " worker wrapper write writer"
).split()
_TOKEN = r"[A-Za-z0-9+/_\-]{%d,}={0,2}"
_AT = np.full(256, -1, dtype=np.int16)
for _i, _c in enumerate(CHARS):
    _AT[ord(_c)] = _i


@dataclass
class Markov:
    """Log probabilities: start[c] and step[a, b]."""

    start: np.ndarray
    step: np.ndarray


def train(tokens: list[str]) -> Markov:
    k = len(CHARS)
    start, step = np.full(k, 0.5), np.full((k, k), 0.1)
    for t in tokens:
        c = _AT[np.frombuffer(t.encode("latin-1"), dtype=np.uint8)]
        start[c[0]] += 1
        np.add.at(step, (c[:-1], c[1:]), 1)
    return Markov(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)))


@dataclass
class Detector:
    random: Markov
    ordinary: Markov
    threshold: float = 0.0

    def ratio(self, token: str) -> float:
        """Mean log-likelihood ratio of a character, random over ordinary."""
        c = _AT[np.frombuffer(token.encode("latin-1"), dtype=np.uint8)]
        start = self.random.start[c[0]] - self.ordinary.start[c[0]]
        steps = self.random.step[c[:-1], c[1:]] - self.ordinary.step[c[:-1], c[1:]]
        return float(start + steps.sum()) / len(c)


def fit_detector(samples: list[tuple[str, bool]]) -> Detector:
    """From labelled (token, is random) samples: two thirds train the models, the others set the threshold."""
    usable = [(t, y) for t, y in samples if t and all(ch in CHARS for ch in t)]
    held = usable[::3]
    rest = [x for i, x in enumerate(usable) if i % 3]
    out = Detector(train([t for t, y in rest if y]), train([t for t, y in rest if not y]))
    scores = sorted((out.ratio(t), y) for t, y in held)
    if scores:
        values = np.array([s for s, _ in scores])
        labels = np.array([y for _, y in scores])
        wrong = np.concatenate(([0], np.cumsum(labels))) + np.concatenate((np.cumsum((~labels)[::-1])[::-1], [0]))
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        low = values[k - 1] if k else values[0] - 1
        high = values[k] if k < len(values) else values[-1] + 1
        out.threshold = float((low + high) / 2)
    return out


def labelled_samples(words: list[str], n: int = TRAIN_SAMPLES, seed: int = SEED) -> list[tuple[str, bool]]:
    """Random strings of the alphabets that keys use, and identifiers of the given words in the usual spellings."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = CHARS[:26], CHARS[26:52], CHARS[52:62]
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", upper + digits, upper + "234567", lower + digits, upper + lower + digits, CHARS[:64])
    words = [*words, *PROGRAM_WORDS * max(1, len(words) // len(PROGRAM_WORDS))]
    out: list[tuple[str, bool]] = []
    for i in range(n):
        a = alphabets[i % len(alphabets)]
        out.append(("".join(a[k] for k in rng.integers(0, len(a), int(rng.integers(16, 65)))), True))
        parts: list[str] = []
        while sum(map(len, parts)) < 16:
            parts.append(words[int(rng.integers(len(words)))])
        style = i % 7
        number = str(int(rng.integers(0, 2100))) if i % 5 == 0 else ""
        out.append((
            (
                "_".join(parts),
                "-".join(parts),
                "".join(p.capitalize() for p in parts),
                parts[0] + "".join(p.capitalize() for p in parts[1:]),
                "_".join(parts).upper(),
                "".join(parts),
                "/".join(parts),
            )[style]
            + number,
            False,
        ))
    return out


def sample_words(docs: DataFrame, most: int = TRAIN_WORDS, text_col: str = "text") -> list[str]:
    """The `most` words of two to twelve letters, in lower case, that most documents hold, of equals
    the first by name. Whole texts of all documents are counted; a word counts once for a document."""
    tokens = F.array_distinct(F.split(F.lower(quoted(text_col)), "[^a-z0-9_]+"))
    short = docs.select(F.explode(tokens).alias("w")).where(F.length("w").between(2, 12))
    # letters are told from digits once for each word, not for each document
    words = short.groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").rlike("^[a-z]+$"))
    return [r.w for r in words.orderBy(F.desc("n"), "w").limit(most).collect()]


def scan_secrets(docs: DataFrame, detector: Detector, *, min_chars: int = MIN_CHARS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, start, end, preview, score), one for each finding.

    start and end count characters from 0, end not included; preview shows the first four only.
    Whole texts are scanned. A null or empty text has no findings; null ids and repeated rows
    each give theirs; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    pattern = _TOKEN % min_chars
    in_type = docs.select(quoted(id_col).alias("doc_id")).schema["doc_id"].dataType
    schema = f"doc_id {in_type.simpleString()}, start bigint, end bigint, preview string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(pattern)
        for batch in batches:
            at, start, end, preview, score = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                for m in token.finditer(text.as_py()):
                    ratio = detector.ratio(m.group())
                    if ratio > detector.threshold:
                        at.append(i)
                        start.append(m.start())
                        end.append(m.end())
                        preview.append(m.group()[:4] + "...")
                        score.append(round(ratio, 6))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(preview, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "start", "end", "preview", "score"],
            )

    likely = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).where(F.col("text").rlike("[A-Za-z0-9+/_\\-]{%d}" % min_chars))
    return likely.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, *, most_words: int = TRAIN_WORDS, samples: int = TRAIN_SAMPLES) -> DataFrame:
    """Train on generated keys and on identifiers of the corpus's own words, then scan; see scan_secrets."""
    prepare(docs.sparkSession)
    return scan_secrets(docs, fit_detector(labelled_samples(sample_words(docs, most_words), samples)))
