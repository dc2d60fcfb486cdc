"""Personal data found behind disguises, with the place in the source text.

A chain of transducers rewrites a text and carries, for each output character, the range of
source characters it stands for: look-alike and full-width characters to ASCII (invisible ones
vanish), spelled digits to digits, and " [at] " and " dot " spellings to "@" and ".".
Identifiers are sought in the rewritten text and their spans mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.common import prepare, quoted

_LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀİ", "J": "Ј", "K": "КΚK", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "κ", "l": "ⅼ", "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕſ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ",
    ".": "。․", "@": "﹫", "-": "‐‑‒–—−﹣", " ": "      　",
}
_INVISIBLE = "​‌‍⁠﻿­"


def _letters() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(x): to for to, many in _LOOKALIKES.items() for x in many}
    for ranges in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EA), (0x2070, 0x209F)):
        for i in range(*ranges):
            plain = unicodedata.normalize("NFKC", chr(i))
            if len(plain) == 1 and plain.isascii() and i not in table:
                table[i] = plain
    # digits of other scripts
    table |= {i: str(unicodedata.decimal(chr(i))) for i in range(128, 0x110000) if i not in table and unicodedata.decimal(chr(i), None) is not None}
    return table | {ord(x): None for x in _INVISIBLE}


LETTERS = _letters()
_ODD = re.compile("[" + "".join(re.escape(chr(i)) for i in sorted(LETTERS)) + "]")

_GONE = re.compile(f"[{_INVISIBLE}]")

_DIGIT_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
DIGITS = {w: str(i) for i, words in enumerate(_DIGIT_WORDS) for w in words}
_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
#: Three spelled digits in a row at least, so that a lone "one" stays a word.
_SPELLED = re.compile(rf"(?<!\w){_WORD}(?:[ \t,.\-]{{1,3}}{_WORD}){{2,}}(?!\w)", re.I)
_ONE = re.compile(_WORD, re.I)
_DOT = "(?:dot|punkt|punto|point)"
_BRACKET = re.compile(r"[\[({<][ \t]*(?:(at|@|arroba|arobase|ät)|(dot|\.|punkt|punto|point))[ \t]*[\])}>]", re.I)
_BETWEEN = rf"(?:[ \t]+{_DOT}[ \t]+|[ \t]+\.[ \t]+|\.)"
#: Bare spellings count only where a whole address follows: name at host dot name.
_BARE = re.compile(rf"(?<![\w.+\-])([\w.+\-]++)([ \t]++(at|@|arroba)[ \t]++)([\w\-]++(?:{_BETWEEN}[\w\-]++)*?(?:[ \t]+{_DOT}[ \t]+|\.)([a-z]{{2,24}}+)(?![\w\-])(?!{_BETWEEN}[\w\-]))", re.I)
_BARE_DOT = re.compile(rf"[ \t]+{_DOT}[ \t]+|[ \t]+\.[ \t]+", re.I)
_AT_DOT = re.compile(rf"@[\w\-]++(?:(?:[ \t]+{_DOT}[ \t]+|\.)[\w\-]++)*[ \t]+{_DOT}[ \t]+[a-z]{{2,}}+(?!\w)", re.I)
#: Words that name no mailbox before "at", and those that seldom do: a plain dot behind such a word,
#: as in "book at example.com", makes no address.
_NO_MAILBOX = frozenset(
    "a an the this that these those it he she they we i you us me him her them all any some more most much many not only just even still now then here there back up down out off"
    " on in at by of to for from with and or but as so if than is are was were be been being am do does did done go goes went gone come comes came look looks looked looking stay"
    " stays stayed arrive arrives arrived meet meets met find finds found see sees saw seen live lived aim aimed laugh laughed point pointed good bad best better great".split()
)
_SELDOM_MAILBOX = _NO_MAILBOX | frozenset(
    "visit visits visited available lives work works worked working hosted host hosts located posted published read reads online shop buy sold sign register download order book"
    " learn apply start starts started end ended home website site page blog web link url click check subscribe join follow watch listen reach call write email mail contact based".split()
)
_ARTICLE = re.compile(r"(?:the|an?|this|that|our|your|my|his|her|its|their)[ \t]", re.I)
_DOMAINS = frozenset("com org net edu gov mil int info biz name io dev app ai co me tv us uk ca de fr es it nl be ch at eu se no dk fi pl cz pt ie ru ua jp cn kr in au nz br mx ar cl za tr gr il".split())

Edit = tuple[int, int, str]


class Mapped:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lo: np.ndarray | None = None
        self.hi: np.ndarray | None = None

    def rewrite(self, edits: list[Edit]) -> None:
        """Replaces the ranges of sorted, disjoint edits; a replacement's characters stand for the whole range."""
        if not edits:
            return
        lo = np.arange(len(self.text)) if self.lo is None else self.lo
        hi = lo + 1 if self.hi is None else self.hi
        text, los, his, at = [], [], [], 0
        for start, end, new in edits:
            text += [self.text[at:start], new]
            los += [lo[at:start], np.full(len(new), lo[start])]
            his += [hi[at:start], np.full(len(new), hi[end - 1])]
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.lo, self.hi = np.concatenate([*los, lo[at:]]), np.concatenate([*his, hi[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1]))


def _brackets(t: str) -> list[Edit]:
    """Bracketed spellings with the blanks around them."""
    out: list[Edit] = []
    for m in _BRACKET.finditer(t):
        a, b = m.span()
        least = out[-1][1] if out else 0
        while a > least and t[a - 1] in " \t":
            a -= 1
        while b < len(t) and t[b] in " \t":
            b += 1
        out.append((a, b, "@" if m.group(1) else "."))
    return out


def _bare(mapped: Mapped) -> list[Edit]:
    """Bare spellings of whole addresses."""
    out: list[Edit] = []
    t = mapped.text
    for m in _BARE.finditer(t):
        local, at, host, last = m.group(1).lower(), m.group(3), m.group(4), m.group(5)
        dots = [(m.start(4) + d.start(), m.start(4) + d.end()) for d in _BARE_DOT.finditer(host)]
        spelled = bool(dots) or any(mapped.source(i, i + 1)[1] - mapped.source(i, i + 1)[0] > 1 for i in range(*m.span(4)) if t[i] == ".")
        if _ARTICLE.match(host) or at != "@" and local in (_NO_MAILBOX if spelled else _SELDOM_MAILBOX):
            continue
        if spelled or last in _DOMAINS:
            out.append((*m.span(2), "@"))
            out += [(a, b, ".") for a, b in dots]
    return out


def normalise(text: str) -> Mapped:
    out = Mapped(text)
    if not text.isascii() and _ODD.search(text):
        if _GONE.search(text):
            out.rewrite([(m.start(), m.end(), LETTERS[ord(m.group())] or "") for m in _ODD.finditer(text)])
        else:  # one character for one: places stay
            out.text = text.translate(LETTERS)
    edits: list[Edit] = []
    for run in _SPELLED.finditer(out.text):
        at = run.start()
        for m in _ONE.finditer(out.text, run.start(), run.end()):
            if m.start() > at:
                edits.append((at, m.start(), ""))
            edits.append((m.start(), m.end(), DIGITS[m.group().lower()]))
            at = m.end()
    out.rewrite(edits)
    if any(c in out.text for c in "[({<"):
        out.rewrite(_brackets(out.text))
    out.rewrite(_bare(out))
    if "@" in out.text:
        out.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in _AT_DOT.finditer(out.text) for d in _BARE_DOT.finditer(m.group())])
    return out


_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9\-])")
_NUMBER = re.compile(r"[0-9](?:[0-9]|[ .()\-]{1,2}(?=[0-9(]))*")
#: Identifiers of digits touch no letter, digit or underscore.
_IP = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")
_SSN = re.compile(r"(?<![\w\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?!\w|-(?!\Z))")
_CARD = re.compile(r"(?<!\w)(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})(?!\w)")
_PHONE = re.compile(
    r"(?<![0-9])(?:(?<!\w)|(?=[+(]))(?:"
    r"(?:\+?[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,2}"
    r"|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}"
    r"|(?:[0-9]{1,3}[ .\-])?[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}"
    r"|[0-9]{10,11}"
    r")(?!\w)"
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Spans:
    """Disjoint spans in order; says in logarithmic time whether another one overlaps."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> bool:
        """Whether the span was free, and is now taken."""
        k = bisect_left(self.starts, b)
        if k and self.ends[k - 1] > a:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def _numbers(t: str, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
    """Identifiers of digits in a stretch of digits and separators and the character after it, the stricter kinds first."""
    taken = Spans()
    for kind, pattern in (("ip", _IP), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(t, lo, hi):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not luhn(digits) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if taken.add(*m.span()):
                yield kind, *m.span(), re.sub("[^0-9.]" if kind == "ip" else "[^0-9+]", "", m.group())


def find(text: str, disguised: bool = True) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of each identifier, in order; spans are of the source text.

    Identifiers do not overlap: e-mail addresses come before account numbers, these before numbers of
    other kinds. disguised: False where the text is known to hold nothing that normalise would rewrite.
    """
    mapped = normalise(text) if disguised else Mapped(text)
    t, found, taken = mapped.text, [], Spans()
    if "@" in t:
        found += [("email", *m.span(), m.group().lower()) for m in _EMAIL.finditer(t) if taken.add(*m.span())]
    for m in _IBAN.finditer(t):
        if _iban(m.group()) and not t[m.start() - 1 : m.start()].isalnum() and taken.add(*m.span()):
            found.append(("iban", *m.span(), m.group().replace(" ", "")))
    for m in _NUMBER.finditer(t):
        lo, hi = m.span()
        if hi - lo < 7:
            continue
        lo -= t[lo - 1 : lo] in ("+", "(")
        lo -= t[lo] == "(" and t[lo - 1 : lo] == "+"
        found += [x for x in _numbers(t, lo, hi + 1) if taken.add(x[1], x[2])]
    out = [(kind, *mapped.source(a, b), value) for kind, a, b, value in found]
    return sorted(out, key=lambda x: x[1:3])


#: What a text must hold for normalise to change it, and for find to find anything, for a scan of whole
#: batches outside Python: SPELLED in any case; ODD as it stands, since some of its letters fold to plain ones.
_WORDS = "(?:" + "|".join(sorted(DIGITS)) + ")"
SPELLED = rf"{_WORDS}[ \t,.\-]+{_WORDS}[ \t,.\-]+{_WORDS}|[\[({{<][ \t]*(?:at|@|arroba|arobase|ät|dot|\.|punkt|punto|point)[ \t]*[\])}}>]|[ \t](?:dot|punkt|punto|point)[ \t]|[ \t](?:at|@|arroba)[ \t]+[^ \t\n\r]+\.[a-z]"
ODD = _ODD.pattern
PLAIN = "[0-9@]"


def find_pii(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, kind, start, end, value), one for each identifier.

    start and end count characters of the source text from 0, end not included; value is the
    normalised identifier. Whole texts are scanned. A null or empty text has none; null ids and
    repeated rows each give theirs; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    in_type = docs.select(quoted(id_col).alias("doc_id")).schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            odd = pc.or_(pc.match_substring_regex(batch.column(1), SPELLED, ignore_case=True), pc.match_substring_regex(batch.column(1), ODD))
            any_ = pc.or_(odd, pc.match_substring_regex(batch.column(1), PLAIN))
            for i in pc.indices_nonzero(any_).to_pylist():
                got = find(batch.column(1)[i].as_py(), odd[i].as_py())
                at += [i] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "kind", "start", "end", "value"],
            )

    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).where(quoted("text").isNotNull())
    return texts.mapInArrow(run, f"doc_id {in_type.simpleString()}, kind string, start bigint, end bigint, value string")


def redact(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """text with each span replaced by its kind in angle brackets; spans as find gives them."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])
