"""Operators that SQL cannot express against plain, slow versions of their own."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, gam, langid, mixing, pii, rules, secrets, sharding, urls
from quern.llm import neardup as N
from quern.llm.common import normal
from quern.llm.features import FEATURES, labelled_sample, text_features

DOCS = "doc_id bigint, text string"


def documents(spark, testdata, sf="0.001"):
    return spark.read.parquet(f"{testdata}/sf{sf}/documents.parquet")


# decontamination


def best_place(pattern, text):
    """Least edits of the pattern against any part of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_place_equals_the_full_table():
    rng = np.random.default_rng(0)
    for t in range(300):
        pattern = rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint8)
        text = rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint8)
        if t % 2 and len(text) > 20:
            text[5 : 5 + len(pattern)] = pattern[: len(text) - 5]
        want = best_place(pattern.tolist(), text.tolist())
        for most in (0, 1, 3, 6):
            got = decontam.locate(pattern, text, most)
            assert (got is None) == (want > most)
            if got:
                start, end, edits = got
                assert edits == want == edits_between(pattern.tolist(), text[start:end].tolist())


@pytest.mark.parametrize("length", (99, 100, 101, 399, 400, 401, 1200))
def test_one_rule_for_items_of_all_lengths(length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    item = text(length)
    index = decontam.build_index([(0, item)])
    part = min(length, 3 * decontam.PART // 2 - 1)
    for at in {0, (length - part) // 2, length - part}:
        assert decontam.find_leaks(text(200) + " " + item[at : at + part] + " " + text(200), index)
    assert not decontam.find_leaks(text(200) + " " + item[: decontam.PART // 2] + " " + text(200), index)


def test_windows_equal_the_full_table():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    items = [(k, text(rng.choice((20, 60, 130, 210, 470)))) for k in range(6)]
    index = decontam.build_index(items)
    for t in range(40):
        item = items[t % 6][1]
        lo = rng.randrange(len(item) // 2)
        piece = list(item[lo : lo + rng.choice((40, 100, 150, 300))])
        for _ in range(rng.randrange(6)):
            piece[rng.randrange(len(piece))] = rng.choice("abcdexyz")
        whole = text(60) + "".join(piece) + text(60)
        p = normal(whole)
        want = set()
        for k, i in items:
            w = normal(i)
            cuts = {(s, size) for size in (min(decontam.PART, len(w)), min(decontam.SPAN, len(w))) for s in {*range(0, len(w) - size, max(1, size // 2)), len(w) - size}}
            if any(decontam.budget(n) >= 0 and n >= decontam.Q and best_place(w[s : s + n].tolist(), p.tolist()) <= decontam.budget(n) for s, n in cuts):
                want.add(k)
        assert {r[0] for r in decontam.find_leaks(whole, index)} == want


def test_short_items_are_sought_in_short_texts(spark):
    docs = spark.createDataFrame([(1, " Forty-two! "), (2, "the answer is forty two of course"), (None, "forty two"), (3, ""), (4, "...")], DOCS)
    bench = spark.createDataFrame([(7, "forty two"), (8, "FORTY TWO"), (9, ""), (10, "?")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in decontam.leaks(docs, bench).collect())
    assert got == [(0, 7, 0, 9, 0), (0, 8, 0, 9, 0), (1, 7, 1, 10, 0), (1, 8, 1, 10, 0)]
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench).collect()) == [2, 3, 4]


# mixing


def test_thousands_of_weights(spark):
    docs = spark.createDataFrame([(i, "one two", f"s{i % 6000}") for i in range(12_000)], "doc_id bigint, text string, source string")
    weights = {f"s{i}": 1.0 + i % 3 for i in range(5000)}
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights, 60_000).collect()}
    total = sum(weights.values())
    assert len(rates) == 6000 and all(math.isclose(rates.get(f"s{i}"), weights.get(f"s{i}", 0) / total * 60_000 / 4) for i in range(6000))


def test_mixing_equals_plain_python(spark):
    import hashlib

    rows = [(i // 2, "w " * (i % 9), (None, "a", "b")[i % 3]) for i in range(300)] + [(None, "x", "a"), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"a": 3.0, None: 1.0}
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    want = []
    for i, t, s in rows:
        rate = weights.get(s, 0.0) / 4 * 2000 / tokens[s]
        number = int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        want += [(i, t, s, c) for c in range(int(rate) + (number < rate - int(rate)))]
    got = [tuple(r) for r in mixing.mix_sources(docs, weights, 2000).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# personal data


def slow_runs(t):
    """Runs of characters that an address may have, with their places."""
    out, start = [], None
    for i, c in enumerate(t + " "):
        ok = c.isascii() and (c.isalnum() or c in "._%+-@")
        if ok and start is None:
            start = i
        if not ok and start is not None:
            out.append((start, t[start:i]))
            start = None
    return out


def slow_emails(t):
    out = []
    for at, run in slow_runs(t):
        if run.count("@") != 1:
            continue
        local, host = run.split("@")
        labels = host.rstrip(".-_%+").split(".")
        if not local or not local[0].isalnum() or len(local) > 64 or len(labels) < 2 or not all(x and all(c.isalnum() or c == "-" for c in x) for x in labels):
            continue
        if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24:
            out.append(("email", at, at + len(local) + 1 + len(".".join(labels))))
    return out


def slow_numbers(t):
    """Addresses and social security numbers, by splitting at what no identifier holds."""
    out = []
    i = 0
    while i < len(t):
        if not t[i].isdigit() or not t[i].isascii():
            i += 1
            continue
        k = i
        while k < len(t) and (t[k].isascii() and t[k].isdigit() or t[k] in ".-" and t[k + 1 : k + 2].isdigit()):
            k += 1
        run, before, after = t[i:k], t[i - 1 : i], t[k : k + 1]
        alone = not (before.isalnum() or before in ("_", ".", "-") and before) and not (after.isalnum() or after == "_")
        parts = run.split(".")
        if alone and len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts):
            out.append(("ip", i, k))
        parts = run.split("-")
        if alone and [len(p) for p in parts] == [3, 2, 4] and all(p.isdigit() for p in parts) and parts[0] not in ("000", "666") and parts[0][0] != "9" and parts[1] != "00" and parts[2] != "0000":
            out.append(("ssn", i, k))
        i = k
    return out


def test_plain_identifiers_equal_a_slow_scan(spark, testdata):
    docs = documents(spark, testdata, "0.01")
    got = {(r.doc_id, r.kind, r.start, r.end) for r in pii.find_pii(docs).where("kind in ('email', 'ip', 'ssn')").collect()}
    want = {(r.doc_id, *x) for r in docs.collect() for x in slow_emails(r.text) + slow_numbers(r.text)}
    assert len(want) > 20 and got == want


WORDS = {d: ws for d, ws in zip("0123456789", pii._DIGIT_WORDS)}
ALIKE = {"a": "аａ", "e": "еｅ", "o": "оο", "p": "р", "s": "ѕſ", "i": "іı", "c": "с", "x": "х", "1": "１", "5": "５٥", "7": "७", "@": "＠", ".": "．"}


def disguise(rng, kind, value):
    """A spelling of the value, and whether a scan must see through letters, words or signs."""
    how = rng.randrange(5)
    if how == 1:
        return "".join(rng.choice(ALIKE[c]) if c in ALIKE and rng.random() < 0.6 else c for c in value)
    if how == 2:
        return "".join(c + (rng.choice("​­⁠") if k + 1 < len(value) and rng.random() < 0.3 else "") for k, c in enumerate(value))
    if kind == "email" and how >= 3:
        at = rng.choice((" [at] ", "(at)", " at ", " @ ", " { arroba } ", "\tat\t"))
        dot = rng.choice((" dot ", " (dot) ", "[.]", " punkt ", "\tdot\t"))
        return value.replace("@", at).replace(".", dot)
    if kind == "phone" and how >= 3:
        k = rng.randrange(4)
        digits = [WORDS[c][min(k, len(WORDS[c]) - 1)] for c in value if c.isdigit()]
        return rng.choice((" ", ", ", "-")).join(w.upper() if how == 4 else w for w in digits)
    return value


def test_planted_identifiers_are_found_where_they_stand(spark):
    rng = random.Random(5)
    fill = "the river went over green hills while quiet people walked home under tall trees".split()
    name = lambda n: "".join(rng.choice("bdfghjklmnpqrtvwz") for _ in range(n))
    rows, want = [], set()
    for i in range(600):
        text = " ".join(rng.choice(fill) for _ in range(rng.randrange(1, 30))) + ": "
        for _ in range(rng.randrange(4)):
            kind = rng.choice(("email", "phone", "ip", "card", "ssn"))
            value = {
                "email": f"{name(6)}@{name(7)}.{rng.choice(('com', 'org', 'de'))}",
                "phone": f"{rng.randrange(200, 900)}-{rng.randrange(200, 900)}-{rng.randrange(1000, 9999)}",
                "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
                "card": rng.choice(("4539148803436467", "4111 1111 1111 1111", "5500-0055-5555-5559")),
                "ssn": f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
            }[kind]
            shown = disguise(rng, kind, value)
            plain = "".join(c for c in value if c.isdigit() or c in ("." if kind in ("ip",) else "")) if kind != "email" else value
            want.add((i, kind, len(text), len(text) + len(shown), plain))
            text += shown + "; " + " ".join(rng.choice(fill) for _ in range(rng.randrange(1, 9))) + ": "
        rows.append((i, text))
    got = {tuple(r) for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(want) > 500 and got == want
    text = dict(rows)
    for i in range(0, 600, 50):
        clean = pii.redact(text[i], pii.find(text[i]))
        assert not pii.find(clean) and clean.count("<") >= len([w for w in want if w[0] == i])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ſix ſeven ſix five five five one two three four", "6765551234"),
        ("ſechs, ſieben, ſechs, eins, eins, eins, eins, eins, eins, eins", "6761111111"),
        ("SİX SEVEN SİX five five five one two three four", "6765551234"),
        ("٥٥٥-١٢٣-٤٥٦٧", "5551234567"),
        ("jacK@example.com", "jack@example.com"),
        ("john at example.com now", "john@example.com"),
        ("john at example [dot] com", "john@example.com"),
        ("john @ example.com", "john@example.com"),
        ("smith at example\tdot\tcom", "smith@example.com"),
        ("a.b [at] sub dot example dot co", "a.b@sub.example.co"),
        ("we wrote to tom at a.b.example dot org, ok", "tom@a.b.example.org"),
    ],
)
def test_mixed_disguises(text, want):
    assert [v for _, _, _, v in pii.find(text)] == [want]


def test_no_address_without_a_mailbox():
    for text in ("look at example.com", "book at the example.com site", "meet at noon.Then go", "He was at home. The dot com boom", " at x.com", "look at the dot com", "ſix ſeven ſix", "at 5 . 30 dot"):
        assert pii.find(text) == [], text


def test_every_letter_that_matches_another_is_rewritten():
    import re

    odd = [c for c in map(chr, range(128, 0x110000)) if re.match("[a-z]", c, re.I)]
    assert odd and all(ord(c) in pii.LETTERS for c in odd)
    for c in odd:
        pii.find(f"{c}ix {c}even {c}ix fi{c}e dot at {c} [at]")


@pytest.mark.parametrize(
    "make",
    [lambda n: "x dot y " + "-" * n, lambda n: " " * n + "( at", lambda n: "a@b.de 555-123-4567 " * (n // 20), lambda n: "(" * n + " dot ", lambda n: "x at " + "a." * (n // 2), lambda n: "x at " * (n // 5), lambda n: "+" * n + " dot a at b.c", lambda n: "one " * (n // 4) + "x", lambda n: "x at b" + " " * n + "dot"],
)
def test_scans_stay_linear(make):
    pii.find(make(1000))
    began = time.process_time()
    pii.find(make(100_000))
    assert time.process_time() - began < 5


def test_rows_without_id_and_repeated_rows_give_findings(spark):
    docs = spark.createDataFrame([(1, "a@b.de"), (1, "a@b.de"), (None, "a@b.de"), (2, None)], DOCS)
    assert sorted((r.doc_id or 0, r.value) for r in pii.find_pii(docs).collect()) == [(0, "a@b.de"), (1, "a@b.de"), (1, "a@b.de")]


# sharding


@pytest.mark.parametrize("sizes", ("one", "few", "many"))
def test_shards_equal_the_heap(spark, sizes):
    rng = random.Random(sizes)
    size = {"one": lambda: 3, "few": lambda: rng.choice((0, 1, 1, 2, 7, 50)), "many": lambda: rng.randrange(5000)}[sizes]
    rows = [(f"k{i:05d}", size()) for i in range(4000)] + [("big", 10**12), ("large", 9000)]
    got = {r.key: r.shard for r in sharding.assign_groups(spark.createDataFrame(rows, "key string, size bigint"), 9).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == dict(zip([k for k, _ in order], sharding.lpt([n for _, n in order], 9)))


# URLs


def test_lists_too_long_to_broadcast(spark, testdata):
    pages = spark.read.parquet(f"{testdata}/sf0.01/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(pages.limit(20)).unionByName(spark.createDataFrame([(None, None), (5, "http://x.org/" + "a" * 20_000), (6, "x.org/" + "a" * 20_000)], "page_id bigint, url string"))
    listed = pages.where("page_id % 5 = 0")
    rows = lambda most: sorted(map(repr, urls.filter_urls(pages, listed, most_broadcast=most).collect()))
    assert rows(0) == rows(10**6) and len(rows(0)) == 273
    assert urls.filter_urls(pages, listed).where("page_id = 6 and listed").count() >= 1


# statistics, rules and the model


def slow_features(text):
    t = text or ""
    words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    n, chars = len(words), len(t)
    edges = (t[:1] in " \t\n\r" or t[-1:] in " \t\n\r") if t else False
    distinct = len(set(words)) + (1 if edges else 0)
    spaced = t.split()
    repeats = sum(a == b for a, b in zip(spaced, spaced[1:]))
    import unicodedata

    per = lambda x, y: x / y if y else 0.0
    return {
        "words": n,
        "mean_word_chars": per(chars, n),
        "symbol_ratio": per(sum(c in "#$%&*+=<>^~@\\{}" for c in t), chars),
        "bang_per_word": per(t.count("!"), n),
        "pipe_per_word": per(t.count("|"), n),
        "upper_ratio": per(sum(unicodedata.category(c) == "Lu" for c in t), chars),
        "digit_ratio": per(sum(c in "0123456789" for c in t), chars),
        "stop_per_word": per(t.count("."), n),
        "variety": min(math.log(distinct) / math.log(n), 1.0) if n > 1 else min(n, 1.0),
        "repeat_ratio": per(repeats, n),
        "lines_per_word": per(t.count("\n"), n),
    }


def odd_documents(spark, testdata):
    odd = [(9001, None), (9002, ""), (9003, "  \n"), (9004, " a  a\ta\nb "), (9005, "A" * 50_000), (9006, "go go. go go! ÉÜ 12|3 {x}")]
    return documents(spark, testdata).select("doc_id", "text").unionByName(spark.createDataFrame(odd, DOCS))


def test_features_equal_plain_python(spark, testdata):
    for r in text_features(odd_documents(spark, testdata), [F.col("doc_id"), F.col("text").alias("t")]).collect():
        want = slow_features(r.t)
        assert all(math.isclose(r[f], want[f], rel_tol=1e-9, abs_tol=1e-12) for f in FEATURES), (r.doc_id, r.asDict(), want)


def test_rules_equal_plain_python(spark, testdata):
    docs = odd_documents(spark, testdata)
    C = rules.Condition
    listed = [(C("words", False, 0.0),), (C("repeat_ratio", True, 0.05), C("variety", False, 0.9)), (C("symbol_ratio", True, 0.01),), (C("words", True, 400.0),)]
    listed += rules.fit_rules(documents(spark, testdata, "0.01"), spark.read.parquet(f"{testdata}/sf0.01/labels.parquet"))
    want = {}
    for r in docs.collect():
        x = slow_features(r.text)
        number = next((i for i, rule in enumerate(listed, 1) if all((x[c.feature] > c.threshold) == c.above for c in rule)), 0)
        want[r.doc_id] = (number, " and ".join(map(str, listed[number - 1])) if number else None, number == 0)
    assert len({w[0] for w in want.values()}) > 3
    assert {r.doc_id: (r.rule, r.reason, r.keep) for r in rules.apply_rules(docs, listed).collect()} == want
    assert {r.doc_id for r in rules.keep_good(docs, listed).collect()} == {i for i, w in want.items() if w[2]}


def test_a_filter_on_statistics_computes_them_once(spark, testdata):
    docs = documents(spark, testdata)
    kept = rules.keep_good(docs, [(rules.Condition("repeat_ratio", True, 0.5), rules.Condition("upper_ratio", True, 0.5)), (rules.Condition("repeat_ratio", True, 0.2),)])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2, plan


def test_grown_condition_is_the_best_cut():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = {f: rng.integers(0, 12, 150).astype(float) for f in FEATURES}
        y = rng.random(150) < np.where(x["words"] > 6, 0.8, 0.2)
        p0, n0 = int(y.sum()), int((~y).sum())
        base = math.log2(p0 / (p0 + n0))
        best = 0.0
        for f in FEATURES:
            for cut in sorted(set(x[f]))[:-1]:
                for inside in (x[f] <= cut, x[f] > cut):
                    p, t = int(y[inside].sum()), int(inside.sum())
                    if p and t >= rules.MIN_COVER:
                        best = max(best, p * (math.log2(p / t) - base))
        first = rules._grow(x, y)[0]
        inside = first.holds(x)
        assert math.isclose(y[inside].sum() * (math.log2(y[inside].mean()) - base), best)


def gain(g, h):
    return g * g / (h + 1.0)


def test_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9)
        worth = lambda edges: sum(gain(g[a:b].sum(), h[a:b].sum()) for a, b in zip(edges, edges[1:]))
        first = max(range(1, 9), key=lambda c: worth([0, c, 9]))
        second = max((c for c in range(1, 9) if c != first), key=lambda c: worth(sorted([0, first, c, 9])))
        edges = [0, 9]
        for c in (first, second):
            if worth(sorted([*edges, c])) > worth(edges) + 1e-9:
                edges = sorted([*edges, c])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1.0)) for a, b in zip(edges, edges[1:])])
        assert np.allclose(gam._tree(g, h), want)


def test_cross_is_the_best_of_all_cuts():
    rng = np.random.default_rng(6)
    for _ in range(30):
        g, h = rng.normal(size=(5, 6)), rng.random((5, 6))
        best = None
        for i in range(1, 5):
            for j in range(1, 6):
                quarters = [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
                worth = sum(gain(g[q].sum(), h[q].sum()) for q in quarters) - gain(g.sum(), h.sum())
                if best is None or worth > best[0] + 1e-12:
                    out = np.empty_like(g)
                    for q in quarters:
                        out[q] = g[q].sum() / (h[q].sum() + 1.0)
                    best = (worth, out)
        got = gam._cross(g, h)
        assert math.isclose(got[0], best[0]) and np.allclose(got[1], best[1])


def test_model_scores_equal_plain_sums(spark, testdata):
    labels = spark.read.parquet(f"{testdata}/sf0.01/labels.parquet")
    model = gam.fit_quality(documents(spark, testdata, "0.01"), labels)
    docs = odd_documents(spark, testdata)
    got = {r.doc_id: (r.quality, r.keep) for r in gam.score_documents(docs, model).collect()}
    for r in docs.collect():
        x = slow_features(r.text)
        b = [sum(1 for e in edges if e < x[f]) for f, edges in zip(FEATURES, model.edges)]
        score = model.intercept + sum(t[k] for t, k in zip(model.tables, b)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        want = 1 / (1 + math.exp(-score))
        assert math.isclose(got[r.doc_id][0], want, rel_tol=1e-6) and got[r.doc_id][1] == (want >= gam.KEEP_AT)


def test_sample_is_bounded_with_repeated_ids_and_dotted_names(spark):
    docs = spark.createDataFrame([(i % 5, f"word{i} again") for i in range(50)] + [(None, "x")], "`a.id` bigint, `the.text` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(None, 1)], "`a.id` bigint, `is.good` int")
    rows = labelled_sample(docs, labels, "is.good", 4, "the.text", "a.id").collect()
    assert len(rows) == 4 == len({r.doc for r in rows})
    found = rules.fit_rules(docs, labels, label="is.good", text_col="the.text", id_col="a.id")
    assert rules.apply_rules(docs, found, text_col="the.text", id_col="a.id").count() == 51
    assert rules.keep_good(docs, found, text_col="the.text").columns == docs.columns
    assert gam.score_documents(docs, gam.fit_quality(docs, labels, label="is.good", text_col="the.text", id_col="a.id"), text_col="the.text", id_col="a.id").count() == 51


# languages


def test_languages_equal_plain_cosines(spark, testdata):
    docs = documents(spark, testdata)
    learned = langid.fit_prototypes(docs)
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], dtype=np.int8), size=(langid.LETTERS, langid.DIMENSIONS)).astype(int)

    def bundle(text):
        p = [0, *(0 if c == 32 else 1 + c % (langid.LETTERS - 1) for c in normal(text).tolist()), 0]
        return sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(p, p[1:], p[2:])), np.zeros(langid.DIMENSIONS))

    sums = {}
    rows = docs.orderBy(F.length("text")).limit(60).collect()
    few = spark.createDataFrame(rows, docs.schema)
    for r in rows:
        v = bundle(r.text)
        if normal(r.text).size and v.any():
            sums[r.lang] = sums.get(r.lang, 0) + v / np.linalg.norm(v)
    mine = langid.fit_prototypes(few)
    assert set(mine) == set(sums) and all(np.allclose(mine[k], v / np.linalg.norm(v)) for k, v in sums.items())
    for r in langid.identify(few, learned).collect():
        v = bundle(next(x.text for x in rows if x.doc_id == r.doc_id))
        if not v.any() or r.language == langid.NONE:
            continue
        near = sorted(((-float(v @ p / np.linalg.norm(v)), k) for k, p in learned.items()))
        assert r.language == near[0][1] or abs(near[0][0] - near[1][0]) < 1e-5
        assert abs(r.cosine + near[0][0]) < 1e-5 and abs(r.margin - (near[1][0] - near[0][0])) < 1e-5


def test_languages_without_ids_and_in_a_bound(spark):
    docs = spark.createDataFrame([(None, "guten tag", "de"), (None, "bonjour monde", "fr"), (None, "guten tag", "de"), (None, None, "xx"), (None, "x", None)], "doc_id bigint, text string, lang string")
    learned = langid.fit_prototypes(docs)
    assert set(learned) == {"de", "fr"} and len(langid.fit_prototypes(docs, most=1)) == 1
    assert np.allclose(learned["de"], langid.fit_prototypes(docs.limit(1))["de"])
    rows = {r.language for r in langid.identify(docs, learned).collect()}
    assert rows >= {"de", "fr", "und"}
    tied = {k: learned["de"] for k in ("b", "a", "c")}
    assert {r.language for r in langid.identify(docs.limit(1), tied).collect()} == {"a"}


# secrets


def test_words_come_from_whole_texts_of_all_documents(spark):
    rows = [(i, "filler " * 500 + ("zanzibar" if i >= 300 else "")) for i in range(340)]
    assert secrets.sample_words(spark.createDataFrame(rows, DOCS), 2) == ["filler", "zanzibar"]
    assert secrets.sample_words(spark.createDataFrame([(1, None), (2, ""), (None, "two TWO x b2 words")], DOCS)) == ["two", "words"]


def test_ratio_equals_plain_sums():
    samples = secrets.labelled_samples(["alpha", "beta"], 400)
    d = secrets.fit_detector(samples)
    rest = [x for i, x in enumerate(samples) if i % 3]
    k = len(secrets.CHARS)

    def chance(label):
        tokens = [t for t, y in rest if y == label]
        starts = {c: 0.5 for c in secrets.CHARS}
        steps = {(a, b): 0.1 for a in secrets.CHARS for b in secrets.CHARS}
        for t in tokens:
            starts[t[0]] += 1
            for a, b in zip(t, t[1:]):
                steps[a, b] += 1
        rows = {a: sum(steps[a, b] for b in secrets.CHARS) for a in secrets.CHARS}
        total = sum(starts.values())
        return lambda t: math.log(starts[t[0]] / total) + sum(math.log(steps[a, b] / rows[a]) for a, b in zip(t, t[1:]))

    random_, ordinary = chance(True), chance(False)
    held = samples[::3]
    assert k == 67 or k > 60
    for t, _ in held[:100]:
        assert math.isclose(d.ratio(t), (random_(t) - ordinary(t)) / len(t), rel_tol=1e-9, abs_tol=1e-9)
    wrong = lambda x: sum((d.ratio(t) > x) != y for t, y in held)
    assert wrong(d.threshold) == min(wrong(d.ratio(t)) for t, _ in held)


def test_scan_equals_plain_python(spark, testdata):
    import re

    docs = documents(spark, testdata, "0.01")
    d = secrets.fit_detector(secrets.labelled_samples(secrets.sample_words(docs)))
    got = {(r.doc_id, r.start, r.end) for r in secrets.scan_secrets(docs, d).collect()}
    want = {(r.doc_id, m.start(), m.end()) for r in docs.collect() for m in re.finditer(r"[A-Za-z0-9+/_\-]{16,}={0,2}", r.text) if d.ratio(m.group()) > d.threshold}
    assert got == want and want


# near-duplicates


def test_rows_of_one_id_and_of_none(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (3, text(2)), (3, text(2)), (None, text(3)), (None, text(3)), (None, text(1)), (4, None), (4, None), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"__same": F.lit(1), "__row": F.lit(2), "a.b": F.lit(3)})
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, text(1)), (3, text(2)), (0, text(3)), (0, text(1)), (4, ""), (4, ""), (0, ""), (5, "")])


def test_an_id_of_two_texts_ties_groups(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [(10, text(1)), (11, text(1)), (11, text(2)), (12, text(2) + " more"), (13, text(2)), (14, text(3)), (15, text(3))]
    got = {r.doc_id: r.duplicate_of for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {11: 10, 12: 10, 13: 10, 15: 14}


def test_blocks_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 32, (60, 20), dtype=np.uint32)
    rows = [(i % 2, i, 20, i, bytearray(N.word_counts(words[0 if i % 3 else i]))) for i in range(60)]
    got = sorted((r.a, r.b) for r in N._apart(spark.createDataFrame(rows, "key bigint, id bigint, n int, root bigint, counts binary"), 0.75).collect())
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and N.least_edits(*(np.frombuffer(bytes(rows[k][4]), dtype=np.uint8)[None, :] for k in (a, b)))[0] <= 5)
    assert got == want and len(want) > 100


def test_least_is_checked(spark):
    with pytest.raises(ValueError):
        N.near_duplicates(spark.createDataFrame([], DOCS), least=0)


def test_plain_texts_are_not_rewritten(spark, testdata):
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.array(["plain words, six books and Kings in a row. Is it so?", "SIX SISTERS"] + [r.text for r in documents(spark, testdata).collect()])
    marked = pc.or_(pc.match_substring_regex(texts, pii.SPELLED, ignore_case=True), pc.match_substring_regex(texts, pii.ODD)).to_pylist()
    assert not any(marked[:2]) and sum(marked) < len(marked) / 2
    for t, m in zip(texts.to_pylist(), marked):
        assert m or pii.normalise(t).text == t
