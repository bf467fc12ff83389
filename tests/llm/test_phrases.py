import random
import re
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import phrases

from .conftest import doc

STEPS = {"longest": 4, "frequent": 30, "first": 2000}


def plain(rows, longest=4, frequent=30, first=2000):
    """The contract by plain counting, without levels."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= frequent}
    gone = {(lang, w[i : i + k]) for (lang, w), a in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 80 * f[lang, w[i : i + k]]}
    by_lang = {}
    for (lang, w), a in candidates.items():
        if (lang, w) in gone:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, le, ri, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, le, ri) in enumerate(sorted(found)[:first], 1)}


def made(n=220):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(30):
            parts.append(rng.choice(["New York City hall", "red  house", "the\tcat", "the cat sat", "of of of of of", "été là", "x", "odd%d" % rng.randrange(9999), "a b"]))
            parts.append(rng.choice([" ", " ", ". ", ",", "\n", "\x0b", "?!", "\xa0"]))
        rows.append(doc(i, "".join(parts), lang=rng.choice(["en", "en", "fr", None, "und"])))
    return rows


def got(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def test_query_against_plain_counting(spark, corpus):
    rows = made() + [doc(900, None), doc(901, ""), doc(None, "the cat"), doc(902, ".,;"), doc(903, "\x1c \x85   the cat")]
    rows += [rows[0], rows[0]]
    out = phrases.query(spark, corpus(documents=rows))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows)
    assert got(out) == want and {r[0] for r in want} == {"en", "fr", "und"} and {len(r[2].split(" ")) for r in want} == {2, 3, 4}


def test_a_filter_that_lets_all_through_changes_nothing(spark, corpus, monkeypatch):
    rows = made(120)
    path = corpus(documents=rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = got(phrases.collocations(docs, frequent=5, first=25))
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "FILTER_BITS", 8)
    monkeypatch.setattr(phrases, "SEGMENT_BITS", 8)
    assert got(phrases.collocations(docs, frequent=5, first=25)) == want == plain(rows, frequent=5, first=25)


def test_filters_hold_what_they_were_given(spark):
    rows = [("en", f"w{i} v{i}") for i in range(9000)]
    held = phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"), 2)
    of = lambda lang, p: phrases.mixed(phrases.hashes(p.encode().split(b" ")), lang, 2)[0]
    assert held.holds(np.array([of("en", p) for _, p in rows])).all()
    assert held.holds(np.array([of("fr", p) for _, p in rows])).mean() < 0.1 and held.bits == 1 << 18


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_windows_split_long_texts_without_loss(k):
    raw = b"one two. three four five," + b"x" * 90 + b" six\tseven " * 30 + b"no-end" + b"." * 20
    whole = next(phrases.windows(raw, k))
    grams = lambda ws: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1) if phrases.END not in ws[i : i + k])
    for limit in (1, 2, 5, 11, 64):
        total = Counter()
        for words in phrases.windows(raw, k, limit):
            total += grams(words)
        assert total == grams(whole), limit


def test_ranks_are_exact_beyond_64_bits():
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 4, 9], np.int32)
    codes = phrases.ranked(ids, np.array([0, 1, 4, 5]), 4, 1 << 24)
    assert codes[0] == codes[2] and codes[1] != codes[3] and codes[0] != codes[1]


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    c = spark.createDataFrame([("en", "a b", 2, big - 1)], "lang string, phrase string, k int, a long")
    parts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, f long")
    assert phrases.scored(c, parts).first()["score"] == 2_000_000 * (big - 1) // (2 * big + 7)


def test_empty_tables_and_clashing_columns(spark, corpus):
    assert phrases.query(spark, corpus(documents=[])).count() == 0
    docs = spark.createDataFrame([("en", "a b " * 40, 3, "z")], "lang string, text string, f long, phrase string")
    assert got(phrases.collocations(docs)) == plain([(0, "a b " * 40, "en")])
