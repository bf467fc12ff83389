import random
import re
import zlib

import pytest

from tallywright.llm import variants

from .conftest import doc


def plain_words(rows):
    """Distinct altered runs and their occurrences, straight from the contract."""
    counts = {}
    for doc_id, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            word = run[:k] + run[k + 1 :] if h % 97 == 0 else run
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    forms, counts = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        counts[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, counts[w], words[forms[w]] if forms[w] else None))
    return out


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_against_all_pairs(spark, corpus):
    rng = random.Random(5)
    base = ["window", "wondow", "letter", "aaaaa", "aaaaaa", "abcabc", "señora", "größer", "straße"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(120):
            w = rng.choice(base)
            if rng.random() < 0.25:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "a", "é", "x"]) + w[k + rng.randrange(2) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append(doc(i, rng.choice(["", "  ", "-"]).join([" ".join(words)])))
    rows += [doc(None, "Window window WINDOW"), doc(500, None), doc(501, ""), doc(502, "12 34 ÷÷÷÷÷ ×××××"), rows[0], rows[0]]
    path = corpus(documents=rows)
    want = plain_words(rows)
    out = variants.query(spark, path)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == plain(want) and len(want) > 100
    assert any(r[1] for r in plain(want)) and any(r[2] not in (r[0], r[1]) for r in plain(want))


@pytest.mark.parametrize("most", [2, 5, 64])
def test_crowded_blocks_are_divided_without_loss(spark, most):
    rng = random.Random(most)
    words = {"pre" + "".join(rng.choice("ab") for _ in range(rng.choice([4, 5, 6]))) + "post": rng.randrange(3, 4000) for _ in range(160)}
    words |= {"x" * k: 3 + k for k in range(5, 12)} | {"prefixonly" + c: 5 for c in "abcdefghijklmnop"}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(variants.variants(frame, most=most)) == plain(words)


def test_each_pair_once_and_no_block_beyond_its_bound(spark):
    words = [("".join(c), 5) for c in __import__("itertools").product("abc", repeat=5)]
    frame = spark.createDataFrame(words, "word string, n long")
    pairs, _ = variants.near_pairs(frame, most=8)
    found = [(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in pairs.collect()]
    assert len(found) == len(set(found)) == sum(near(a[0], b[0]) for a in words for b in words) // 2
    rows, _ = variants.blocks(frame, most=8)
    sizes = rows.groupBy(*variants.BOUNDS).count().collect()
    assert all(r["count"] <= 8 or r["size"] - r["head_size"] - r["tail_size"] == 1 for r in sizes)


def test_windows_of_very_long_texts(monkeypatch):
    text = "abc déf " * 50 + "x" * 300 + " y"
    whole = [w for ws in variants.runs(text) for w in ws]
    monkeypatch.setattr(variants, "WINDOW", 7)
    assert [w for ws in variants.runs(text) for w in ws] == whole == re.findall("[a-zà-ÿ]+", text)


def test_one_very_long_word_and_clashing_columns(spark):
    long = "q" * 200_000
    docs = spark.createDataFrame([(i, f"{long} {long[:-1]}z short", 9, "w") for i in range(4)], "doc_id long, text string, n long, word string")
    out = {r["word"]: r for r in variants.variants(variants.word_counts(docs)).collect()}
    assert set(out) == {long, long[:-1] + "z", "short"} and out[long]["n_near"] == 1 and out["short"]["n_near"] == 0


def test_empty_tables(spark, corpus):
    assert variants.query(spark, corpus(documents=[])).count() == 0
    assert variants.query(spark, corpus(documents=[doc(1, None), doc(2, "one two")])).count() == 0
