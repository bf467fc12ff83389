import hashlib
import random

import numpy as np

from tallywright.llm import repeats

from .conftest import doc


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda r: r[0]):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def rows(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdéf 😀", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(150)
    texts = [prose(rng.randint(1, 80)) for _ in range(30)]
    texts += [prose(10) + passage + prose(10) for _ in range(40)]
    texts += [passage[k : k + 110] for k in range(0, 60, 7)]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [base, base, "x" * 99, "x" * 100, "x" * 101, "x" * 5000, "ab" * 400, "", None, "y" * 99 + "z", ("long " + prose(30)) * 40]
    ids = random.Random(1).sample(range(10**6), len(texts))
    return [doc(i, t) for i, t in zip(ids, texts, strict=True)]


def test_against_brute_force(spark, corpus):
    data = rows()
    got = sorted(tuple(r) for r in repeats.query(spark, corpus(documents=data)).collect())
    assert got == brute(data)


def test_long_groups_as_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    data = rows(6)
    assert sorted(tuple(r) for r in repeats.query(spark, corpus(documents=data)).collect()) == brute(data)


def test_full_filter_changes_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "filled", lambda hashes: np.full((1 << repeats.CELL_BITS, (1 << repeats.IN_CELL) // 8), 255, np.uint8))
    data = rows(7)
    assert sorted(tuple(r) for r in repeats.query(spark, corpus(documents=data)).collect()) == brute(data)


def test_matches_never_cross_documents(spark, corpus):
    whole = "".join(random.Random(2).choices("abcdefgh", k=150))
    out = {r["doc_id"]: r for r in repeats.query(spark, corpus(documents=[doc(1, whole[:75]), doc(2, whole[75:]), doc(3, whole), doc(4, whole[:99])])).collect()}
    assert all(r["n_removed"] == 0 for r in out.values())


def test_ties_and_empty(spark, corpus):
    text = "".join(random.Random(3).choices("abcdefgh", k=200))
    out = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in repeats.query(spark, corpus(documents=[doc(None, text), doc(5, text), doc(5, text), doc(9, text)])).collect()), key=str)
    assert out == sorted([(True, None, 200), (False, 5, 0), (False, 5, 0), (False, 9, 200)], key=str)
    assert repeats.query(spark, corpus(documents=[])).count() == 0


def test_very_long_texts_in_pieces(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 150)
    monkeypatch.setattr(repeats, "TOGETHER", 1000)
    data = rows(8)
    assert sorted(tuple(r) for r in repeats.query(spark, corpus(documents=data)).collect()) == brute(data)


def test_rows_alike_beside_edited_ones(spark, corpus):
    """Rows alike are one document, also where an anchor has several stretches."""
    base = "".join(random.Random(4).choices("abcdefgh", k=600))
    texts = [base, base[:150] + "Z" + base[151:], base[:420] + "Q" + base[421:]]
    data = [doc(i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in repeats.query(spark, corpus(documents=data + data)).collect())
    assert got == sorted(brute(data) * 2)


def test_suffix_order_by_a_difference_cover():
    rng = np.random.default_rng(9)
    for _ in range(400):
        symbols = rng.integers(0, rng.integers(1, 5), rng.integers(0, 80))
        assert repeats.suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    big = rng.integers(0, 1 << 40, 200)
    assert repeats.suffix_order(big).tolist() == sorted(range(200), key=lambda i: big[i:].tolist())


def test_extra_columns_with_clashing_names(spark, corpus):
    text = "".join(random.Random(5).choices("abcdefgh", k=300))
    docs = spark.createDataFrame([(1, text, 7, "x"), (2, text, 8, "y")], "doc_id long, text string, id long, runs string")
    out = {r["doc_id"]: r for r in repeats.with_spans(docs, ["doc_id", "id"]).collect()}
    assert out[1]["runs"] is None and out[1]["id"] == 7
    assert repeats.joined_runs((r["lo"], r["hi"]) for r in out[2]["runs"]) == [(0, 300)] and out[2]["id"] == 8
