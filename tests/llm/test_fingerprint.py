import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallywright.llm import fingerprint

from .conftest import doc


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


def test_levels_against_counting():
    data = np.frombuffer(bytes(random.Random(1).choices(b"abcdefgh \n", k=500)) + b"\0" * 200, np.uint8)
    got = fingerprint.levels(data)
    want = [fingerprint.LEVEL_OF[sum(n * n for n in Counter(data[i : i + 64].tolist()).values())] for i in range(len(data) - 63)]
    assert got.tolist() == want


def test_features_against_brute_force():
    rng = random.Random(4)
    data = np.frombuffer(prose(rng, 120).encode(), np.uint8)
    ranks = np.array([rng.randrange(1000) for _ in range(fingerprint.LEVELS)])
    rank = ranks[fingerprint.levels(data)]
    points = Counter()
    for r in range(len(rank) - 63):
        run = rank[r : r + 64]
        points[r + int(np.argmin(run))] += 1
    at, _ = fingerprint.features(data, np.array([0, len(data)]), ranks)
    assert at.tolist() == sorted(p for p, n in points.items() if n >= fingerprint.POINTS)


def test_query_rows_pairs_and_ties(spark, corpus):
    rng = random.Random(7)
    rows = [doc(i, prose(rng, rng.choice([1, 5, 30, 300]))) for i in range(0, 120, 2)]
    rows += [doc(1, rows[0][1]), doc(3, None), doc(5, ""), doc(7, "é😀" * 300), doc(None, prose(rng, 50)), doc(9, prose(rng, 20_000))]
    rng.shuffle(rows)
    out = fingerprint.query(spark, corpus(documents=rows)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    after = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    by_text = {}
    for r in out:
        text = {d[0]: d[1] for d in rows}[r["doc_id"]] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[r["doc_id"]][:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(text) > 200 and r["doc_id"] != 7 and text != after[r["doc_id"]]:
            assert r["near_edited"] > 0.2 > r["near_next"]
        if text == after[r["doc_id"]]:
            assert r["near_next"] == 1


def test_single_and_empty(spark, corpus):
    (r,) = fingerprint.query(spark, corpus(documents=[doc(4, "only one text " * 30)])).collect()
    assert r["near_next"] == 1
    assert fingerprint.query(spark, corpus(documents=[])).count() == 0


def test_repeated_ids(spark, corpus):
    out = fingerprint.query(spark, corpus(documents=[doc(1, "same row"), doc(1, "same row"), doc(1, "other text"), doc(2, "x")])).collect()
    assert len(out) == 4


def test_operator_keeps_columns(spark, corpus):
    path = corpus(documents=[doc(1, "abc " * 200)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = fingerprint.fingerprint(docs, fingerprint.rank_table(docs), ["doc_id", "lang"])
    assert out.columns == ["doc_id", "lang", "fingerprint"] and out.first()["fingerprint"]


def test_fingerprints_do_not_depend_on_the_layout(spark, corpus, monkeypatch):
    rng = random.Random(12)
    rows = [doc(i, prose(rng, rng.choice([3, 12, 90, 400])) + rng.choice(["", "é" * 40, "=" * 90])) for i in range(200)]
    docs = spark.read.parquet(corpus(documents=rows) + "/documents.parquet")
    found = []
    for parts in (1, 7):
        dealt = docs.repartition(parts)
        ranks = fingerprint.rank_table(dealt)
        found.append((ranks.tolist(), sorted(map(tuple, fingerprint.fingerprint(dealt, ranks, ["doc_id"]).collect()))))
    assert found[0] == found[1]
    count = np.zeros(fingerprint.LEVELS, int)
    for r in rows:
        raw = r[1].encode()
        for i in range(len(raw) - 63):
            count[fingerprint.LEVEL_OF[sum(n * n for n in Counter(raw[i : i + 64]).values())]] += 1
    assert fingerprint.level_counts([r[1].encode() for r in rows]).tolist() == count.tolist()
    monkeypatch.setattr(fingerprint, "STEP", 100)
    assert fingerprint.level_counts([r[1].encode() for r in rows]).tolist() == count.tolist()


def test_long_texts_step_by_step(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 200).encode() for _ in range(3)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ranks = np.array([rng.randrange(1000) for _ in range(fingerprint.LEVELS)])
    want = [x.tolist() for x in fingerprint.features(data, starts, ranks)]
    monkeypatch.setattr(fingerprint, "STEP", 97)
    assert [x.tolist() for x in fingerprint.features(data, starts, ranks)] == want


def test_successors_over_many_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(fingerprint, "PART_BYTES", 300)
    rng = random.Random(13)
    rows = [doc(rng.randrange(10**6), f"text number {i} " + prose(rng, 8)) for i in range(150)] + [doc(None, "no id")]
    out = {r["doc_id"]: r for r in fingerprint.query(spark, corpus(documents=rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for (i, text, *_), after in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 4
        assert out[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[1][:k]).encode()).hexdigest()


def test_extra_columns_with_clashing_names(spark, corpus):
    docs = spark.createDataFrame([(1, "some text " * 60, 3, "x"), (2, "other words " * 60, 4, "y")], "doc_id long, text string, part int, fingerprint_of string")
    docs = docs.withColumnsRenamed({"fingerprint_of": "level"})
    out = fingerprint.fingerprint(docs, fingerprint.rank_table(docs), ["doc_id", "part", "level"]).collect()
    assert sorted((r["doc_id"], r["part"], r["level"]) for r in out) == [(1, 3, "x"), (2, 4, "y")]
    assert fingerprint.compare(docs.withColumn("guest", F.lit(True)), fingerprint.rank_table(docs)).count() == 2


def test_digest_and_likeness_against_a_plain_version():
    """Chained filters of distinct features in order of appearance; overlap beyond chance of each filter's best partner."""
    rng = random.Random(21)
    for n in (1, 40, 160, 161, 500):
        hashes = np.array([rng.getrandbits(64) for _ in range(n)] + [7, 7], np.uint64)
        seen = list(dict.fromkeys(hashes.tolist()))
        got = fingerprint.filters(hashes)
        assert len(got) == -(-len(seen) // 160)
        for k, row in enumerate(got):
            want = {(h >> 11 * j) & 2047 for h in seen[160 * k : 160 * (k + 1)] for j in range(5)}
            assert set(np.flatnonzero(np.unpackbits(row)).tolist()) == want

    def plain(a, b):
        if len(a) > len(b):
            a, b = b, a
        total = weight = 0.0
        for x in a:
            x = set(np.flatnonzero(np.unpackbits(x)).tolist())
            best = 0.0
            for y in b:
                y = set(np.flatnonzero(np.unpackbits(y)).tolist())
                chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
                cut = chance + 0.3 * (most - chance)
                best = max(best, min(1.0, max(0.0, (len(x & y) - cut) / (most - cut))))
            total, weight = total + best * len(x), weight + len(x)
        return total / weight

    base = [rng.getrandbits(64) for _ in range(200)]
    for keep in (0, 50, 150, 199):
        a, b = (fingerprint.filters(np.array(x, np.uint64)) for x in (base, base[:keep] + [rng.getrandbits(64) for _ in range(700)]))
        assert abs(fingerprint.likeness(a, b) - plain(a, b)) < 1e-6 and fingerprint.likeness(a, b) == fingerprint.likeness(b, a)
