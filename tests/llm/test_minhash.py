import random
import re

import numpy as np
import pytest

from tallywright.llm import components, minhash

from .conftest import doc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [brute_set(r[1]) for r in rows]
    at = {i: i for i in range(len(rows))}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                at[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {(r[0], len(s), least[root(i)], r[0] == least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))}


def varied(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def corpus_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 120, 400]))
        texts += [varied(rng, base, rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(rng.choice([2, 3, 9]))]
    hot = rng.choices(vocabulary, k=200)
    texts += [varied(rng, hot, rng.choice([1, 2, 3, 4])) for _ in range(70)]  # one large group of near copies
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=120)) for _ in range(60)]  # a passage that many share
    texts += ["", " \n", "one", "One", "one two three four", "ONE two THREE four", "É a b c d", "é a b c d", "x " * 3000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [doc(i, t) for i, t in zip(ids, texts, strict=True)]


def test_sets_against_strings():
    texts = [r[1] for r in corpus_rows()] + ["a\x0bb\x0cc d\x85e f\xa0g", "A" * 5000 + " b c d e f"]
    sets = minhash.shingle_sets(texts)
    seen = {}
    for t, s in zip(texts, sets, strict=True):
        want = brute_set(t)
        assert len(s) == len(want) and np.array_equal(s, np.sort(s))
        assert seen.setdefault(frozenset(want), s.tobytes()) == s.tobytes()


def test_query_against_brute_force(spark, corpus):
    rows = corpus_rows()
    got = {tuple(r) for r in minhash.query(spark, corpus(documents=rows)).collect()}
    assert got == brute(rows)


def test_edges(spark, corpus):
    text = "the same text once more and again"
    rows = [doc(7, text), doc(7, text), doc(3, text), doc(None, text), doc(None, "alone with no id at all"), doc(9, None)]
    out = sorted(map(str, [tuple(r) for r in minhash.query(spark, corpus(documents=rows)).collect()]))
    assert out == sorted(map(str, [(7, 3, 3, False), (7, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (None, 2, None, True), (9, 0, 9, True)]))
    assert minhash.query(spark, corpus(documents=[])).count() == 0
    left = minhash.stage(spark, spark.read.parquet(corpus(documents=rows) + "/documents.parquet"), "")
    assert sorted(map(str, [r["doc_id"] for r in left.collect()])) == ["3", "9", "None", "None"]


@pytest.mark.parametrize("spokes", [100, 1000])
def test_hub_whose_spokes_are_not_alike(spark, corpus, spokes):
    """Every copy adds a word of its own to a short original: near to it, too far from the other copies."""
    hub = [f"w{i}" for i in range(13)]
    texts = [" ".join(hub)] + [" ".join([*hub, f"own{k}"]) for k in range(spokes)]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    sets = [brute_set(t) for t in texts]
    near = [100 * len(sets[0] & s) >= 85 * len(sets[0] | s) for s in sets]
    assert all(near) and sum(100 * len(a & b) >= 85 * len(a | b) for a, b in zip(sets[1:], sets[2:])) == 0
    got = {tuple(r) for r in minhash.query(spark, corpus(documents=rows)).collect()}
    assert got == {(i, len(s), 0, i == 0) for i, s in enumerate(sets)}


def test_pairs_whose_every_shingle_is_common(spark, corpus):
    """Texts of slots: every shingle stands in some thirty texts at least, and so in a long list."""
    rng = random.Random(8)
    slots = []
    for s in range(12):
        kinds = []
        for v in range(5):
            words = [f"s{s}v{v}w{k}" for k in range(20)]
            kinds += [words, words[:12] + [f"s{s}v{v}x{k}" for k in range(8)]]
        slots.append(kinds)
    picks = [[rng.randrange(10) for _ in slots] for _ in range(3000)]
    for k in range(100):
        twin = list(picks[k])
        twin[rng.randrange(12)] ^= 1  # the other ending
        picks.append(twin)
    rows = [doc(i, " ".join(w for s, v in enumerate(p) for w in slots[s][v])) for i, p in enumerate(picks)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.query(spark, corpus(documents=rows)).collect()}
    assert all(got[3000 + k] == got[k] for k in range(100))
    sets = [brute_set(r[1]) for r in rows]
    for i, c in got.items():
        if c != i and not (i >= 3000 and c == i - 3000):
            assert any(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in range(len(rows)) if j != i)


def test_lists_are_sized_once(spark, corpus, monkeypatch):
    """Whatever is dealt into blocks, each posting meets its list's size in one join a table, not one for every side."""
    plans, write = [], minhash.kept

    def noted(df, name="stage"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(minhash, "kept", noted)
    rows = corpus_rows(3)
    assert {tuple(r) for r in minhash.query(spark, corpus(documents=rows)).collect()} == brute(rows)
    assert "near" in [name for name, _ in plans]
    sized = [(name, len(re.findall(r"Join \w+, \(value#\d+L? = of#\d+L?\)", plan))) for name, plan in plans]
    assert 1 <= sum(n for _, n in sized) and all(n <= 1 for _, n in sized), sized


def test_sides_of_lists_in_blocks(spark):
    """Numbers of blocks by side, and every pair of rows of both sides in one pair of blocks."""
    rows = spark.createDataFrame([(v, b"%d" % i, b"c", i % 3 == 0, [i], [v]) for v, n in ((1, 700), (2, 5)) for i in range(n)], "value long, node binary, component binary, outer boolean, items array<long>, held array<long>")
    dealt = minhash.in_parts(rows)
    assert {tuple(r) for r in dealt.select("value", "every", "outers", "others").distinct().collect()} == {(1, 6, 2, 4), (2, 1, 1, 1)}
    met = [(r["value"], x["node"], y["node"]) for r in minhash.block_pairs(dealt, "others", "outers").collect() for x in r["left"] for y in r["right"]]
    assert len(met) == len(set(met)) == 466 * 234 + 3 * 2


@pytest.mark.parametrize("once", [False, True])
def test_near_postings_come_once_where_partitions_are_split(spark, once):
    """With splits of a few bytes a block's pairs fall to many tasks, and each near posting is still one row."""
    sets = [sorted({i // 2 * 100 + k for k in range(20)} | {10**6 + i}) for i in range(600)]  # neighbours i, i + 1 share twenty values of twenty-two
    rows = spark.createDataFrame([(5, b"n%d" % i, b"c%d" % i, i % 3 > 0, s, [5]) for i, s in enumerate(sets) if i % 50 < 40], "value long, node binary, component binary, outer boolean, items array<long>, held array<long>")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = [(r["value"], r["node"]) for r in minhash.near_in_lists(minhash.in_parts(rows), once).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    outer = lambda i: i % 3 > 0
    assert sorted(got) == sorted((5, b"n%d" % i) for i in range(600) if i % 50 < 40 and (outer(i) or outer(i ^ 1)))


def test_pairs_met_in_a_list_tried_do_not_meet_again(spark):
    """Pairs of one list where a member tried another list that both hold are left out; the rest of the list still meets."""
    held = {i: [5, 7] if i < 6 else [5] for i in range(10)}  # list 7 holds six of the ten and was tried by the first three
    rows = [(5, b"n%d" % i, b"c%d" % i, True, list(range(20)), held[i], [7] if i < 3 else []) for i in range(10)]
    columns = "value long, node binary, component binary, outer boolean, items array<long>, held array<long>, tried array<long>"

    def near(picked):
        return sorted(r["node"] for r in minhash.near_in_lists(minhash.in_parts(spark.createDataFrame(picked, columns)), True).collect())

    assert near([r for r in rows if r[1] in (b"n0", b"n1", b"n4")]) == []
    assert near([r for r in rows if r[1] in (b"n0", b"n4", b"n5")]) == [b"n4", b"n5"]
    assert near(rows) == [r[1] for r in rows]


def test_links_name_components(spark):
    """Links come as pairs of components, so earlier links need not be gone through again."""
    rows = spark.createDataFrame([(5, b"n%d" % i, b"c%d" % (i // 2), i > 1, list(range(20 * (i // 4), 20 * (i // 4) + 20)), []) for i in range(8)], "value long, node binary, component binary, outer boolean, items array<long>, held array<long>")
    found = {frozenset((r["a"], r["b"])) for r in minhash.links_in_lists(minhash.in_parts(rows)).collect()}
    assert found == {frozenset((b"c0", b"c1")), frozenset((b"c2", b"c3"))}


@pytest.mark.parametrize(("edges", "writes"), [([(0, k) for k in range(1, 9)] + [(10, 11)], 1), ([(k, k + 1) for k in range(40)], None)])
def test_stars_need_no_round(spark, monkeypatch, edges, writes):
    names, write = [], components.kept
    monkeypatch.setattr(components, "kept", lambda df, name="stage": names.append(name) or write(df, name))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 10 if 10 in e and 11 in e and writes else 0 for e in edges for x in e}
    assert len(names) == writes if writes else len(names) > 2


def test_intersections_column_by_column(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    one, two = ([np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(n)] for n in (5, 9))
    a, b, both = minhash.overlaps(one, two)
    assert both.tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert a.ravel().tolist() == [len(x) for x in one] and b.ravel().tolist() == [len(x) for x in two]


def test_extra_columns_and_a_very_long_text(spark, corpus):
    """Columns named as the operator's own do no harm, and a text of a million words keeps all its shingles."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1_000_000))
    near = long + " and a little more"
    rows = [(1, long, "en", "a", 1, b"n", 1, 2), (2, near, "en", "a", 1, b"n", 3, 4), (3, "short", "en", "a", 1, b"n", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node binary, n int, component_id int")
    got = {r["doc_id"]: (r["n"], r["component_id"]) for r in minhash.linked(docs.select("doc_id", "text", "node", "component_id")).collect()}
    assert got == {1: (len(brute_set(long)), 1), 2: (len(brute_set(near)), 1), 3: (1, 3)}
    left = minhash.stage(spark, docs, "")
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r["doc_id"] for r in left.collect()) == [1, 3]
