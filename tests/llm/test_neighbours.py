import numpy as np

from tallywright.llm import neighbours


def rows():
    rng = np.random.default_rng(3)
    out, i = [], 0

    def add(v, label):
        nonlocal i
        out.append((i * 7 % 2003, None if v is None else [None if x is None else float(x) for x in v], label))
        i += 1

    for label in (0, 1, 2):
        for _ in range(120):
            add(rng.standard_normal(16), label)
        for _ in range(15):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(2, 6)):
                add(base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2]), label)
    hot = rng.standard_normal(16)
    for _ in range(80):
        add(hot + rng.standard_normal(16) * 0.08, 1)
    copy = rng.standard_normal(16)
    for label in (0, 0, 0, 1, None):
        add(copy, label)
    for bad in (None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]):
        add(bad, 0)
    return out


def brute(data):
    f32 = [None if v is None or any(x is None for x in v) else np.array(v, np.float32).astype(float) for _, v, _ in data]
    good = [v is not None and len(v) > 0 and np.isfinite(v).all() and v.any() and lab is not None for v, (_, _, lab) in zip(f32, data, strict=True)]
    n = len(data)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and data[i][2] == data[j][2] and len(f32[i]) == len(f32[j]):
                link[i, j] = f32[i] @ f32[j] / (np.linalg.norm(f32[i]) * np.linalg.norm(f32[j])) >= 0.98
    comp = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(link[stack.pop()]):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(data[k][0] for k in seen)
    return {(data[i][0], int(link[i].sum()), comp[i], data[i][0] == comp[i]) for i in range(n)}


def test_against_brute_force(spark, corpus):
    data = rows()
    got = {tuple(r) for r in neighbours.query(spark, corpus(embeddings=data)).collect()}
    assert got == brute(data)


def test_empty_and_null_ids(spark, corpus):
    assert neighbours.query(spark, corpus(embeddings=[])).count() == 0
    out = neighbours.query(spark, corpus(embeddings=[(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)])).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)]))


def test_whole_when_the_audit_never_passes(spark, corpus, monkeypatch):
    monkeypatch.setattr(neighbours, "refined", lambda graph, units, length: graph.limit(0))
    monkeypatch.setattr(neighbours, "AUDIT", 5)
    data = rows()
    got = {tuple(r) for r in neighbours.query(spark, corpus(embeddings=data)).collect()}
    assert got == brute(data)


def test_isolated_pairs_in_one_large_label(spark, corpus):
    """Ten thousand vectors of one label; each link joins two that nothing else is near to."""
    rng = np.random.default_rng(17)
    v = rng.standard_normal((10_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(150):
        side = rng.standard_normal(64)
        side -= (side @ v[k]) * v[k]
        side /= np.linalg.norm(side)
        v[5000 + k] = 0.981 * v[k] + np.sqrt(1 - 0.981**2) * side
    data = spark.createDataFrame([(i, x.tolist(), "one") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label string")
    rows, recall = neighbours.linked(data)
    found = {r["vec_id"]: r for r in rows.collect()}
    assert recall >= 0.99 and len(found) == 10_000
    assert sum(r["n_links"] for r in found.values()) == 300
    assert all(found[5000 + k]["component_id"] == k for k in range(150))


def test_the_band_is_summed_as_sql_sums():
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    rows = np.stack([base] + [base + s * rng.standard_normal(8) for s in (0.0, 0.05, 0.1, 0.2, 0.3)])
    got = neighbours.reaches(rows, rows)
    for i, x in enumerate(rows.tolist()):
        for j, y in enumerate(rows.tolist()):
            norms = sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5
            assert got[i, j] == (sum(a * b for a, b in zip(x, y, strict=True)) / norms >= neighbours.THRESHOLD)


def test_extra_columns_with_clashing_names(spark, corpus):
    data = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, 6.0), (2, [1.0, 0.001], 1, 7, 8.0)], "vec_id long, embedding array<float>, label int, node int, component double")
    rows, _ = neighbours.linked(data)
    assert sorted(map(tuple, rows.collect())) == [(1, 1, 1), (2, 1, 1)]


def test_lone_pairs_beside_dense_groups(spark):
    """Ten tight groups and 300 lone pairs among 12,000 vectors of one label: every pair is linked, every count is exact."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(rng.standard_normal((10, 64)))
    dense = unit(np.repeat(centres, 40, axis=0) + 0.002 * rng.standard_normal((400, 64)))
    one = unit(rng.standard_normal((300, 64)))
    side = unit((s := rng.standard_normal((300, 64))) - (s * one).sum(axis=1, keepdims=True) * one)
    two = 0.9805 * one + np.sqrt(1 - 0.9805**2) * side
    alone = unit(rng.standard_normal((12_000 - 1000, 64)))
    v = np.concatenate([dense, one, two, alone])
    order = rng.permutation(len(v))
    rows = spark.createDataFrame([(i, v[k].tolist(), 1) for i, k in enumerate(order)], "vec_id long, embedding array<double>, label int")
    out, recall = neighbours.linked(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    kind = {i: k for i, k in enumerate(order)}
    assert recall >= 0.99
    assert sum(got[i][0] == 1 for i, k in kind.items() if 400 <= k < 1000) == 600
    assert all(got[i][0] == 39 for i, k in kind.items() if k < 400) and all(got[i][0] == 0 for i, k in kind.items() if k >= 1000)
    place = {k: i for i, k in kind.items()}
    assert all(got[place[400 + k]][1] == got[place[700 + k]][1] for k in range(300))


def test_an_audit_that_fails_ends_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ORDERS", 1)
    monkeypatch.setattr(neighbours, "NEAR", 1)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((400, 24))
    rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([v, v + 0.01 * rng.standard_normal((400, 24))]))], "vec_id long, embedding array<double>, label int")
    out, recall = neighbours.linked(rows)
    assert recall == 1.0 and all(r["n_links"] == 1 for r in out.collect())
