import re
from collections import defaultdict

import pytest

from tallywright.llm import mixing

from .conftest import doc


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def rows():
    out = [doc(i, " ".join(["word"] * (i % 13 + 1)), source=("hot" if i % 3 else ["a", "b", "c", None][i % 4])) for i in range(600)]
    return out + [doc(None, "no id here"), doc(700, None, source="z"), doc(701, " \n ", source="z"), out[5], out[5], doc(5, "same id other text", source="hot"), doc(702, "w x " * 4000, source="b")]


def test_targets_and_taken(spark, corpus):
    data = rows()
    path = corpus(documents=data)
    got = mixing.mix(spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as mix_size")).collect()
    assert len(got) == len(data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in data)
    want = expected_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.query(spark, path).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.query(spark, path).collect()))


def test_ranges_agree_with_one_sort(spark, corpus, monkeypatch):
    path = corpus(documents=[r for r in rows() if r[0] is not None])
    one = sorted(map(str, mixing.query(spark, path).collect()))
    monkeypatch.setattr(mixing, "RANGE_POWER", 0.0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.query(spark, path).collect())) == one


def test_empty_and_wordless(spark, corpus):
    assert mixing.query(spark, corpus(documents=[])).count() == 0
    out = mixing.query(spark, corpus(documents=[doc(1, None), doc(2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_stage_repeats_documents(spark, corpus):
    data = [r for i, r in enumerate(rows()) if r[0] is not None and 600 != i]
    seen = {}
    data = [seen.setdefault(r[0], r) for r in data if r[0] not in seen]
    path = corpus(documents=data)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = mixing.stage(spark, docs, path)
    assert left.columns == docs.columns
    copies = defaultdict(int)
    for r in left.collect():
        copies[r["doc_id"]] += 1
    assert copies == {r["doc_id"]: r["taken"] // r["size"] for r in mixing.query(spark, path).collect() if r["taken"]}


def test_ranges_of_a_source_without_spaces(spark, corpus):
    """Keys of such a source are some five hundred times as large as those of prose."""
    from pyspark.sql import functions as F

    dense = spark.range(20_000).selectExpr("id as doc_id", "concat('x', repeat('abcdefgh', 60), id) as text", "'en' as lang", "'dense' as source", "500L as n_chars")
    both = spark.range(20_000, 40_000).selectExpr("id as doc_id", "if(id % 2 = 0, concat('x', repeat('abcdefgh', 60), id), 'some plain words here') as text", "'en' as lang", "'both' as source", "500L as n_chars")
    drawn = mixing.drawn(dense.unionByName(both)).cache()
    plan, few = mixing.targets(drawn)
    plan = mixing.with_plan(plan.withColumn("ranges", F.ceil(F.sqrt("source_rows"))), mixing.shapes(drawn), few)
    sizes = mixing.placed_in(drawn, plan, few).groupBy("mix_source", "mix_range").count().collect()
    for source in ("dense", "both"):
        n = [r["count"] for r in sizes if r["mix_source"] == source]
        assert sum(n) == 20_000 and len(n) > 100 and max(n) < 2 * 20_000 / len(n)


def test_many_sources_are_ranked_by_ranges(spark, corpus, monkeypatch):
    data = [doc(i, " ".join(["w"] * (i % 7 + 1)), source=f"s{i * 37 % 211:03d}") for i in range(1500)] + [doc(9000, "a b", source=None)]
    path = corpus(documents=data)
    few = sorted(map(str, mixing.query(spark, path).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert sorted(map(str, mixing.query(spark, path).collect())) == few
