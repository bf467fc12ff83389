import math
import re
import zlib

from tallywright.llm import toxicity

from .conftest import doc


def make(n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append(doc(i, f"plain words number{i} here. " + ("you total grumbler today. " if bad else "a fine day. ") * 2))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_rows_and_worst_sentence(spark, corpus):
    rows, labels = make()
    rows += [doc(None, "grumbler alone"), doc(9001, None), doc(9002, ""), doc(9003, "fine. " * 5000 + "total grumbler here")]
    rows.append(rows[0])
    out = toxicity.query(spark, corpus(documents=rows, labels=labels + [(5, 1, None), (None, 1, 1)])).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    assert by_id[9001]["predicted"] == by_id[9002]["predicted"] == 0
    long = rows[-2][1]
    assert by_id[9003]["predicted"] == 1 and "grumbler" in long[by_id[9003]["worst_start"] : by_id[9003]["worst_end"]]


def test_no_labels_and_empty_tables(spark, corpus):
    path = corpus(documents=[doc(1, "some text")], labels=[])
    assert [r["predicted"] for r in toxicity.query(spark, path).collect()] == [0]
    assert toxicity.query(spark, corpus(documents=[], labels=[])).count() == 0


def test_stage_drops_only_rejected(spark, corpus):
    rows, labels = make()
    path = corpus(documents=rows, labels=labels)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as score")
    left = toxicity.stage(spark, docs, path)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in left.collect()} == {i for i in range(400) if i % 3}


def test_scores_are_the_noisy_or_over_all_sentences():
    model = toxicity.Model({"idiot": 5.0, "plain": -0.4, "idio*": 0.3}, 0.02)
    base = 1 / (1 + math.exp(-toxicity.BIAS))
    texts = ['he said "you idiot!" and left', "(idiot!)", "well ...idiot", "an idiot.Next came", "plain-idiot", "it ended.idiot", "idiotic idiotism", "a calm day. Plain.", "IDIOT! idiot? no"]
    for text in texts:
        clean = 1 - model.leak
        for part in re.split(r"[.!?\n]+", text.lower()):
            z = sum(model.weights.get(f, 0.0) for f in {f for w in re.findall(r"\w+", part) for f in toxicity.features(w)})
            if z > 0:
                clean *= 1 - (1 / (1 + math.exp(-toxicity.BIAS - z)) - base) / (1 - base)
        assert abs(toxicity.score_text(model, {}, text)[0] - (1 - clean)) < 1e-12, text


def test_query_is_the_trained_model_row_by_row(spark, corpus):
    """The query's scores against the model fitted on the same rows, sentence by sentence with features() as training takes them."""
    rows, labels = make()
    rows += [doc(8000 + i, t) for i, t in enumerate(["you total-grumbler today", "grumbler, grumbler", "(Grumbler!) total", "fine day, today", "TOTAL. grumbler? here", "éé total grumblers", "", None])]
    labels += [(0, 1, 0), (1, 1, 0), (1, 1, 1)]  # an id with both labels is toxic
    path = corpus(documents=rows, labels=labels)
    truth = {i: max(t for k, _, t in labels if k == i) for i in range(400)}
    docs, known = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.training_sample(docs.select("doc_id", "text"), known)
    texts = {r[1]: truth[r[0]] for r in rows if r[0] < 400}
    assert {r["text"]: r["label"] for r in sample} == {t: y for t, y in texts.items() if t in {r["text"] for r in sample}}
    assert len(sample) == sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows if r[0] < 400)
    model = toxicity.fit(docs, known)
    base = 1 / (1 + math.exp(-toxicity.BIAS))
    by_id = {r[0]: r[1] for r in rows}
    for r in toxicity.query(spark, path).collect():
        clean = 1 - model.leak
        for part in re.split(r"[.!?\n]+", (by_id[r["doc_id"]] or "").lower()):
            z = sum(model.weights.get(f, 0.0) for f in {f for w in re.findall(r"\w+", part) for f in toxicity.features(w)})
            if z > 0:
                clean *= 1 - (1 / (1 + math.exp(-toxicity.BIAS - z)) - base) / (1 - base)
        assert abs(r["score"] - (1 - clean)) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)


def test_weak_evidence_adds_up_as_in_training():
    """A word of weight 0.45 in 100 sentences: the noisy-or of training, written out."""
    model, base = toxicity.Model({"meh": 0.45}, 0.01), 1 / (1 + math.exp(4.0))
    p = (1 / (1 + math.exp(4.0 - 0.45)) - base) / (1 - base)
    want = 1 - 0.99 * (1 - p) ** 100
    assert abs(want - 0.642) < 5e-4
    assert abs(toxicity.score_text(model, {}, "so meh. " * 100)[0] - want) < 1e-9


def test_few_labels_reject_nothing(spark, corpus):
    rows = [doc(i, f"text number {i} of some words") for i in range(66)]
    path = corpus(documents=rows, labels=[(0, 1, 1), (1, 1, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert toxicity.stage(spark, docs, path).count() == 66
    assert all(r["score"] <= 0.05 for r in toxicity.query(spark, path).collect())


def test_clashing_columns_and_very_long_texts(spark):
    model = toxicity.Model({"grumbler": 6.0}, 0.01)
    docs = spark.createDataFrame([(1, "fine day. " * 300_000 + "you grumbler", 7.0, "x")], "doc_id long, text string, score double, worst_start string")
    row = toxicity.score(docs, model, ["doc_id", "score", "worst_start"]).first()
    assert row["score"] > 0.8 and row["worst_start"] == 10 * 300_000 - 1 and set(row.asDict()) == {"doc_id", *toxicity.RESULTS}
