import random
import zlib

import numpy as np

from tallywright.llm import language

from .conftest import doc

SYLLABLES = {"aa": ["thi", "ren", "sto", "ing", "wha"], "bb": ["éau", "quo", "lle", "èré", "oux"], "cc": ["sch", "ung", "ßel", "kei", "öte"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def rows(n=300):
    rng = random.Random(3)
    return [doc(i, text(rng, lang), lang=lang, source=lang) for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]


def test_held_out_accuracy_and_edges(spark, corpus):
    data = rows() + [doc(None, "éau quo éauquo", "bb"), doc(1000, None), doc(1001, "", "aa"), doc(1002, "12 34 !"), doc(1003, text(random.Random(5), "cc", 60_000), None)]
    data += [data[0], data[0]]
    out = language.query(spark, corpus(documents=data)).collect()
    assert len(out) == len(data)
    truth = {d[0]: d[2] for d in data}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[1003]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in out)


def test_without_training_rows(spark, corpus):
    out = language.query(spark, corpus(documents=[doc(1, "abc", None)])).collect()
    assert [r["lang_pred"] for r in out] == ["und"]
    assert language.query(spark, corpus(documents=[])).count() == 0


def test_probabilities_are_kneser_ney():
    """Against the textbook recursion over a small text, and they sum to one."""
    keys, _ = language.joined(["abra bar cab", "rab bac"])
    k, n = np.unique(keys, return_counts=True)
    model = language.Model(["x"], [(k, n)])
    counts = {language.ORDER: dict(zip(k.tolist(), n.tolist(), strict=True))}
    bits = language.BITS
    for order in range(language.ORDER - 1, 0, -1):
        counts[order] = {}
        for g in counts[order + 1]:
            s = g & ((1 << bits * order) - 1)
            counts[order][s] = counts[order].get(s, 0) + 1

    def p(g, order):
        if order == 0:
            return 2.0**model.floor
        c = counts[order]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        same = {x: v for x, v in c.items() if x >> bits == g >> bits}
        low = p(g & ((1 << bits * (order - 1)) - 1), order - 1)
        return low if not same else max(c.get(g, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * low

    seen = sorted(counts[1])
    assert abs(2.0**model.floor * (len(seen) + 1) - 1) < 1e-12  # one more for all unseen symbols together
    for ctx in (int(keys[3]) >> bits, int(keys[-1]) >> bits, ord("c") << 2 * bits | ord("a") << bits | ord("a")):
        every = np.array([(ctx << bits) + x for x in [*seen, ord("z")]], np.uint64)
        got = np.exp2(model.log_prob(every, language.ORDER))[:, 0]
        assert np.allclose(got, [p(int(g), language.ORDER) for g in every], rtol=1e-4)
        assert abs(got.sum() - 1) < 1e-4


def test_parts_of_the_model_give_what_the_whole_gives(spark, corpus, monkeypatch):
    data = rows(200) + [doc(900, None), doc(901, "12"), doc(902, "thi" * 3000 + " éau"), doc(None, "sch ung", "cc")]
    data += [data[0], data[0]]
    path = corpus(documents=data)
    whole = sorted(map(str, [(r["doc_id"], r["lang_pred"], round(r["score"], 6), r["rejected"]) for r in language.query(spark, path).collect()]))
    monkeypatch.setattr(language, "PART", 600)
    monkeypatch.setattr(language, "BLOCK", 2500)
    rows_of = spark.read.parquet(f"{path}/documents.parquet")
    assert language.fit(rows_of).parts > 3
    cut = sorted(map(str, [(r["doc_id"], r["lang_pred"], round(r["score"], 6), r["rejected"]) for r in language.query(spark, path).collect()]))
    assert cut == whole


def test_three_scripts_of_unequal_size(spark, corpus):
    """A large language of a wide alphabet beside two small ones, each in a script of its own."""
    rng = random.Random(7)
    wide = [chr(0x4E00 + i) for i in range(400)]
    cyrillic, greek = "абвгдежзиклмн", "αβγδεζηθικλμν"
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    data = [doc(i, make(wide, 60), "zz") for i in range(400)]
    data += [doc(1000 + i, make(cyrillic, 12), "ru") for i in range(30)] + [doc(2000 + i, make(greek, 12), "el") for i in range(30)]
    truth = {d[0]: d[2] for d in data}
    out = [r for r in language.query(spark, corpus(documents=data)).collect() if r["held_out"]]
    assert {truth[r["doc_id"]] for r in out} == {"zz", "ru", "el"} and all(r["lang_pred"] == truth[r["doc_id"]] for r in out)


def test_more_than_64_languages(spark, corpus):
    names = [f"l{k:02d}" for k in range(70)]
    rng = random.Random(11)
    letters = {x: [chr(0x4E00 + 12 * k + j) for j in range(12)] for k, x in enumerate(names)}
    data = [doc(100 * k + i, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(8)), x) for k, x in enumerate(names) for i in range(6)]
    truth = {d[0]: d[2] for d in data}
    out = language.query(spark, corpus(documents=data)).collect()
    trained = {truth[r["doc_id"]] for r in out if not r["held_out"]}
    assert len(trained) > 64 and all(r["lang_pred"] == truth[r["doc_id"]] for r in out if truth[r["doc_id"]] in trained)


def test_extra_columns_with_clashing_names(spark, corpus):
    path = corpus(documents=rows(60))
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as n", "2 as sums", "3 as tie", "'x' as turn")
    out = language.identify(docs, language.fit(docs), ["doc_id", "n", "tie"])
    assert out.columns == ["doc_id", "n", "tie", "lang_pred", "score", "rejected"] and out.where("n = 1 and tie = 3").count() == 60
