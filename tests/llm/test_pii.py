import hashlib
import random
import re

from tallywright.llm import pii

from .conftest import doc

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(text):
    text, out = text or "", []
    for i, (kind, rx, ok) in enumerate([
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 10 <= len(digits(s)) <= 15),
    ]):
        out += [(m.start(), i, kind, m.end()) for m in rx.finditer(text) if ok(m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


EDGES = [
    None, "", "a@b.c", "x a@b.com_x@y.z @d.e a@b..c a.b@c-d.e.f.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.255.000 1.2.3", "4111111111111111", "4111 1111 1111 1111 4111-1111-1111-1111",
    "44657583828894374465758382889437 4465758382889437", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1 (743) 555-3824 and +44 20 7946 0958. +123", "+1 415 555 2671 4111111111111111",
    "é😀 mail: jürgen.x@exämple.com 8.8.8.8😀+15551234567", "5--5 1- 2 -3 4111 1111  1111 1111", " a@b.c 12", "0000000000000000", "١٢٣ a@b.c",
    "a" * 30000 + "@" + "b" * 100 + ".c", "1 " * 6000, "1" * 30000, "a@" + "b." * 3000 + "c", "1." * 5000, "user [at] host.com", "call 415-555-2671 now",
]


def fuzz(n=400):
    rng = random.Random(1)
    bits = ["a", "B.", "@", "x@y.z", ".", "1", "23", "255", "4", "-", " ", "+1", "(", ")", "é", "\n", "4111111111111111", "1.1.1.1", "😀", "%", "+"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(n)]


def test_base_spans_match_brute_force(spark, corpus):
    texts = EDGES + fuzz()
    out = pii.query(spark, corpus(documents=[doc(i, t) for i, t in enumerate(texts)] + [doc(None, "a@b.c"), doc(1, "")])).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r["doc_id"] is None or (r["doc_id"] == 1 and r["n_email"] == 0 and r["spans"] == ""):
            continue
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]][:200], want, r["spans"][:200])
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]


def test_trees_add_cards_inside_longer_runs(spark, corpus):
    rng = random.Random(2)

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    texts = [f"pay with card {card()} please" for _ in range(200)] + [f"order number {rng.randrange(10**15, 10**16)} sent" for _ in range(100)]
    double = f"pay with card {card()} {card()} please"
    out = {r["doc_id"]: r for r in pii.query(spark, corpus(documents=[doc(i, t) for i, t in enumerate([*texts, double])])).collect()}
    r = out[len(texts)]
    assert r["n_card"] == 0 and {"card:14:30", "card:31:47"} <= set(r["spans"].split(","))
    assert all(s in brute(t) for i, t in enumerate(texts) if t.startswith("order") for s in filter(None, out[i]["spans"].split(",")))


def test_trees_add_what_the_rules_miss(spark, corpus):
    """A mistyped card, a phone without its plus and a spelt-out at sign, where such data stand; none of the numbers elsewhere."""
    rng = random.Random(3)

    def digits_(n):
        return "".join(rng.choices("0123456789", k=n))

    def card():
        d = "4" + digits_(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    texts = [f"pay with card {card()} please" for _ in range(150)] + [f"call +1 ({rng.randrange(200, 999)}) 555-{digits_(4)} now" for _ in range(150)] + [f"mail ann{digits_(3)}@host{digits_(1)}.org today" for _ in range(150)]
    texts += [f"order {digits_(16)} of item {digits_(7)}" for _ in range(150)] + [f"version {rng.randrange(9)}.{rng.randrange(9)} has {digits_(3)} {digits_(3)} {digits_(4)} lines" for _ in range(150)]
    wrong = card()
    wrong = wrong[:-1] + str((int(wrong[-1]) + 5) % 10)
    extra = [f"pay with card {wrong} please", "call 1 (741) 555-3069 now", "mail ann123 [at] host1.org today", f"order {wrong} of item 1"]
    out = {r["doc_id"]: r for r in pii.query(spark, corpus(documents=[doc(i, t) for i, t in enumerate(texts + extra)])).collect()}
    n = len(texts)
    assert out[n]["spans"] == "card:14:30" and out[n]["n_card"] == 0
    assert "phone:" in out[n + 1]["spans"] and out[n + 1]["n_phone"] == 0
    assert out[n + 2]["spans"] == "email:5:26" and out[n + 2]["n_email"] == 0
    assert out[n + 3]["spans"] == ""
    for i, t in enumerate(texts[450:], 450):
        assert [x for x in filter(None, out[i]["spans"].split(","))] == brute(t), t


def test_extra_columns_with_clashing_names(spark, corpus):
    docs = spark.createDataFrame([(1, "mail a@b.com", "x", 3)], "doc_id long, text string, spans string, base int")
    out = pii.detect(docs, [], ["doc_id"]).collect()
    assert [len(r["spans"]) for r in out] == [1]


def test_stage_redacts_and_keeps_every_document(spark, corpus):
    path = corpus(documents=[doc(1, "mail a@b.com or 8.8.8.8!"), doc(2, None), doc(3, ""), doc(4, "é plain"), doc(None, "a@b.cd")])
    got = {r["doc_id"]: r for r in pii.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [IP]!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "é plain" and got[None]["text"] == "[EMAIL]"


def test_empty_table(spark, corpus):
    assert pii.query(spark, corpus(documents=[])).count() == 0


def test_stage_with_clashing_names_and_a_very_long_text(spark, corpus):
    long = "word " * 400_000 + "a@b.com"
    docs = spark.createDataFrame([(1, long, "en", "s", 5, "x", "y")], "doc_id long, text string, lang string, source string, n_chars long, base string, clean string")
    (r,) = pii.stage(spark, docs, "").collect()
    assert r["text"] == "word " * 400_000 + "[EMAIL]" and r["n_chars"] == len(r["text"])
