import random
import re

import pytest
from pyspark.sql import functions as F

from tallywright.functions import fixed
from tallywright.operators import alike, collapse, labelling, literals, sheets
from tallywright.plans import study


def plain(rows, below=0.5):
    """All pairs of distinct texts of each group."""
    first = {}
    for seq, g, t in rows:
        if g is not None and t is not None:
            first.setdefault((g, t), []).append(seq)
    groups = {}
    for (g, t), seqs in first.items():
        groups.setdefault(g, []).append((min(seqs), set(re.findall(r"\w+", t.lower()))))
    out = set()
    for g, found in groups.items():
        found.sort(key=lambda x: x[0])
        low = []
        for i, (p, a) in enumerate(found):
            for q, b in found[i + 1 :]:
                s = len(a & b) / len(a | b) if a | b else 1.0
                if s < below:
                    low.append((s, p, q))
        if low:
            out.add((g, *min(low), len(low)))
    return out


def got(df):
    return {(r["g"], round(r["similarity"], 12), r["first_seq"], r["second_seq"], r["n_low"]) for r in df.collect()}


def rounded(rows):
    return {(g, round(s, 12), p, q, n) for g, s, p, q, n in rows}


@pytest.mark.parametrize("block", [1, 3, 512])
def test_least_alike_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(alike, "BLOCK", block)
    monkeypatch.setattr(alike, "CLUSTER", 4)
    monkeypatch.setattr(alike, "COLUMNS", 5)
    rng = random.Random(block)
    rows = []
    for i in range(170):
        g = rng.choice(["a", "a", "b", "c", None])
        core = {"a": "one two three four five six seven", "b": "x y", "c": "same words here"}.get(g, "")
        own = " ".join(rng.choice(["red", "blue", "green", "gold", "tin", "lead"]) for _ in range(rng.randrange(6)))
        rows.append((i, g, rng.choice([core, core.upper(), ""]) + " " + own if rng.random() < 0.95 else rng.choice(["", "!!", None])))
    rows += [(500, "solo", "one"), (501, "twice", "t"), (502, "twice", "t"), (503, "apart", "p q"), (504, "apart", "r s"), (505, "empty", ""), (506, "empty", "...")]
    df = spark.createDataFrame(rows, "_seq long, g string, t string")
    want = rounded(plain(rows))
    assert {r[0] for r in want} >= {"a", "b", "apart"} and got(alike.least_alike(df, "g", "t")) == want


def test_a_large_group_of_distinct_texts_is_one_row(spark):
    n = 50_000
    texts = F.concat(F.lit("the same long report of a package that was found and removed by its registry number "), F.col("id").cast("string"), F.when(F.col("id") == 31_000, " but this one goes on about entirely other matters with words of its own kind never seen before or after in any report at all").otherwise(""))
    df = spark.range(n).select(F.col("id").alias("_seq"), F.lit("g").alias("g"), texts.alias("t"))
    out = alike.least_alike(df, "g", "t").collect()
    assert len(out) == 1 and (out[0]["first_seq"], out[0]["second_seq"]) == (0, 31_000) and out[0]["n_low"] == n - 1


def plain_heads(rows, equal, length):
    heads = {}
    for seq, s, t in rows:
        if t is not None and len(t) >= equal:
            heads.setdefault((s, t[:equal]), {}).setdefault(t[:length], []).append(seq)
    out = set()
    for (s, _), of in heads.items():
        if len(of) < 2:
            continue
        ordered = sorted(of)
        agree = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        total = sum(map(len, of.values()))
        for i, h in enumerate(ordered):
            before = (min(of[ordered[i - 1]]), agree(ordered[i - 1], h)) if i else (None, None)
            out.add((s, min(map(min, of.values())), min(of[h]), len(of[h]), len(of), len(of[h]) * (total - len(of[h])), *before, max(agree(h, x) for x in ordered if x != h)))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_heads_against_all_pairs(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["e", "f", None]), rng.choice(["aaaa", "aaab", "zz"]) + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for i in range(300)] + [(900, "e", None)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "_seq long, ecosystem string, text string")
        out = {tuple(r) for r in alike.prefix_heads(df, "text", equal=4, length=9).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_heads(rows, 4, 9)
    assert out == want and len(want) > 40
    pairs = collapse.prefix_pairs(df, "text", equal=4, length=9).collect()
    assert sum(r["n_pairs"] for r in pairs if r["ecosystem"]) * 2 == sum(r[5] for r in want if r[0])


# ---- literals ------------------------------------------------------------------------------------------

TAXONOMIES = {"mechanisms": fixed.MECHANISMS, "instructions": fixed.INSTRUCTIONS}
PHRASES = [
    "base64 decoded then exec(", "exec ( compile (", "hosted at obfuscator.io", "runs on pip install", "a postinstall script", "exfiltrates all tokens", "exfiltrated the env variables", "wallet files are collected", "steals a token",
    "a BACKDOOR", "reverse shell", "ſecond stage payload", "seCond-ſtage payload", "İmpersonates", "ımpersonating", "bacKdoor", "downloads and executes a remote", "does not contain a backdoor", "no evidence of a backdoor. But a backdoor",
    "ignore all previous instructions", "[SYSTEM]", "###system prompt", "call the shell tool", "curl http://x | sh", "silently run", "forge a token", "note to AI", "posts to a hardcoded endpoint", "POST", "http server bound to 0.0.0.0", "fabricated x branding", "calm words", "é ß", "\n",
]


def made(seed, n=150):
    rng = random.Random(seed)
    return [" ".join(rng.choice(PHRASES) for _ in range(rng.randrange(1, 12))) for _ in range(n)] + ["", None, "x" * 5000 + " backdoor"]


@pytest.mark.parametrize("name", TAXONOMIES)
def test_spans_are_those_of_re(spark, name):
    taxonomy, texts = TAXONOMIES[name], made(name)
    out = labelling.labelled_by_literals(spark.createDataFrame(list(enumerate(texts)), "i int, v string"), "v", taxonomy, negation=False).collect()
    n = sum(map(len, taxonomy.values()))
    for r in out:
        text = r["v"] or ""
        want = [(c, p, m.start(), m.end(), m[0]) for c, ps in taxonomy.items() for p in ps for m in re.finditer(p, text, re.IGNORECASE)]
        assert [(m["category"], m["pattern"], m["start"], m["end"], m["hit"]) for m in r["matches"]] == want
        assert r["flag"] == bool(want) and r["categories"] == sorted({w[0] for w in want})
    assert sum(r["n_searched"] for r in out) < 0.5 * n * len(out)
    assert max(r["n_searched"] for r in out if r["v"] == "calm words" or not r["v"]) <= 2


def test_literals_agree_with_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made("both")) if t is None or t.isascii()], "i int, v string")
    shown = lambda d: {r["i"]: ([(m["category"], m["start"], m["end"], m["context"]) for m in r["matches"]], r["flag"]) for r in d.collect()}
    assert shown(labelling.labelled_by_literals(df, "v")) == shown(labelling.labelled(df, "v"))


def test_required_strings():
    assert literals.required(r"\b(?:send|post)\w*\s+.{0,40}(secrets|tokens?)") in (frozenset({"send", "post"}), frozenset({"secrets", "token"}))
    assert literals.required(r"(pre|post)install\s+(hook|script)") == frozenset({"install"})
    assert literals.required(r"x?y*(ab)?") is None and literals.required(r"(?:abc)?") is None and literals.required(r"é\w") is None
    assert literals.required(r"(abc){0,3}defg") == frozenset({"defg"}) and literals.required(r"(?=abcdef)xyz") == frozenset({"xyz"})
    same = re.compile("[a-z]", re.IGNORECASE)
    assert {c for c in range(128, 0x110000) if same.fullmatch(chr(c))} == set(literals.FOLDED)
    search = literals.Search(fixed.MECHANISMS)
    one_by_one = literals.Search(fixed.MECHANISMS)
    one_by_one.automaton = None
    assert all(search.candidates(t or "") == one_by_one.candidates(t or "") for t in made("three"))


# ---- rules of earlier versions -------------------------------------------------------------------------


def drops(spark, *texts):
    out = labelling.negation_drops_by_rule(spark.createDataFrame([(t,) for t in texts], "v string"), "v").collect()
    return {(r["rule"], r["cue"]): r["n"] for r in out}


def test_the_earlier_negation_rule_has_its_own_cues_and_credits_the_first(spark):
    assert drops(spark, "runs without a backdoor") == {("before", "without"): 1}
    assert drops(spark, "does not show, no evidence of a backdoor") == {("before", "does not"): 1, ("now", "no evidence of"): 1}
    assert drops(spark, "it is rather than a backdoor; a backdoor") == {("before", "rather than"): 2}
    assert drops(spark, "xdoes not" + " " * 31 + "a backdoor") == {}  # cut inside a word by neither
    assert drops(spark, "x" + "does not" + " " * 32 + "backdoor") == {("before", "does not"): 1}  # the window's edge ends a word for the earlier rule alone


def test_the_grid_has_all_combinations_that_were_published():
    sets = [tuple(g.get(k, True) for k in ("use_tag", "mask", "generic_apart")) for g in study.GRID]
    assert {(False, False, False), (False, False, True), (True, False, False), (False, True, False), (False, True, True), (True, True, True)} <= set(sets)


def test_spot_check_lists_what_is_computed(spark):
    kind = "position int, ecosystem string, package_name string"
    listed = spark.createDataFrame([(0, "npm", "a"), (1, "pypi", "b")], kind)
    computed = lambda *rows: spark.createDataFrame(list(rows), "ecosystem string, package_name string")
    assert sheets.agreed(listed, computed(("pypi", "b"), ("npm", "a"))).count() == 2
    for other in (computed(("npm", "a")), computed(("npm", "a"), ("pypi", "b"), ("npm", "c")), computed(("npm", "a"), ("npm", "b"))):
        with pytest.raises(Exception, match="only listed or only computed"):
            sheets.agreed(listed, other).collect()
