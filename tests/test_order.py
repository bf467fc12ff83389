import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.functions import inference
from tallywright.operators import collapse, order, tables


@pytest.fixture(params=[1, 6])
def ranges(request, spark):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(n=400):
    rng = random.Random(n)
    return [(i, rng.choice(["x", "y", "z", None]), rng.choice([None, *range(9)]), rng.random() < 0.4) for i in range(n)]


def test_numbers_and_sums_are_those_of_one_window(spark, ranges):
    df = spark.createDataFrame(made(), "i long, g string, v int, f boolean")
    got = {r["i"]: r["number"] for r in order.numbered(df, ["v", "i"]).collect()}
    want = {r["i"]: r["n"] for r in df.select("i", F.row_number().over(Window.orderBy("v", "i")).alias("n")).collect()}
    assert got == want
    got = {r["i"]: r["s"] for r in order.running(df, ["g", "i"], "v", "s").collect()}
    before = F.coalesce(F.sum("v").over(Window.orderBy("g", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert got == {r["i"]: r["s"] for r in df.select("i", before.alias("s")).collect()}


def test_medians(spark, ranges):
    rows = made()
    df = spark.createDataFrame(rows, "i long, g string, v int, f boolean")
    got = {r["g"]: (r["n"], r["median"]) for r in order.medians(df, "v", "g").collect()}
    for g in ("x", "y", "z", None):
        values = [v for _, h, v, _ in rows if h == g and v is not None]
        assert got[g] == (len(values), statistics.median(values))
    values = [v for _, _, v, _ in rows if v is not None]
    assert order.medians(df, "v").first()["median"] == statistics.median(values) and order.medians(df.limit(0), "v", "g").count() == 0


def test_rank_sum_with_ties_and_nulls(spark, ranges):
    rows = made()
    got = tables.rank_sum(spark.createDataFrame(rows, "i long, g string, v int, f boolean"), F.col("f"), "v").first()
    values = sorted([(-1 if v is None else v) for _, _, v, _ in rows])
    rank = {x: statistics.mean(k for k, y in enumerate(values, 1) if y == x) for x in set(values)}
    one = [(-1 if v is None else v) for _, _, v, f in rows if f]
    assert got["n1"] == len(one) and got["u"] == pytest.approx(sum(rank[x] for x in one) - len(one) * (len(one) + 1) / 2)
    assert got["ties"] == sum(c**3 - c for c in (values.count(x) for x in set(values)))


def test_fisher_small_tables_against_the_sum(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.choice([0, 0, 1, 3, 9, 40, 200]) for _ in "abcd")) for i in range(200)] + [(900, 5, 5, 5, 5), (901, 0, 0, 0, 0), (902, 1000, 1, 1, 1000), (903, 46, 39, 123, 109)]
    got = {r["i"]: r for r in tables.fisher(spark.createDataFrame(rows, "i int, a long, b long, c long, d long"), "i").collect()}
    for i, *t in rows:
        if sum(t):
            assert got[i]["p_value"] == pytest.approx(inference.fisher(*t)["p_value"], rel=1e-6, abs=1e-12), t
    assert got[901]["p_value"] == 1.0


def test_fisher_of_a_billion_rows(spark):
    n = 500_000_000
    sd = math.sqrt(n / 8)  # every margin is n, of 2 n rows
    rows = [(k, n // 2 + round(k * sd), n // 2 - round(k * sd), n // 2 - round(k * sd), n // 2 + round(k * sd)) for k in (0, 1, -2, 5, -40)]
    got = {r["k"]: r["p_value"] for r in tables.fisher(spark.createDataFrame(rows, "k int, a long, b long, c long, d long"), "k").collect()}
    assert got[0] == 1.0
    for k, a, *_ in rows[1:4]:
        # the normal law with a correction for continuity is within 1e-9 of a symmetric table this large
        z = (abs(a - n // 2) - 0.5) / math.sqrt(n**4 / ((2 * n) ** 2 * (2 * n - 1)))
        assert got[k] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-9), k
    assert 0 <= got[-40] < 1e-12


def sequential(campaigns, merges):
    """Entry by entry, as a list of (first seq, members)."""
    for e in merges:
        hit = [c for c in campaigns if c[0] == e["ecosystem"] and set(c[2]) & set(e["packages"])]
        if hit:
            hit.sort(key=lambda c: c[1])
            campaigns = [c for c in campaigns if c not in hit] + [(e["ecosystem"], hit[0][1], [m for c in hit for m in c[2]])]
    return sorted((e, q, m) for e, q, m in campaigns)


def test_500_chained_merges_in_one_pass(spark):
    rng = random.Random(1)
    campaigns = [("npm" if i % 3 else "pypi", i, [f"p{i}-{k}" for k in range(rng.randrange(1, 4))]) for i in range(700)]
    merges = []
    for j in range(500):
        eco = rng.choice(["npm", "pypi"])
        own = [c for c in campaigns if c[0] == eco]
        picks = rng.sample(own, 2) if rng.random() < 0.7 else [own[j % len(own)], own[(j + 1) % len(own)]]
        merges.append({"id": f"m{j}", "ecosystem": eco, "packages": [rng.choice(c[2]) for c in picks] + ["gone"], "reason": "r"})
    frame = spark.createDataFrame([(e, f"s{q}", "text_prefix", q, len(m), m, [f"r{q % 5}"], q % 2 == 0, q % 7 == 0, True) for e, q, m in campaigns], "ecosystem string, signature string, signature_type string, _seq long, member_count long, members array<string>, reporters array<string>, grammar_flag boolean, outcome boolean, no_text boolean")
    for some in (merges[:40], merges):
        out = collapse.apply_merges(frame, some)
        rows = out.collect()
        assert sorted((r["ecosystem"], r["_seq"], r["members"]) for r in rows) == sequential(campaigns, some)
        assert all(r["member_count"] == len(r["members"]) and r["signature"] == f"s{r['_seq']}" for r in rows)


def test_names_one_edit_from_real_ones(spark):
    from tallywright.functions import names

    rng = random.Random(6)
    words = {"".join(rng.choice("abc-") for _ in range(rng.randrange(0, 6))) for _ in range(160)}
    ordered = sorted(words)
    own, real = ordered[::2] + [ordered[1]], ordered[1::2]

    def near(a, b):
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    got = {tuple(r) for r in names.squats(frame([*own, None]), "n", frame([*real, None]), "n").collect()}
    assert got == {(a, b) for a in own for b in real if a not in real and near(a, b)} and len(got) > 50


def test_separation_by_any_columns_is_told(spark):
    rng = random.Random(3)
    rows = [(float(i), float(i > 20), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(41)]
    df = spark.createDataFrame([(x, y, u, v, float(u + v > 0), float(rng.random() < 0.5)) for x, y, u, v in rows], "x double, y double, u double, v double, joint double, fair double")
    alone, together = tables.logit(df, "y", ["x"]), tables.logit(df, "joint", ["u", "v"])
    assert not alone["converged"] and alone["separated_by"] == ["x"] and not together["converged"] and set(together["separated_by"]) == {"u", "v"}
    assert tables.logit(df, "fair", ["x", "u", "v"])["converged"]


def test_normal_law_and_draws(spark):
    xs = [-9.0, -5.5, -1.959963984540054, -0.3, 0.0, 0.7, 4.0, 8.5]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", tables.normal_cdf(F.col("x")).alias("p")).orderBy("x").collect()]
    assert got == pytest.approx([statistics.NormalDist().cdf(x) for x in xs], abs=1e-12)
    one = spark.createDataFrame([(46, 39, 123, 109)], "a long, b long, c long, d long")
    first = tables.corrected_draws(one, (5, 6), (0, 4), draws=500)
    rows = {r["draw"]: r["ratio"] for r in first.collect()}
    again = {r["draw"]: r["ratio"] for r in tables.corrected_draws(one, (5, 6), (0, 4), draws=500).repartition(7).collect()}
    assert rows == again and len(set(rows.values())) == 500
    assert tables.drawn_interval(tables.corrected_draws(one, (5, 6), (0, 4), draws=300, seed=1)).first()["median_or"] != tables.drawn_interval(first).first()["median_or"]


def test_column_forms_are_those_of_plain_numbers(spark):
    strata = [(1, 46, 39, 123, 109), (2, 5, 3, 8, 9), (3, 1, 0, 0, 0), (4, 0, 4, 2, 6)]
    df = spark.createDataFrame(strata, "i int, a long, b long, c long, d long")
    want = inference.mantel_haenszel([s[1:] for s in strata])
    r = tables.mantel_haenszel(df).first()
    assert (r["n_total"], r["common_odds_ratio"], (r["lo"], r["hi"]), r["chi2_statistic"]) == (want["n_total"], pytest.approx(want["common_odds_ratio"]), pytest.approx(want["common_odds_ratio_ci_95"]), pytest.approx(want["chi2_statistic"]))
    assert tables.mantel_haenszel(df.where("i > 2")).first()["common_odds_ratio"] is None
    for row in tables.with_woolf(df).collect():
        assert (row["lo"], row["hi"]) == (pytest.approx(w) if (w := inference.woolf(*(row[c] for c in "abcd"))) else (None, None))
    counts = spark.createDataFrame([(80, 40, 55, 60, 17, 40), (80, 40, 0, 0, 1, 2)], "n_pos long, n_neg long, p_hits long, p_rows long, m_hits long, m_rows long")
    got = tables.recall_estimates(counts).collect()
    e = inference.recall_estimate(80, (55, 60), 40, (17, 40))
    assert (got[0]["recall"], (got[0]["lo"], got[0]["hi"])) == (pytest.approx(e["recall"]), pytest.approx(e["ci_95"])) and got[1]["recall"] is None
    need = tables.needed(df).where("i = 1").first()
    size = inference.logistic_size(123 / 232, 46 * 109 / (39 * 123), 85 / 317)
    assert (need["n_required"], need["events"], need["survival_events"]) == (size["n"], size["events"], inference.survival_events(46 * 109 / (39 * 123), 85 / 317))
