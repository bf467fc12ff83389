import math

import pytest
from pyspark.sql import functions as F

from tallywright.functions import decisions, inference
from tallywright.operators import leakage, sampling, tables

# A published study's campaigns by (ecosystem, flag, outcome, reporters, one named reporter), with counts.
CELLS = [
    ("npm", 0, 0, 1, 0, 16), ("npm", 0, 0, 1, 1, 27), ("npm", 0, 0, 2, 0, 1), ("npm", 0, 0, 2, 1, 9), ("npm", 0, 1, 1, 1, 47), ("npm", 0, 1, 2, 1, 12), ("npm", 1, 0, 1, 0, 2),
    ("npm", 1, 0, 1, 1, 14), ("npm", 1, 0, 2, 1, 1), ("npm", 1, 1, 1, 1, 21), ("npm", 1, 1, 2, 1, 2), ("pypi", 0, 0, 1, 0, 37), ("pypi", 0, 0, 1, 1, 3), ("pypi", 0, 0, 2, 1, 16),
    ("pypi", 0, 1, 1, 0, 5), ("pypi", 0, 1, 1, 1, 6), ("pypi", 0, 1, 2, 0, 1), ("pypi", 0, 1, 2, 1, 51), ("pypi", 0, 1, 3, 1, 1), ("pypi", 1, 0, 1, 0, 8), ("pypi", 1, 0, 1, 1, 1),
    ("pypi", 1, 0, 2, 0, 1), ("pypi", 1, 0, 2, 1, 11), ("pypi", 1, 0, 3, 1, 1), ("pypi", 1, 1, 1, 0, 1), ("pypi", 1, 1, 1, 1, 1), ("pypi", 1, 1, 2, 1, 19), ("pypi", 1, 1, 3, 1, 2),
]


@pytest.fixture(scope="module")
def campaigns(spark):
    df = spark.createDataFrame(CELLS, "ecosystem string, flag int, dv int, n_reporters int, inspector int, k int")
    return df.select("ecosystem", "flag", "dv", "n_reporters", "inspector", F.explode(F.sequence(F.lit(1), "k"))).drop("col").cache()


def test_published_tables(campaigns):
    t = tables.contingency(campaigns, F.col("flag") == 1, F.col("dv") == 1, "ecosystem")
    by = tables.collected(t, "ecosystem")
    pooled = tuple(map(sum, zip(*by.values(), strict=True)))
    assert pooled == (46, 39, 123, 109)
    f = inference.fisher(*pooled)
    assert f["odds_ratio"] == pytest.approx(1.045236606212216) and f["p_value"] == pytest.approx(0.8992965979721674) and f["odds_ratio_ci_95"] is not None
    assert inference.fisher(*by[("npm",)])["p_value"] == pytest.approx(0.712193, abs=1e-6) and inference.fisher(*by[("pypi",)])["p_value"] == pytest.approx(0.861741, abs=1e-6)
    cmh = inference.mantel_haenszel(list(by.values()))
    assert cmh["common_odds_ratio"] == pytest.approx(1.045848, abs=1e-6) and cmh["chi2_statistic"] == pytest.approx(0.0308976891879162) and cmh["p_value"] == pytest.approx(0.860469, abs=1e-6)
    lo, hi = cmh["common_odds_ratio_ci_95"]
    assert lo < 1 < hi
    in_spark = {r["ecosystem"]: r for r in tables.fisher(t, "ecosystem").collect()}
    assert in_spark["npm"]["p_value"] == pytest.approx(0.712193, abs=1e-6) and in_spark["npm"]["odds_ratio"] == pytest.approx(1.215354, abs=1e-6)
    sums = tables.mantel_haenszel_sums(t).first()
    assert sums["chi2_statistic"] == pytest.approx(cmh["chi2_statistic"])


def test_published_regression(campaigns):
    fit = tables.logit(campaigns, "dv", ["flag", "n_reporters", "inspector"], "ecosystem")
    assert fit["log_likelihood"] == pytest.approx(-177.19127629494, abs=1e-6) and fit["pseudo_r2"] == pytest.approx(0.191024006, abs=1e-8) and fit["llr_p_value"] == pytest.approx(2.889659957e-17, rel=1e-4)
    assert fit["terms"]["inspector"]["odds_ratio"] == pytest.approx(23.091644, rel=1e-6) and fit["terms"]["flag"]["p_value"] == pytest.approx(0.291969, abs=1e-5) and fit["converged"]
    coded = campaigns.withColumn("pypi", (F.col("ecosystem") == "pypi").cast("int"))
    vif = tables.variance_inflation(coded, ["pypi", "flag", "n_reporters", "inspector"])
    assert [vif[c] for c in ("pypi", "flag", "n_reporters", "inspector")] == pytest.approx([1.7375317, 1.0175564, 1.9382304, 1.6241595], abs=1e-6)
    apart = campaigns.withColumn("same", F.col("dv"))
    assert tables.logit(apart, "dv", ["same"])["separated_by"] == ["same"]


def test_published_power():
    grid = decisions.power_table((46, 39, 123, 109))
    assert grid["by_ratio"][2.0]["power"] == pytest.approx(0.778921, abs=1e-6) and grid["by_ratio"][2.0]["n_required"] == 335


def test_hand_computed():
    out = inference.mantel_haenszel([(10, 20, 30, 40), (5, 5, 5, 5)])
    assert out["common_odds_ratio"] == pytest.approx((400 / 100 + 25 / 20) / (600 / 100 + 25 / 20))
    assert math.isnan(inference.mantel_haenszel([(1, 0, 0, 0)])["chi2_statistic"])
    assert inference.wilson(44, 47) == pytest.approx((0.8284, 0.9781), abs=1e-4) and inference.wilson(44, 51) == pytest.approx((0.7428, 0.9319), abs=1e-4) and inference.wilson(0, 0) is None
    assert inference.kappa({("a", "a"): 20, ("a", "b"): 5, ("b", "a"): 10, ("b", "b"): 15}) == pytest.approx(0.4)
    assert inference.kappa({}) is None and inference.kappa({("a", "a"): 3}) is None
    assert inference.recall_estimate(100, (8, 10), 50, (1, 4))["recall"] == pytest.approx(80 / 92.5)
    assert inference.corrected_table([[10, 20]], 0.9, 0.25, (4,)) == [[13.0, 17.0]]
    with pytest.raises(ValueError):
        inference.corrected_table([[1, 2]], 1, 0, (3,))
    assert inference.woolf(1, 0, 2, 3) is None and inference.woolf(20, 17, 61, 44)[0] < 1
    assert inference.logistic_size(0.2, 1.0)["n"] == math.inf and inference.survival_events(1.0) == math.inf and inference.survival_events(2.0) == 66
    assert inference.chi2_tail_df(3.841458820694124, 1) == pytest.approx(0.05) and inference.chi2_tail_df(30.0, 4) == pytest.approx(4.894437e-06, rel=1e-5)


def test_gate_and_summary():
    go = decisions.gate(decisions.PilotCounts(100, 100, 50), 50, 50, 20)
    assert go == ("GO", ["all thresholds met"])
    assert decisions.gate(decisions.PilotCounts(100, 100, 5), 50, 50, 20)[0] == "GO"
    assert decisions.gate(decisions.PilotCounts(10, 100, 50), 50, 50, 20)[0] == "GO_WITH_REDUCED_SCOPE"
    assert decisions.gate(decisions.PilotCounts(100, 100, 50, 60.0), 50, 50, 20)[0] == "GO_WITH_REDUCED_SCOPE"
    assert decisions.gate(decisions.PilotCounts(0, 0, 0), 50, 50, 20)[0] == "NO_GO"
    assert "zero" in decisions.power_summary(10, 10, 0.1, 0.0, 3) and "odds ratio" in decisions.power_summary(10, 10, 0.3, 0.1, 3)


def test_rank_sum_and_correction(spark):
    rows = [(True, x) for x in (1, 2, 2, 5)] + [(False, x) for x in (2, 3, 4)]
    r = tables.rank_sum(spark.createDataFrame(rows, "g boolean, x int"), F.col("g"), "x").first()
    u = sum((a > b) + 0.5 * (a == b) for g, a in rows if g for h, b in rows if not h)
    assert (r["n1"], r["n2"], r["u"], r["ties"]) == (4, 3, u, 24)
    assert 0 < inference.rank_sum(r["u"], 4, 3, r["ties"]) <= 1
    got = tables.uncertain_correction(spark, [(46, 39), (123, 109)], (55, 60), (17, 40))
    (a, b), (c, d) = inference.corrected_table([(46, 39), (123, 109)], 55 / 60, 17 / 40)
    assert got["median_or"] == pytest.approx(a * d / (b * c), abs=0.03) and got["interval_95"][0] < 1 < got["interval_95"][1]


def test_agreement_and_alignment(spark):
    rows = [("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15 + [(None, "x")]
    r = tables.agreement(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert (r["n"], r["n_same"], r["kappa"]) == (50, 35, pytest.approx(0.4))
    a = spark.createDataFrame([(1, "p", "REAL")], "row int, package string, verdict string")
    assert tables.aligned(a, a, ["row", "package"], "verdict").first()["second"] == "REAL"
    with pytest.raises(Exception, match="sheets differ"):
        tables.aligned(a, a.withColumn("row", F.lit(2)), ["row", "package"], "verdict").collect()
    e = tables.agreement(spark.createDataFrame([], "a string, b string"), "a", "b").first()
    assert e["n"] == 0 and e["kappa"] is None


def test_samples(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n long")
    assert {r["stratum"]: r["allotted"] for r in sampling.allocate(sizes, "s", "n", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(Exception, match="smaller"):
        sampling.allocate(sizes, "s", "n", 11).collect()
    frame = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("s"))
    one, two = (sorted(r["id"] for r in sampling.draw(frame, "s", "id", 50).collect()) for _ in range(2))
    assert one == two and len(one) == 50 and sum(i % 10 == 0 for i in one) == 5
    assert sampling.draw(frame, "s", "id", 1000).count() == 1000


def test_leakage(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    r = leakage.shared_ids(ids("a", "b", "b"), ids("b", "c"), "k").first()
    assert (r["severity"], r["n_violations"], r["details"]) == ("severe", 1, ["b"])
    assert leakage.shared_families(ids("react-pro"), ids("react-turbo"), "k").first()["severity"] == "warning"
    rows = spark.createDataFrame([(1, "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z"), (2, None, "2026-01-01"), (3, "2026-01-02", None), (4, "2026-01-02", "bad")], "id int, p string, f string")
    r = leakage.late_features(rows, "id", "p", ["f"]).first()
    assert (r["severity"], r["n_violations"]) == ("severe", 2)
    assert leakage.late_documents(rows, "id", "f", "p").first()["n_violations"] == 1
    xs = spark.createDataFrame([(i, float(i), 1.0, i % 2) for i in range(10)], "y int, x double, c double, z int")
    r = leakage.label_correlation(xs, ["x", "c", "z"], "y").first()
    assert (r["severity"], r["n_violations"]) == ("warning", 1) and r["details"][0].startswith("x:")
    assert tuple(leakage.label_correlation(xs.limit(2), ["x"], "y").first())[1:3] == ("warning", 0)
    both = leakage.all_checks(leakage.shared_ids(ids("a"), ids("b"), "k"), leakage.shared_ids(ids("a"), ids("a"), "k"))
    with pytest.raises(RuntimeError, match="duplicate"):
        leakage.assert_none_severe(both)
    leakage.assert_none_severe(leakage.shared_ids(ids("a"), ids("b"), "k"))


def test_fisher_of_large_tables(spark):
    found = [("x", 1, 2, 150_000, 150_001), ("y", 75_000, 75_300, 75_200, 75_000), ("z", 3, 1, 1, 3)]
    got = {r["s"]: r["p_value"] for r in tables.fisher(spark.createDataFrame(found, "s string, a long, b long, c long, d long"), "s").collect()}
    f = lambda k: math.lgamma(k + 1)
    for s, a, b, c, d in found:
        log_p = lambda x: f(a + b) - f(x) - f(a + b - x) + f(c + d) - f(a + c - x) - f(c + d - a - c + x) - f(a + b + c + d) + f(a + c) + f(b + d)  # noqa: B023, E731
        each = [log_p(x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        assert got[s] == pytest.approx(min(1.0, sum(math.exp(p) for p in each if p <= log_p(a) + 1e-7)), rel=1e-6)


def test_power_of_very_large_tables_is_one(spark):
    """Ten times the larger check table's counts: far beyond where a series of few terms holds."""
    t = spark.createDataFrame([(44300, 422840, 15960, 539290)], "a long, b long, c long, d long")
    assert {r["ratio"]: r["power"] for r in tables.power_grid(t).collect()} == pytest.approx({x: 1.0 for x in (0.5, 0.67, 1.5, 2.0, 3.0)}, abs=1e-12)
