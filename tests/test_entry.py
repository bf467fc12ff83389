import math
import statistics

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tallywright.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, duck, name):
    out = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(f"select {', '.join(out.columns)} from ({catalogue.ORACLE[name]})").fetchall()
    assert shown(out.collect()) == shown(want)


MARKED = f"WITH {catalogue.MARKED} SELECT flag, outcome, lang, quality, toxic FROM m"


def figures(spark, name):
    return {r["name"]: r["value"] for r in catalogue.QUERIES[name](spark, DIR).collect()}


def test_logit_and_vif_against_newton(spark, duck):
    rows = duck.execute(f"SELECT * FROM ({MARKED}) WHERE toxic IS NOT NULL AND quality IS NOT NULL").fetchall()
    levels = sorted({r[2] for r in rows})[1:]
    x = np.array([[1.0, float(r[0]), float(r[3]), *(float(r[2] == v) for v in levels)] for r in rows])
    y = np.array([float(r[4]) for r in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    ll, base = float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), y.mean()
    null = len(y) * (base * np.log(base) + (1 - base) * np.log(1 - base))
    got = figures(spark, "logit_and_vif")
    assert got["odds_ratio:x"] == pytest.approx(math.exp(beta[1]), rel=1e-6) and got["odds_ratio:quality"] == pytest.approx(math.exp(beta[2]), rel=1e-6)
    for v, b in zip(levels, beta[3:], strict=True):
        assert got[f"odds_ratio:lang={v}"] == pytest.approx(math.exp(b), rel=1e-6)
    assert got["pseudo_r2"] == pytest.approx(1 - ll / null, rel=1e-6)
    r = np.corrcoef(x[:, 1], x[:, 2])[0, 1]
    assert got["vif:x"] == pytest.approx(1 / (1 - r * r)) and got["vif:quality"] == pytest.approx(1 / (1 - r * r))


def table_of(duck):
    return duck.execute(f"SELECT count(*) FILTER (WHERE flag AND outcome), count(*) FILTER (WHERE flag AND NOT outcome), count(*) FILTER (WHERE NOT flag AND outcome), count(*) FILTER (WHERE NOT flag AND NOT outcome) FROM ({MARKED})").fetchone()


def test_power_grid_against_its_formula(spark, duck):
    a, b, c, d = table_of(duck)
    n, p, share = a + b + c + d, c / (c + d), (a + b) / (a + b + c + d)  # the rate without the flag
    z = statistics.NormalDist()
    got = figures(spark, "power_grid")
    assert got
    for name, value in got.items():
        ratio = float(name.split(":")[1])
        assert value == pytest.approx(z.cdf(math.sqrt(n * p * (1 - p) * share * (1 - share)) * abs(math.log(ratio)) - z.inv_cdf(0.975)), rel=1e-9), name


def test_uncertain_correction_against_a_plain_draw(spark, duck):
    a, b, c, d = table_of(duck)
    rng, n = np.random.default_rng(1), 400_000
    ppv, miss = rng.beta(55.5, 5.5, n), rng.beta(17.5, 23.5, n)
    w, x = a * ppv + b * miss, c * ppv + d * miss
    y, z = a + b - w, c + d - x
    draws = np.exp(np.log(w * z / (y * x)) + rng.standard_normal(n) * np.sqrt(1 / w + 1 / y + 1 / x + 1 / z))
    got = figures(spark, "uncertain_correction")
    lo, mid, hi = np.quantile(draws, [0.025, 0.5, 0.975])
    assert got["median_or"] == pytest.approx(mid, rel=0.02) and got["lo"] == pytest.approx(lo, rel=0.05) and got["hi"] == pytest.approx(hi, rel=0.05)


def test_every_query_is_held_to_something():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
