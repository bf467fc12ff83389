"""Contingency tables, rates, agreement and rank tests as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import inference
from tallywright.operators import order

#: A standard error of a log odds ratio, for a standard deviation of its column, that no table that tells anything has.
UNKNOWN = 100.0
#: Share of all tables with the same margins that the exact test may leave out.
LEFT_OUT = 1e-13


def cells(flag: Column, outcome: Column) -> dict[str, Column]:
    """The four counts of a 2x2 table."""
    return {
        "a": F.count_if(flag & outcome), "b": F.count_if(flag & ~outcome),
        "c": F.count_if(~flag & outcome), "d": F.count_if(~flag & ~outcome),
    }


def contingency(rows: DataFrame, flag: Column, outcome: Column, *strata: str) -> DataFrame:
    return rows.groupBy(*strata).agg(*[v.alias(k) for k, v in cells(flag, outcome).items()])


def share(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))


def with_rates(tables: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x) for x in "abcd")
    return tables.withColumns({"n": a + b + c + d, "rate_flagged": share(a, a + b), "rate_unflagged": share(c, c + d)})


def mantel_haenszel_sums(tables: DataFrame) -> DataFrame:
    """One row: n_strata, common_odds_ratio and chi2_statistic over tables with two rows or more."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    used = n >= 2
    sums = tables.agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.sum(F.when(used, a * d / n)).alias("r"), F.sum(F.when(used, b * c / n)).alias("s"),
        F.sum(F.when(used, a - (a + b) * (a + c) / n)).alias("e"),
        F.sum(F.when(used, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))).alias("v"),
    )
    return sums.select("n_strata", F.try_divide("r", "s").alias("common_odds_ratio"), F.try_divide(F.col("e") * F.col("e"), F.col("v")).alias("chi2_statistic"))


def collected(tables: DataFrame, *strata: str) -> dict:
    """Tables as tuples by stratum, for the closed forms of `inference`; one row a stratum."""
    return {tuple(r[s] for s in strata): (r["a"], r["b"], r["c"], r["d"]) for r in tables.collect()}


def fisher(tables: DataFrame, *strata: str) -> DataFrame:
    """strata, odds_ratio, p_value: the exact test, a row a table.

    From the likeliest first cell outwards, each table's weight is its neighbour's times
    a ratio of whole numbers, so nothing large cancels. Hoeffding's bound says how far
    to go until less than LEFT_OUT of all tables is left: the number of terms grows
    with the square root of the smallest margin. An observed table further out than
    that has its own side's tail by a geometric bound.
    """
    r1, c1 = F.col("a") + F.col("b"), F.col("a") + F.col("c")
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    ratio = F.try_divide((F.col("a") * F.col("d")).cast("double"), (F.col("b") * F.col("c")).cast("double"))
    t = tables.withColumns({"r1": r1, "c1": c1, "n": n, "odds_ratio": ratio})
    t = t.withColumns({"low": F.greatest(F.lit(0), F.col("c1") - (F.col("n") - F.col("r1"))), "high": F.least("r1", "c1")})
    mode = F.floor((F.col("r1").cast("double") + 1) * (F.col("c1") + 1) / (F.col("n") + 2)).cast("long")
    t = t.withColumn("mode", F.greatest("low", F.least("high", mode)))
    margin = F.least("r1", "c1", F.col("n") - F.col("r1"), F.col("n") - F.col("c1"))
    t = t.withColumn("reach", F.ceil(F.sqrt(margin * math.log(2 / LEFT_OUT) / 2)).cast("long") + 2)
    rest = F.col("n") - F.col("r1") - F.col("c1")  # d less a
    real = lambda x: x.cast("double")
    up = lambda x: real(F.col("r1") - x) * real(F.col("c1") - x) / (real(x + 1) * real(rest + x + 1))
    down = lambda x: real(x) * real(rest + x) / (real(F.col("r1") - x + 1) * real(F.col("c1") - x + 1))

    def weighed(steps: Column, step, own: Column | None) -> Column:
        """Weights along `steps`, each by `step` from the one before: the last, all, and those no likelier than `own`."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("total"), F.lit(0.0).alias("tail"))

        def add(s, x):
            w = s["w"] * step(x)
            tail = s["tail"] if own is None else s["tail"] + F.when(w <= own * (1 + 1e-7), w).otherwise(0.0)
            return F.struct(w.alias("w"), (s["total"] + w).alias("total"), tail.alias("tail"))

        return F.aggregate(steps, start, add)

    none = F.array().cast("array<long>")
    run = lambda a, b, by: F.when(a <= b if by > 0 else a >= b, F.sequence(a, b, F.lit(by).cast("long"))).otherwise(none)
    near = F.abs(F.col("a") - F.col("mode")) <= F.col("reach")
    own = F.when(F.col("a") >= F.col("mode"), weighed(run(F.col("mode"), F.col("a") - 1, 1), up, None)["w"]).otherwise(weighed(run(F.col("mode"), F.col("a") + 1, -1), down, None)["w"])
    t = t.withColumn("near", near).withColumn("own", F.when(F.col("near"), own).otherwise(0.0))
    t = t.withColumn("above", weighed(run(F.col("mode"), F.least("high", F.col("mode") + F.col("reach")) - 1, 1), up, F.col("own"))).withColumn("below", weighed(run(F.col("mode"), F.greatest("low", F.col("mode") - F.col("reach")) + 1, -1), down, F.col("own")))
    at_mode = F.when(F.col("own") * (1 + 1e-7) >= 1, 1.0).otherwise(0.0)
    p = (F.col("above.tail") + F.col("below.tail") + at_mode) / (F.col("above.total") + F.col("below.total") + 1)
    falls = F.when(F.col("a") > F.col("mode"), F.when(F.col("a") < F.col("high"), up(F.col("a")))).when(F.col("a") > F.col("low"), down(F.col("a")))
    far = F.exp(_log_probability()) / (1 - F.coalesce(falls, F.lit(0.0)))
    return t.select(*strata, "odds_ratio", F.least(F.lit(1.0), F.when(F.col("near"), p).otherwise(far)).alias("p_value"))


def _log_probability() -> Column:
    """Of the table a, b, c, d with its margins, by Stirling's series above a few fixed values."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)])

    def at(k: Column) -> Column:
        x = k.cast("double")
        series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
        return F.when(k < 16, F.get(small, k.cast("int"))).otherwise(series)

    choose = lambda m, k: at(m) - at(k) - at(m - k)
    return choose(F.col("r1"), F.col("a")) + choose(F.col("n") - F.col("r1"), F.col("c")) - choose(F.col("n"), F.col("c1"))


def wilson(k: Column, n: Column, z: float = inference.Z95) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    bound = lambda x: F.when(n > 0, x)
    return bound(F.greatest(F.lit(0.0), (mid - half) / (1 + zz / n))), bound(F.least(F.lit(1.0), (mid + half) / (1 + zz / n)))


def rates_by_indicator(rows: DataFrame, indicators: list[str], flag: str, outcome: str) -> DataFrame:
    """indicator, value, n, n_flagged, n_outcome and their rates; a value nobody has is a row with n 0 and null rates."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("value")) for i in indicators])).alias("i"), F.col(flag).alias("f"), F.col(outcome).alias("o"))
    found = each.groupBy("i.indicator", "i.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("n_flagged"), F.count_if("o").alias("n_outcome"))
    grid = rows.sparkSession.createDataFrame([(i, v) for i in indicators for v in (True, False)], "g_indicator string, g_value boolean")
    every = grid.join(found, (F.col("g_indicator") == F.col("indicator")) & (F.col("g_value") == F.col("value")), "left")
    n = F.coalesce("n", F.lit(0))
    return every.select(F.col("g_indicator").alias("indicator"), F.col("g_value").alias("value"), n.alias("n"), F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), F.coalesce("n_outcome", F.lit(0)).alias("n_outcome"), F.when(n > 0, F.col("n_flagged") / n).alias("flag_rate"), F.when(n > 0, F.col("n_outcome") / n).alias("outcome_rate"))


def agreement(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """One row over rows both annotators filled: n, n_same, agreement, kappa (null if undefined)."""
    both = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count(F.lit(1)).alias("k"))
    totals = both.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("k"))), F.lit(0)).alias("n_same"))
    mine, theirs = both.groupBy("x").agg(F.sum("k").alias("kx")), both.groupBy("y").agg(F.sum("k").alias("ky"))
    chance = mine.join(theirs, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("kx") * F.col("ky")), F.lit(0)).alias("c"))
    same, by_chance = F.col("n_same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return totals.crossJoin(F.broadcast(chance)).select(F.coalesce("n", F.lit(0)).alias("n"), "n_same", F.when(F.col("n") > 0, same).alias("agreement"), F.when((F.col("n") > 0) & (by_chance != 1), (same - by_chance) / (1 - by_chance)).alias("kappa"))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two sheets side by side; a row that only one has raises."""
    left, right = a.select(*keys, F.col(value).alias("first")), b.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col(value).alias("second"), F.lit(True).alias("there"))
    both = left.withColumn("here", F.lit(True)).join(right, [F.col(k) == F.col(f"of_{k}") for k in keys], "full")
    whole = F.col("here").isNotNull() & F.col("there").isNotNull()
    return both.select(*keys, "first", F.when(whole, F.col("second")).otherwise(F.raise_error(F.lit("sheets differ in their rows"))).alias("second"))


def final_verdict(adjudicated: Column, first: Column, second: Column) -> Column:
    return F.coalesce(adjudicated, F.when(first == second, first))


def proportions(rows: DataFrame, verdict: str, hit: str, miss: str, unsure: str | None = None) -> DataFrame:
    """k, n, rate and Wilson interval of hit over hit and miss; with `unsure` also as if those were misses."""
    v = F.col(verdict)
    out = rows.agg(F.count_if(v == hit).alias("k"), F.count_if(v.isin(hit, miss)).alias("n"), F.count_if(v.isin(hit, miss, unsure or miss)).alias("n_strict"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return out.select("k", "n", F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"), "n_strict", F.when(F.col("n_strict") > 0, F.col("k") / F.col("n_strict")).alias("rate_strict"))


def size_distribution(groups: DataFrame, size: str, *strata: str) -> DataFrame:
    return groups.groupBy(*strata, size).agg(F.count(F.lit(1)).alias("n_groups"))


def rank_sum(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """n1, n2, u and ties (sum of t^3 - t) of a Mann-Whitney test.

    Values are counted first, so ranks come from running sums over distinct values, by ranges.
    """
    counts = rows.groupBy(value).agg(F.count_if(group).alias("k1"), F.count_if(~group).alias("k2")).withColumn("k", F.col("k1") + F.col("k2"))
    ranked = order.running(counts, [value], "k", "before").withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
    sums = ranked.agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(F.col("k1") * F.col("rank")).alias("r1"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"))
    return sums.select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "ties")


def variance_inflation(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Of each column, from the inverse of their correlations (moments are one aggregate); infinite if singular."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    x = [F.col(c).cast("double") for c in columns]
    got = rows.agg(*[F.try_divide(F.covar_pop(x[i], x[j]), F.stddev_pop(x[i]) * F.stddev_pop(x[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if any(v is None for v in got):  # a constant column has no correlation
        return dict.fromkeys(columns, float("inf"))
    corr = np.eye(len(columns))
    for i, j in pairs:
        corr[i, j] = corr[j, i] = 1.0 if i == j else got[f"c{i}_{j}"]
    try:
        return dict(zip(columns, np.diag(np.linalg.inv(corr)).tolist(), strict=True))
    except np.linalg.LinAlgError:
        return dict.fromkeys(columns, float("inf"))


def logit(rows: DataFrame, outcome: str, columns: list[str], factor: str | None = None) -> dict:
    """Unpenalised logistic regression: per term coefficient, error, z, p, odds ratio and Wald interval; fit figures.

    The first level of `factor` by name is the base. A two-valued column one of
    whose cells with the outcome is empty separates the data, and so does any column,
    alone or with others, whose standard error passes UNKNOWN for a change of one
    standard deviation: that is reported as not converged.
    """
    import math

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    frame, terms = rows, list(columns)
    if factor:
        levels = sorted(r[0] for r in rows.select(factor).distinct().collect())
        for v in levels[1:]:
            frame = frame.withColumn(f"{factor}={v}", (F.col(factor) == v).cast("double"))
            terms.append(f"{factor}={v}")
    y = F.col(outcome).cast("double")
    frame = frame.select(y.alias("label"), *[F.col(f"`{t}`").cast("double").alias(f"x{i}") for i, t in enumerate(terms)]).persist()
    empty = frame.agg(*[e for i in range(len(terms)) for e in (F.collect_set(F.when(F.col(f"x{i}").isin(0.0, 1.0), F.struct(f"x{i}", "label"))).alias(f"s{i}"), F.bool_and(F.col(f"x{i}").isin(0.0, 1.0)).alias(f"b{i}"))]).first()
    separated = [t for i, t in enumerate(terms) if empty[f"b{i}"] and len(empty[f"s{i}"]) < 4]
    spread = frame.agg(*[F.stddev_pop(f"x{i}").alias(f"d{i}") for i in range(len(terms))]).first()
    ready = VectorAssembler(inputCols=[f"x{i}" for i in range(len(terms))], outputCol="features").transform(frame)
    model = GeneralizedLinearRegression(family="binomial", link="logit", regParam=0.0, maxIter=100, tol=1e-12).fit(ready)
    s = model.summary
    names = ["intercept", *terms]
    beta = [model.intercept, *model.coefficients.toArray().tolist()]
    try:
        se = s.coefficientStandardErrors
        se = [se[-1], *se[:-1]]
        # where a combination of columns separates, nothing is known of its slope: its error grows beyond any scale
        separated += [t for i, t in enumerate(terms) if t not in separated and not se[i + 1] * (spread[f"d{i}"] or 0.0) < UNKNOWN]
    except Exception:  # a singular design has none
        separated, se = separated or ["singular design"], [math.nan] * len(beta)
    out = {}
    for n, b, e in zip(names, beta, se, strict=True):
        z = b / e
        half = inference.Z95 * e
        out[n] = {"coef": b, "se": e, "z": z, "p_value": math.erfc(abs(z) / math.sqrt(2)), "odds_ratio": math.exp(min(b, 700.0)), "ci_95": (b - half, b + half)}
    ll, null = -s.deviance / 2, -s.nullDeviance / 2
    frame.unpersist()
    return {"terms": out, "n": s.numInstances, "log_likelihood": ll, "pseudo_r2": 1 - ll / null if null else math.nan, "llr_p_value": inference.chi2_tail_df(2 * (ll - null), len(terms)) if terms else 1.0, "converged": not separated, "separated_by": separated}


def with_woolf(tables: DataFrame, z: float = inference.Z95) -> DataFrame:
    """`tables` with odds_ratio and its interval lo, hi; null where a cell is empty."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    ratio, se = a * d / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    whole = F.least(*(F.col(x) for x in "abcd")) > 0
    bound = lambda sign: F.when(whole, F.exp(F.log(ratio) + sign * z * se))
    return tables.withColumns({"odds_ratio": F.when(whole, ratio), "lo": bound(-1), "hi": bound(1)})


def mantel_haenszel(tables: DataFrame, z: float = inference.Z95) -> DataFrame:
    """One row: n_total, and over tables with two rows or more common_odds_ratio, its Robins-Breslow-Greenland interval lo, hi, and chi2_statistic; null if degenerate."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    p, q, r, s = (a + d) / n, (b + c) / n, a * d / n, b * c / n
    parts = {"R": r, "S": s, "PR": p * r, "PSQR": p * s + q * r, "QS": q * s, "E": a - (a + b) * (a + c) / n, "V": (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))}
    sums = tables.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_total"), *[F.sum(F.when(n >= 2, v)).alias(k) for k, v in parts.items()])
    R, S, V = F.col("R"), F.col("S"), F.col("V")
    whole = (R > 0) & (S > 0) & (V > 0)
    se = F.sqrt(F.col("PR") / (2 * R * R) + F.col("PSQR") / (2 * R * S) + F.col("QS") / (2 * S * S))
    bound = lambda sign: F.when(whole, F.exp(F.log(R / S) + sign * z * se))
    return sums.select("n_total", F.when(whole, R / S).alias("common_odds_ratio"), bound(-1).alias("lo"), bound(1).alias("hi"), F.when(whole, F.col("E") * F.col("E") / V).alias("chi2_statistic"))


def recall_estimates(counts: DataFrame) -> DataFrame:
    """`counts` (n_pos, n_neg, and audited: p_hits of p_rows, m_hits of m_rows) with recall and the interval that crossed Wilson bounds give."""
    share_ = lambda p, m: F.try_divide(F.col("n_pos") * p, F.col("n_pos") * p + F.col("n_neg") * m)
    (p_lo, p_hi), (m_lo, m_hi) = wilson(F.col("p_hits"), F.col("p_rows")), wilson(F.col("m_hits"), F.col("m_rows"))
    return counts.withColumns({"recall": share_(F.try_divide("p_hits", "p_rows"), F.try_divide("m_hits", "m_rows")), "lo": share_(p_lo, m_hi), "hi": share_(p_hi, m_lo)})


def needed(tables: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """`tables` with p_control, prevalence, ratio, and n_required, events and survival_events to detect that ratio; null where nothing could."""
    a, b, c, d = (F.col(x) for x in "abcd")
    z = (inference.NORMAL.inv_cdf(1 - alpha / 2) + inference.NORMAL.inv_cdf(power)) ** 2
    rows = tables.withColumns({"p_control": share(c, c + d), "prevalence": share(a + b, a + b + c + d), "ratio": F.try_divide((a * d).cast("double"), (b * c).cast("double"))})
    e, p = F.col("prevalence"), F.col("p_control")
    hazard = e * (1 - e) * F.pow(F.log("ratio"), F.lit(2.0))
    n = F.ceil(F.when(hazard * p * (1 - p) > 0, z / (hazard * p * (1 - p))))
    return rows.withColumns({"n_required": n, "events": F.when(n.isNotNull(), F.greatest(F.lit(10), F.ceil(n * p))), "survival_events": F.ceil(F.when(hazard > 0, z / hazard))})


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) by its series, to 1e-12; further out than 8 it is 0 or 1."""
    near = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x))

    def add(s, k):
        term = s["term"] * near * near / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(near.alias("term"), near.alias("total")), add, lambda s: s["total"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + series * F.exp(-near * near / 2) / math.sqrt(2 * math.pi)))


def power_grid(tables: DataFrame, ratios=(0.5, 0.67, 1.5, 2.0, 3.0), alpha: float = 0.05) -> DataFrame:
    """`tables`' columns with n, p_control, prevalence, ratio and power: what each table would have told of each odds ratio; null where its rates are 0 or 1."""
    a, b, c, d = (F.col(x) for x in "abcd")
    rows = tables.withColumns({"n": a + b + c + d, "p_control": share(c, c + d), "prevalence": share(a + b, a + b + c + d), "ratio": F.explode(F.array(*[F.lit(float(r)) for r in ratios]))})
    p, e = F.col("p_control"), F.col("prevalence")
    spread = p * (1 - p) * e * (1 - e) * F.pow(F.log("ratio"), F.lit(2.0))
    power = normal_cdf(F.sqrt(F.col("n") * spread) - inference.NORMAL.inv_cdf(1 - alpha / 2))
    return rows.withColumn("power", F.when(spread > 0, power))


def uniform(seed: int, draw: Column, stream: str, number: Column) -> Column:
    """A number in (0, 1) that depends on its arguments alone: 60 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.lit(stream), number.cast("string")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 60))


def _normal(seed: int, draw: Column, stream: str) -> Column:
    u = lambda k: uniform(seed, draw, stream, F.lit(k))
    return F.sqrt(-2 * F.log(u(-1))) * F.cos(2 * math.pi * u(-2))


def _half_gamma(seed: int, draw: Column, stream: str, k: int) -> Column:
    """A draw of Gamma(k + 1/2): k exponentials and half a squared normal."""
    z = _normal(seed, draw, stream)
    waits = F.transform(F.sequence(F.lit(1), F.lit(max(k, 1))), lambda j: -F.log(uniform(seed, draw, stream, j)))
    return z * z / 2 + (F.aggregate(waits, F.lit(0.0), lambda s, x: s + x) if k else 0.0)


def corrected_draws(tables: DataFrame, ppv: tuple[int, int], miss: tuple[int, int], excluded=(0, 0), draws: int = 20_000, seed: int = 20261006) -> DataFrame:
    """`tables`' columns with draw and ratio: odds ratios under uncertain labels, null where a cell is not positive.

    Jeffreys draws of precision and miss rate (k of n, so Beta(k + 1/2, n - k + 1/2), as a
    share of two gamma draws) and random error of the table. Every random number is a
    digest of seed, draw and place, so any engine gives the same ones; a draw takes
    as many as the audits have rows.
    """
    spark = tables.sparkSession
    rows = tables.crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))  # a few tables, by draws that are asked for
    k = F.col("draw")

    def beta(name, of):
        hit, all_ = of
        g, h = _half_gamma(seed, k, f"{name}+", hit), _half_gamma(seed, k, f"{name}-", all_ - hit)
        return g / (g + h)

    rows = rows.withColumns({"p": beta("ppv", ppv), "m": beta("miss", miss), "z": _normal(seed, k, "error")})
    w = F.col("a") * F.col("p") + (F.col("b") - excluded[0]) * F.col("m")
    y = F.col("c") * F.col("p") + (F.col("d") - excluded[1]) * F.col("m")
    rows = rows.withColumns({"w": w, "y": y}).withColumns({"x": F.col("a") + F.col("b") - F.col("w"), "v": F.col("c") + F.col("d") - F.col("y")})
    cells_ = [F.col(x) for x in "wxyv"]
    log = F.log(F.col("w") * F.col("v") / (F.col("x") * F.col("y"))) + F.col("z") * F.sqrt(sum((1 / c for c in cells_[1:]), 1 / cells_[0]))
    return rows.select(*tables.columns, "draw", F.when(F.least(*cells_) > 0, F.exp(log)).alias("ratio"))


def drawn_interval(drawn: DataFrame, *by: str) -> DataFrame:
    """by, draws, skipped_draws, median_or, lo, hi of `corrected_draws`."""
    q = F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = drawn.groupBy(*by).agg(q.alias("q"), F.count(F.lit(1)).alias("draws"), F.count_if(F.col("ratio").isNull()).alias("skipped_draws"))
    return out.select(*by, "draws", "skipped_draws", F.col("q")[1].alias("median_or"), F.col("q")[0].alias("lo"), F.col("q")[2].alias("hi"))


def uncertain_correction(spark, table, ppv: tuple[int, int], miss: tuple[int, int], excluded=(0, 0), draws: int = 20_000, seed: int = 20261006) -> dict:
    """`corrected_draws` of one table of plain numbers, summed up."""
    (a, b), (c, d) = table
    one = spark.createDataFrame([(int(a), int(b), int(c), int(d))], "a long, b long, c long, d long")
    r = drawn_interval(corrected_draws(one, ppv, miss, excluded, draws, seed)).first()
    return {"draws": draws, "seed": seed, "skipped_draws": r["skipped_draws"], "median_or": r["median_or"], "interval_95": (r["lo"], r["hi"])}
