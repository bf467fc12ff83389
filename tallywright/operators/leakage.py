"""Leakage checks: each is one row (check_name, severity, n_violations, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.functions import names

MOST_DETAILS = 20
SEVERITIES = ("none", "warning", "severe")


def _report(found: DataFrame, detail: Column, name: str, severity: str, details: bool) -> DataFrame:
    """Counts every violation; with `details`, which reads the input again, keeps the first twenty in order."""
    rows = found.select(detail.alias("detail"))
    counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), F.when(F.col("n") > 0, severity).otherwise("none").alias("severity"), F.col("n").alias("n_violations"))
    if not details:
        return counted
    return counted.crossJoin(rows.orderBy("detail").limit(MOST_DETAILS).agg(F.sort_array(F.collect_list("detail")).alias("details")))


def shared_ids(train: DataFrame, test: DataFrame, key: str, details: bool = True) -> DataFrame:
    both = train.select(key).distinct().join(test.select(F.col(key).alias("of")).distinct(), F.col(key) == F.col("of"), "left_semi")
    return _report(both, F.col(key).cast("string"), "duplicate_leakage", "severe", details)


def shared_families(train: DataFrame, test: DataFrame, name: str, details: bool = True, **rule) -> DataFrame:
    key = lambda df: df.select(names.family(F.col(name), **rule).alias("family")).distinct()
    return _report(key(train).intersect(key(test)), F.col("family"), "name_family_leakage", "warning", details)


def late_features(records: DataFrame, key: str, prediction: str, features: list[str], details: bool = True) -> DataFrame:
    """Features observed after the prediction; a missing prediction time is a violation, a missing feature time is none."""
    each = F.array(F.when(F.col(prediction).isNull(), F.lit(f"missing {prediction}")), *[F.when(A.instant(records, f) > A.instant(records, prediction), F.lit(f"{f} is after {prediction}")) for f in features])
    found = records.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("what"))
    return _report(found, F.concat_ws(": ", "key", "what"), "temporal_leakage", "severe", details)


def label_correlation(records: DataFrame, features: list[str], label: str, threshold: float = 0.9) -> DataFrame:
    """Features whose correlation with the label is near one; columns without variance pass; below three rows nothing can be told."""
    n = F.count(F.lit(1))
    flat = records.agg(n.alias("n"), *[F.abs(F.try_divide(F.covar_pop(F.col(f).cast("double"), F.col(label).cast("double")), F.stddev_pop(f) * F.stddev_pop(label))).alias(f) for f in features])
    high = F.filter(F.array(*[F.when(F.col(f) >= threshold, F.format_string("%s: |r|=%.3f with label", F.lit(f), F.col(f))) for f in features]), lambda x: x.isNotNull())
    few = F.col("n") < 3
    return flat.select(
        F.lit("label_leakage_correlation").alias("check_name"),
        F.when(few, "warning").when(F.size(high) > 0, "warning").otherwise("none").alias("severity"),
        F.when(few, 0).otherwise(F.size(high)).cast("long").alias("n_violations"),
        F.when(few, F.array(F.lit("fewer than three rows"))).otherwise(high).alias("details"),
    )


def late_documents(records: DataFrame, key: str, seen: str, reported: str, details: bool = True) -> DataFrame:
    found = records.where(A.instant(records, seen) > A.instant(records, reported))
    return _report(found, F.col(key).cast("string"), "documentation_version_leakage", "severe", details)


def all_checks(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def assert_none_severe(reports: DataFrame) -> None:
    bad = [r["check_name"] for r in reports.where(F.col("severity") == "severe").collect()]
    if bad:
        raise RuntimeError(f"severe leakage: {', '.join(bad)}")
