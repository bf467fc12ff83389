"""The whole study over a snapshot: label, collapse, tabulate, test, vary; one nested result and one table.

    python -m tallywright.plans.study (--records snap.jsonl | --snapshot v2) --out results [--text-source osv] [--group-on any] [--merges m.json]
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.functions import decisions, fixed, inference, names
from tallywright.operators import collapse, labelling, tables
from tallywright.sources import advisories as S
from tallywright.sources import sinks

SCHEMA = "advisory_id string, source string, package_name string, ecosystem string, summary string, description string, published_at string, withdrawn_at string, severity string, reference_urls array<string>, fetched_at string"
COVARIATES = {"main": ["n_reporters", "has_amazon_inspector"], "a": ["n_reporters"], "b": ["has_amazon_inspector"], "c": ["n_reporters", "has_boilerplate", "has_kam193"]}
#: Settings of the signature that are compared: none of three switches, each alone, two without the tag, all.
OFF = {"use_tag": False, "mask": False, "generic_apart": False}
GRID = [
    OFF,
    {k: v for k, v in OFF.items() if k != "generic_apart"},
    {k: v for k, v in OFF.items() if k != "use_tag"},
    {k: v for k, v in OFF.items() if k != "mask"},
    {"use_tag": False},
    {},
]


def prepared(records: DataFrame, taxonomy=fixed.MECHANISMS) -> DataFrame:
    """Records with labels, name flag and reporters of their whole package; `_seq` must be there."""
    one = collapse.dedup_exact(records, ["ecosystem", "package_name", "advisory_id"])
    whole = A.combined_text(F.col("summary"), F.col("description"))
    rows = labelling.labelled(one.withColumn("whole", whole), "whole", taxonomy).drop("whole")
    return rows.withColumns({"outcome": F.col("flag"), "grammar_flag": names.grammar(F.col("package_name"))["is_flagged"], "reporters": A.reporters(F.col("description"))})


def fisher_of(campaigns: DataFrame) -> dict:
    t = tables.collected(tables.contingency(campaigns, F.col("grammar_flag"), F.col("outcome"))).get((), (0, 0, 0, 0))
    return {"table": t, **inference.fisher(*t)}


def strata_of(campaigns: DataFrame, by: str) -> dict:
    found = tables.collected(tables.contingency(campaigns, F.col("grammar_flag"), F.col("outcome"), by), by)
    each = {k[0]: {"table": t, **inference.fisher(*t)} for k, t in sorted(found.items(), key=str)}
    return {"strata": each, "cmh": inference.mantel_haenszel([found[k] for k in sorted(found, key=str)])}


def fitted(campaigns: DataFrame, covariates: list[str]) -> dict:
    y = campaigns.withColumns({"dv": F.col("outcome").cast("int"), "x": F.col("grammar_flag").cast("int"), **{c: F.col(c).cast("int") for c in covariates}})
    return tables.logit(y, "dv", ["x", *covariates], "ecosystem")


def sensitivity(campaigns: DataFrame, base: DataFrame) -> dict:
    count = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum("member_count"), F.lit(0))).first()
    now, then = count(campaigns), count(base)
    return {"n_campaigns": now[0], "delta_campaigns": now[0] - then[0], "delta_packages": now[1] - then[1], "pooled": fisher_of(campaigns), "cmh": strata_of(campaigns, "ecosystem")["cmh"], "logit": fitted(campaigns, COVARIATES["main"])}


def run(records: DataFrame, text_source: str = "any", group_on: str = "any", merges: list[dict] = ()) -> tuple[dict, DataFrame]:
    rows = prepared(records).persist()
    campaigns = collapse.reporter_covariates(collapse.collapse(rows, text_source, group_on)).persist()
    pooled = fisher_of(campaigns)
    out = {"n_records": rows.count(), "n_campaigns": campaigns.count(), "pooled": pooled, "by_ecosystem": strata_of(campaigns, "ecosystem"), "power": decisions.power_table(tuple(pooled["table"]))}
    out["by_reporters"] = {by: strata_of(campaigns, by) for by in ("n_reporters_stratum", "ecosystem_x_n_reporters")}
    indicators = ["has_kam193", "has_amazon_inspector", "has_other", "has_boilerplate"]
    out["rates"] = [r.asDict() for r in tables.rates_by_indicator(campaigns, indicators, "grammar_flag", "outcome").collect()]
    out["logit"] = {k: fitted(campaigns, c) for k, c in COVARIATES.items()}
    coded = campaigns.withColumns({"pypi": (F.col("ecosystem") == "pypi").cast("int"), "x": F.col("grammar_flag").cast("int"), "inspector": F.col("has_amazon_inspector").cast("int")})
    out["vif"] = tables.variance_inflation(coded, ["pypi", "x", "n_reporters", "inspector"])
    out["sensitivity"] = {"exclude_no_text": sensitivity(campaigns.where("not no_text"), campaigns)}
    if merges:
        merged = collapse.apply_merges(collapse.collapse(rows, text_source, group_on), list(merges))
        out["sensitivity"]["with_merges"] = sensitivity(collapse.reporter_covariates(merged), campaigns)
    out["signature_grid"] = [{"settings": s, "n_campaigns": collapse.collapse(rows, text_source, group_on, **s).count()} for s in GRID]
    return out, collapse.campaign_table(campaigns)


def main(argv: list[str] | None = None) -> None:
    from tallywright.session import local_session

    p = argparse.ArgumentParser()
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--records", help="JSON lines")
    source.add_argument("--snapshot", help="name of a snapshot NAME.jsonl in --snapshots")
    p.add_argument("--snapshots", default="snapshots")
    p.add_argument("--out", required=True)
    p.add_argument("--text-source", default="any", choices=("any", *collapse.SOURCES))
    p.add_argument("--group-on", default="any", choices=("any", *collapse.SOURCES))
    p.add_argument("--merges")
    a = p.parse_args(argv)
    spark = local_session()
    merges = S.merge_list(Path(a.merges).read_text(encoding="utf-8")) if a.merges else []
    result, table = run(S.jsonl(spark, a.records or f"{a.snapshots}/{a.snapshot}.jsonl", SCHEMA), a.text_source, a.group_on, merges)
    suffix = ("" if (a.text_source, a.group_on) == ("any", "any") else f"__text-{a.text_source}__group-{a.group_on}") + (f"__{a.snapshot}" if a.snapshot else "")
    sinks.atomic_write(Path(a.out) / f"study{suffix}.json", json.dumps(result, indent=2, default=str).encode())
    sinks.csv_table(table, f"{a.out}/campaigns{suffix}")


if __name__ == "__main__":
    main()
