"""Markdown and figures for people: annotation sheets, the collapse audit, the gate report, tables and forest rows.

What is written here has been counted and drawn by Spark; only rows that are printed are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.functions import decisions, inference
from tallywright.operators import alike, collapse, reports, tables

ECOSYSTEM_NAMES = {"npm": "npm", "pypi": "PyPI"}


# ---- annotation sheets --------------------------------------------------------------------------------


def _size(n: int | None) -> str:
    return f" (campaign of {n} names)" if n and n > 1 else ""


def sheet(title: str, about: list[str], rows: DataFrame) -> str:
    """A sheet that `advisories.sheet_rows` reads back: each row's matches or records, then lines for a verdict and a note."""
    lines = [f"# {title}", "", *about, "", "Fill in the verdict and the note of every row, without looking at another annotator's sheet.", "", "---", ""]
    for r in (x.asDict(recursive=True) for x in rows.orderBy("row").collect()):
        package, size = r.get("display") or r["package_name"], r.get("campaign_size") or r.get("member_count")
        lines += [f"## {r['row']}. `{package}`", "", f"- Ecosystem: {ECOSYSTEM_NAMES.get(r['ecosystem'], r['ecosystem'])}{_size(size)}"]
        lines += [f"- Part: ({r['part']})"] if r.get("part") else []
        lines += [f"- Matched categories: {', '.join(r['categories'])}"] if r.get("categories") else []
        for m in r.get("matches") or []:
            lines += ["", f"**Match {m['number']}**: {m['category']}, {m['advisory_id']} ({m['source']})", "", "```text", m["snippet"], "```"]
        for m in r.get("records") or []:
            lines += ["", f"**{m['advisory_id']}** ({m['source']})", "", "````text", m["text"], "````"]
        lines += ["", "Verdict:", "", "Note:", "", "---", ""]
    return "\n".join(lines)


# ---- collapse audit -----------------------------------------------------------------------------------


def audit_tables(records: DataFrame, largest: int = 25, equal: int = 120, length: int = 200, below: float = 0.5) -> dict:
    """Counts and lists of an audit: the largest campaigns, those that may be one, campaigns that may be several.

    Of campaigns that share a beginning each is listed with the one before it in
    order, so that a list is as long as there are campaigns; the pairs are counted.
    """
    packages = collapse.by_package(records).withColumn("masked", A.signature_text(F.col("text"), F.col("package_name"))).persist()
    campaigns = collapse.by_signature(packages).persist()
    ids = collapse.campaign_table(campaigns).select("campaign_id", "ecosystem", "signature_type", "n_members", F.substring_index("members", ";", 1).alias("first_member"), "members")
    first = packages.select("ecosystem", F.col("_seq"), "masked").join(campaigns.select("ecosystem", "_seq"), ["ecosystem", "_seq"], "left_semi")
    named = campaigns.select("ecosystem", "_seq", F.get("members", F.lit(0)).alias("first_member")).join(ids, ["ecosystem", "first_member"]).drop("first_member").persist()
    heads = first.join(named.select("ecosystem", "_seq"), ["ecosystem", "_seq"])
    shared = alike.prefix_heads(heads, "masked", "ecosystem", equal, length).persist()
    near = shared.where("before_seq is not null").select("ecosystem", F.least("before_seq", "seq").alias("first_seq"), F.greatest("before_seq", "seq").alias("second_seq"), F.col("before_at").alias("diverge_at"))
    side = lambda k: named.select("ecosystem", F.col("_seq").alias(f"{k}_seq"), F.struct("campaign_id", "signature_type", "n_members").alias(k))
    text = lambda k: first.select("ecosystem", F.col("_seq").alias(f"{k}_seq"), F.col("masked").alias(f"{k}_text"))
    under = near
    for k in ("first", "second"):
        under = under.join(side(k), ["ecosystem", f"{k}_seq"]).join(text(k), ["ecosystem", f"{k}_seq"])
    at = F.col("diverge_at")
    under = under.select("ecosystem", "first", "second", "diverge_at", A.excerpt(F.col("first_text"), at).alias("first_excerpt"), A.excerpt(F.col("second_text"), at).alias("second_excerpt"), "first_seq", "second_seq").orderBy("first_seq", "second_seq")

    member = packages.select("ecosystem", "package_name", "_seq", "masked").join(reports.members(campaigns).select("ecosystem", "package_name", F.col("_seq").alias("campaign_seq")), ["ecosystem", "package_name"])
    several = member.join(campaigns.where("member_count > 1").select("ecosystem", F.col("_seq").alias("campaign_seq")), ["ecosystem", "campaign_seq"], "left_semi")
    low = alike.least_alike(several.withColumn("campaign_seq", F.col("campaign_seq")), "campaign_seq", "masked", below)
    of = lambda k: several.select("campaign_seq", F.col("_seq").alias(f"{k}_seq"), F.col("package_name").alias(f"{k}_name"), F.col("masked").alias(f"{k}_text"))
    over = low.join(of("first"), ["campaign_seq", "first_seq"]).join(of("second"), ["campaign_seq", "second_seq"]).join(named.withColumnRenamed("_seq", "campaign_seq"), "campaign_seq")
    over = over.withColumn("diverge_at", A.diverge_at(F.col("first_text"), F.col("second_text")))
    over = over.select("campaign_id", "ecosystem", "signature_type", "n_members", "similarity", "n_low", "first_name", "second_name", "diverge_at", A.excerpt(F.col("first_text"), at).alias("first_excerpt"), A.excerpt(F.col("second_text"), at).alias("second_excerpt")).orderBy("campaign_id")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out = {
        "n_records": records.count(), "n_packages": packages.count(), "n_campaigns": campaigns.count(),
        "signature_types": {r["signature_type"]: r["count"] for r in campaigns.groupBy("signature_type").count().collect()},
        "per_stratum": rows(reports.units_per_stratum(records, campaigns).orderBy("ecosystem")),
        "largest": rows(reports.top(ids.drop("first_member"), F.desc("n_members"), largest, "campaign_id")), "under": rows(under.drop("first_seq", "second_seq")), "n_pairs": (shared.agg(F.sum("n_pairs")).first()[0] or 0) // 2, "over": rows(over),
    }
    for df in (packages, campaigns, named, shared):
        df.unpersist()
    return out


def _table(head: list[str], rows: list[list]) -> list[str]:
    body = [f"| {' | '.join(str(c) for c in r)} |" for r in rows] or [f"| none |{' |' * (len(head) - 1)}"]
    return [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *body, ""]


def audit(found: dict, name: str) -> str:
    kinds = ", ".join(f"{k} {n}" for k, n in sorted(found["signature_types"].items()))
    strata = "; ".join(f"{r['ecosystem']}: {r['records']} records, {r['packages']} packages, {r['campaigns']} campaigns" for r in found["per_stratum"])
    lines = [f"# Audit of the campaign collapse: {name}", "", "Nothing here changes the grouping; decisions (merge, keep, split) go into the last column.", ""]
    lines += [f"- {found['n_records']} records, {found['n_packages']} packages, {found['n_campaigns']} campaigns. {strata}.", f"- Signatures: {kinds}.", f"- {found['n_pairs']} pairs may be one campaign; {len(found['over'])} campaigns may be several.", ""]
    lines += ["## Largest campaigns", "", *_table(["#", "Campaign", "Ecosystem", "Signature", "Members", "Names"], [[i, r["campaign_id"], r["ecosystem"], r["signature_type"], r["n_members"], ", ".join(f"`{m}`" for m in r["members"].split(";"))] for i, r in enumerate(found["largest"], 1)])]
    lines += ["## Pairs that may be one", "", *_table(["#", "First", "Second", "Ecosystem", "Signatures", "Sizes", "Diverge at", "First excerpt", "Second excerpt", "Decision"], [[i, r["first"]["campaign_id"], r["second"]["campaign_id"], r["ecosystem"], f"{r['first']['signature_type']} / {r['second']['signature_type']}", f"{r['first']['n_members']} / {r['second']['n_members']}", r["diverge_at"], r["first_excerpt"], r["second_excerpt"], ""] for i, r in enumerate(found["under"], 1)])]
    lines += ["## Campaigns that may be several", "", *_table(["#", "Campaign", "Ecosystem", "Signature", "Members", "Least Jaccard", "Low pairs", "First", "Second", "Diverge at", "First excerpt", "Second excerpt", "Decision"], [[i, r["campaign_id"], r["ecosystem"], r["signature_type"], r["n_members"], f"{r['similarity']:.2f}", r["n_low"], f"`{r['first_name']}`", f"`{r['second_name']}`", r["diverge_at"], r["first_excerpt"], r["second_excerpt"], ""] for i, r in enumerate(found["over"], 1)])]
    return "\n".join(lines)


# ---- gate report --------------------------------------------------------------------------------------

NEXT = {
    "NO_GO": "Stop before the full collection and any model; look for sources with more labelled incidents, then run the gate again.",
    "GO_WITH_REDUCED_SCOPE": "Go on with the association as the only primary claim; what needs dates stays descriptive. Run the gate again after the full collection.",
    "GO": "Go on as planned. Run the gate again after the full collection.",
}


def gate_report(counts: decisions.PilotCounts, thresholds: dict, rates: tuple[float, float], flagged: int, when: str = "") -> str:
    decision, reasons = decisions.gate(counts, **thresholds)
    lines = ["# Pilot gate", "", *([f"Written {when}.", ""] if when else []), f"## Decision: **{decision}**", "", *[f"- {r}" for r in reasons], "", "## Counts", ""]
    lines += [f"- labelled incidents: {counts.incidents_labelled}", f"- controls: {counts.controls}", f"- dated events: {counts.events_dated}", f"- labels missing: {counts.label_missing_pct:.1f} %", f"- timestamps missing: {counts.timestamp_missing_pct:.1f} %", ""]
    return "\n".join([*lines, decisions.power_summary(flagged, counts.controls, *rates, counts.events_dated), "", "## Next", "", NEXT[decision], ""])


# ---- published tables ---------------------------------------------------------------------------------


def table_one(sets: dict[str, tuple[int, int]]) -> list[dict]:
    """Flag rate of each set of names or campaigns, from (flagged, n)."""
    return [{"set": name, "flagged": k, "n": n, "rate": k / n if n else None, "wilson95": inference.wilson(k, n)} for name, (k, n) in sets.items()]


#: Where a study's result holds an estimate: kind, and the path to it; a star stands for every key. Terms of models are told apart by name.
ESTIMATES = [
    ("exact", ("pooled",)),
    ("exact", ("by_ecosystem", "strata", "*")),
    ("common", ("by_ecosystem", "cmh")),
    ("common", ("by_reporters", "*", "cmh")),
    ("model", ("logit", "*", "terms", "*")),
]
#: What each kind calls its ratio and interval.
RATIO = {"exact": ("odds_ratio", "odds_ratio_ci_95"), "common": ("common_odds_ratio", "common_odds_ratio_ci_95"), "model": ("odds_ratio", "ci_95")}


def _at(result: dict, path: tuple[str, ...], before: tuple[str, ...] = ()):
    """(keys, value) of every place that `path` names."""
    if not path:
        yield before, result
        return
    for key in result if path[0] == "*" else [path[0]] if path[0] in result else []:
        yield from _at(result[key], path[1:], (*before, str(key)))


def estimates(results: dict[str, dict], corrected: dict | None = None) -> list[dict]:
    """One row an estimate: result, kind, name, term, n, ratio, lo, hi, p, converged.

    `results` are those of `study.run` by what they were run on; `corrected` is a
    `misclassification`, whose intervals are those of its draws.
    """
    rows = []
    for of, result in results.items():
        for kind, path in ESTIMATES:
            for keys, found in _at(result, path):
                model = result["logit"][keys[1]] if kind == "model" else {}
                lo, hi = found.get(RATIO[kind][1]) or (None, None)
                n = model.get("n", sum(found["table"]) if "table" in found else found.get("n_total"))
                rows.append({"result": of, "kind": kind, "name": "/".join(keys[:2] if model else keys), "term": keys[-1] if model else "x", "n": n, "ratio": found[RATIO[kind][0]], "lo": lo, "hi": hi, "p": found["p_value"], "converged": model.get("converged", True)})
    for name, found in (corrected or {}).items():
        if isinstance(found, dict) and "probabilistic" in found:
            lo, hi = found["probabilistic"]["interval_95"]
            rows.append({"result": "corrected", "kind": "draws", "name": name, "term": "x", "n": None, "ratio": found["simple"]["odds_ratio"], "lo": lo, "hi": hi, "p": None, "converged": True})
    return rows


def misclassification(campaigns: DataFrame, precision: tuple[int, int], misses: dict[str, tuple[int, int]], audited: DataFrame | None = None, draws: int = 20_000) -> dict:
    """Odds ratios corrected for a labeller's precision and miss rates; campaigns without text hide nothing.

    `audited` (kind, flag, hit) gives both predictive values by grammar flag, which the correction takes to be alike.
    """
    cells = tables.collected(tables.contingency(campaigns, F.col("grammar_flag"), F.col("outcome")))[()]
    table = [cells[:2], cells[2:]]
    none = campaigns.where("no_text and not outcome").agg(F.count_if("grammar_flag").alias("yes"), F.count_if(~F.col("grammar_flag")).alias("no")).first()
    out: dict = {"observed_table": table, "observed_or": inference.fisher(*cells)["odds_ratio"], "no_text_negatives": (none["yes"], none["no"])}
    for name, miss in misses.items():
        (a, b), (c, d) = simple = inference.corrected_table(table, precision[0] / precision[1], miss[0] / miss[1], (none["yes"], none["no"]))
        drawn = tables.uncertain_correction(campaigns.sparkSession, table, precision, miss, (none["yes"], none["no"]), draws)
        out[name] = {"simple": {"table": simple, "odds_ratio": a * d / (b * c) if b * c else None}, "probabilistic": drawn}
    if audited is not None:
        found = {(r["kind"], r["flag"]): (r["k"], r["n"]) for r in audited.groupBy("kind", "flag").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n")).collect()}
        out["by_flag"] = {f"{kind}_{'flagged' if flag else 'unflagged'}": {"k": k, "n": n, "p": k / n, "wilson95": inference.wilson(k, n)} for (kind, flag), (k, n) in sorted(found.items())}
    return out


def forest(rows: list[dict]) -> dict[str, list[dict]]:
    """The rows of `estimates` that a forest shows: those of the flag, and the models' reporter terms."""
    drawn = [r for r in rows if r["lo"] is not None and r["converged"]]
    return {"flag": [r for r in drawn if r["term"] == "x"], "reporters": [r for r in drawn if r["kind"] == "model" and r["term"] not in ("x", "intercept") and not r["term"].startswith("ecosystem=")]}


# ---- tables behind figures ------------------------------------------------------------------------------


def power_curve(power: dict, ratios=(1.5, 2.0, 3.0), sizes=range(25, 1001, 25)) -> list[dict]:
    """ratio, n, power over a grid of sample sizes, at the rates of a `decisions.power_table`."""
    return [{"ratio": r, "n": n, "power": inference.achieved_power(n, power["p_control"], power["prevalence"], r)} for r in ratios for n in sizes]


def figure_tables(records: DataFrame, start: str, sets: dict[str, tuple[int, int]] | None = None, excluded: str | None = None) -> dict:
    """Every table a figure is drawn from, as rows: small ones, one a group.

    counts by ecosystem, ranked campaign sizes, outcome rates by grammar and reporter
    splits, flag rates by set, power over n, records a day from `start`, campaigns by
    mechanism, packages by reporter set.
    """
    packages = collapse.by_package(records).persist()
    campaigns = collapse.reporter_covariates(collapse.by_signature(packages)).persist()
    one, many = F.col("n_reporters") == 1, F.col("n_reporters") >= 2
    splits = {
        "flagged": F.col("grammar_flag"), "not flagged": ~F.col("grammar_flag"), "inspector": F.col("has_amazon_inspector"), "no inspector": ~F.col("has_amazon_inspector"),
        "reporters 2+": many, "reporters 1": one, "boilerplate absent": ~F.col("has_boilerplate"), "boilerplate among": F.col("has_boilerplate"), "boilerplate alone": F.col("has_boilerplate") & one,
    }
    marks = F.array(*[F.when(c, F.lit(k)) for k, c in splits.items()])
    rates = campaigns.select("outcome", F.explode(F.array_compact(marks)).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("outcome").alias("k"))
    lo, hi = tables.wilson(F.col("k"), F.col("n"))
    cells = tables.collected(tables.contingency(campaigns, F.col("grammar_flag"), F.col("outcome"))).get((), (0, 0, 0, 0))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out = {
        "by_ecosystem": rows(reports.units_per_stratum(records, campaigns).orderBy("ecosystem")),
        "sizes": rows(tables.size_distribution(campaigns, "member_count", "ecosystem").orderBy("ecosystem", F.desc("member_count"))),
        "outcome_rates": rows(rates.select("split", "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi")).orderBy("split")),
        "flag_rates": table_one({**(sets or {}), "campaigns": (cells[0] + cells[1], sum(cells))}),
        "power": power_curve(decisions.power_table(cells)),
        "days": rows(reports.per_day(records, "published_at", start).orderBy("day")),
        "mechanisms": rows(reports.campaigns_per_category(campaigns, records, excluded).orderBy("ecosystem", F.desc("n"), "category")),
        "reporter_sets": rows(reports.packages_per_reporter_set(records).orderBy(F.desc("n"), "reporters")),
    }
    packages.unpersist(), campaigns.unpersist()
    return out
