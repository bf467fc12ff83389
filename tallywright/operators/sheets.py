"""Rows of annotation sheets: matches to show, frames, strata, draws, and the record of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.functions import fixed
from tallywright.operators import labelling, reports, sampling

#: Records come with the preferred source first.
FIRST_SOURCE = "ghsa"


def record_matches(records: DataFrame, taxonomy: dict = fixed.MECHANISMS, around: int = 100, **rule) -> DataFrame:
    """One row a record, category and span: where it is, the snippet with blanks collapsed, and its place among the record's."""
    whole = A.combined_text(F.col("summary"), F.col("description"))
    each = records.select("ecosystem", "package_name", "source", "advisory_id", whole.alias("whole")).select("*", F.posexplode(labelling.matches(F.col("whole"), taxonomy, **rule)).alias("place", "m"))
    shown = F.regexp_replace(A.snippet(F.col("whole"), F.col("m.start"), F.col("m.end"), around), r"(?U)\s+", " ")
    rows = each.select("ecosystem", "package_name", "source", "advisory_id", "place", "m.category", F.col("m.start").alias("start"), F.col("m.end").alias("end"), shown.alias("snippet"))
    keys = ["ecosystem", "package_name", "source", "advisory_id", "category", "start", "end"]
    return rows.groupBy(*keys).agg(F.min("place").alias("place"), F.first("snippet").alias("snippet"))


def package_matches(records: DataFrame, shown: DataFrame, taxonomy: dict = fixed.MECHANISMS, **rule) -> DataFrame:
    """Matches of the packages in `shown` (ecosystem, package_name), numbered in the order a sheet shows them."""
    wanted = shown.select("ecosystem", "package_name").distinct()
    rows = record_matches(records.join(wanted, ["ecosystem", "package_name"], "left_semi"), taxonomy, **rule)
    order = Window.partitionBy("ecosystem", "package_name").orderBy(F.col("source") != FIRST_SOURCE, F.coalesce("advisory_id", F.lit("")), "place")
    return rows.withColumn("number", F.row_number().over(order)).drop("place")


def sheet_stratum(campaigns: DataFrame) -> Column:
    """ecosystem and whether the inspector reports the campaign."""
    return F.concat_ws("|", "ecosystem", F.when(A.reporter_indicators(F.col("reporters"))["has_amazon_inspector"], "amazon").otherwise("no-amazon"))


def frames(campaigns: DataFrame, records: DataFrame, shown_before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positive campaigns none of whose packages was shown before, by their first positive member; negative ones with text, by their first member."""
    rows = campaigns.withColumn("stratum", sheet_stratum(campaigns))
    positive = reports.without_members(rows, shown_before)
    named = reports.displayed(positive, records).withColumnRenamed("package_name", "display")
    positive = positive.join(named, ["ecosystem", "signature"])
    negative = rows.where("not outcome and not no_text").withColumn("display", F.get("members", F.lit(0)))
    return positive, negative


def numbered(sample: DataFrame, *order: str) -> DataFrame:
    """`row` from one, in the given order; a sample is as large as people read."""
    return sample.withColumn("row", F.row_number().over(Window.orderBy(*order)))


def annotation_rows(campaigns: DataFrame, records: DataFrame, shown_before: DataFrame, n_positive: int, n_negative: int, taxonomy: dict = fixed.MECHANISMS) -> tuple[DataFrame, DataFrame, dict]:
    """The rows of both sheets and what their samples were drawn from."""
    meta = {}
    drawn = []
    for name, frame, n in zip(("precision", "recall"), frames(campaigns, records, shown_before), (n_positive, n_negative), strict=True):
        sizes = frame.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
        shares = {r["stratum"]: (r["size"], r["allotted"]) for r in sampling.allocate(sizes, "stratum", "n", n).collect()}
        meta[name] = {"frame": sum(s for s, _ in shares.values()), "stratum_sizes": {k: s for k, (s, _) in sorted(shares.items())}, "allocation": {k: a for k, (_, a) in sorted(shares.items())}}
        drawn.append(numbered(sampling.draw(frame, "stratum", "display", n), "ecosystem", "stratum", "display"))
    facts = campaigns.agg(F.count(F.lit(1)).alias("n"), F.count_if("outcome").alias("positive"), F.count_if("no_text").alias("no_text")).first()
    meta |= {"seed": sampling.SEED, "n_campaigns": facts["n"], "n_dv_positive": facts["positive"], "n_dv_negative": facts["n"] - facts["positive"], "n_no_text": facts["no_text"]}
    hits = package_matches(records.where("outcome"), drawn[0].select("ecosystem", F.col("display").alias("package_name")), taxonomy)
    lists = hits.groupBy("ecosystem", F.col("package_name").alias("display")).agg(F.sort_array(F.collect_list(F.struct("number", "category", "advisory_id", "source", "snippet"))).alias("matches"), F.sort_array(F.collect_set("category")).alias("categories"))
    positive = drawn[0].join(lists, ["ecosystem", "display"], "left")
    text = A.stripped(A.combined_text(F.col("summary"), F.col("description")))
    texts = records.select("ecosystem", F.col("package_name").alias("display"), F.struct((F.col("source") != FIRST_SOURCE).alias("late"), F.coalesce("advisory_id", F.lit("")).alias("advisory_id"), "source", text.alias("text")).alias("t"))
    texts = texts.join(drawn[1].select("ecosystem", "display").distinct(), ["ecosystem", "display"], "left_semi").groupBy("ecosystem", "display").agg(F.sort_array(F.collect_list("t")).alias("records"))
    return positive, drawn[1].join(texts, ["ecosystem", "display"], "left"), meta


def agreed(listed: DataFrame, computed: DataFrame) -> DataFrame:
    """`listed`, whose packages must be those of `computed` (ecosystem, package_name); one that only either has raises."""
    there = computed.select(F.col("ecosystem").alias("_e"), F.col("package_name").alias("_p"), F.lit(True).alias("_there")).distinct()
    both = listed.withColumn("_here", F.lit(True)).join(there, (F.col("ecosystem") == F.col("_e")) & (F.col("package_name") == F.col("_p")), "full")
    wrong = F.raise_error(F.concat(F.lit("only listed or only computed: "), F.coalesce("package_name", "_p")))
    whole = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    return both.withColumn("package_name", F.when(whole, F.col("package_name")).otherwise(wrong)).select(*listed.columns)


def spot_check_rows(campaigns: DataFrame, records: DataFrame, listed: DataFrame, per_ecosystem: dict[str, int], taxonomy: dict = fixed.MECHANISMS, computed: DataFrame | None = None) -> DataFrame:
    """Part a: the packages in `listed` (position, ecosystem, package_name). Part b: so many positive campaigns an ecosystem that hold none of them.

    With `computed`, the list must be exactly its packages.
    """
    listed = listed if computed is None else agreed(listed, computed)
    frame = reports.without_members(campaigns, listed)
    named = frame.join(reports.displayed(frame, records), ["ecosystem", "signature"])
    part_b = sampling.draw_each(named, "ecosystem", "package_name", per_ecosystem).select(F.lit("b").alias("part"), F.lit(0).alias("position"), "ecosystem", "package_name", F.col("member_count").alias("campaign_size"))
    held = reports.members(campaigns).select("ecosystem", "package_name", "signature").join(campaigns.select("ecosystem", "signature", F.col("member_count").alias("campaign_size")), ["ecosystem", "signature"])
    part_a = listed.join(held, ["ecosystem", "package_name"], "left").select(F.lit("a").alias("part"), F.col("position").cast("int").alias("position"), "ecosystem", "package_name", "campaign_size")
    rows = numbered(part_a.unionByName(part_b), "part", "position", "ecosystem", "package_name")
    hits = package_matches(records.where("outcome"), rows, taxonomy)
    lists = hits.groupBy("ecosystem", "package_name").agg(F.sort_array(F.collect_list(F.struct("number", "category", "advisory_id", "source", "snippet"))).alias("matches"), F.sort_array(F.collect_set("category")).alias("categories"))
    out = rows.join(lists, ["ecosystem", "package_name"], "left").drop("position")
    none = F.raise_error(F.concat(F.lit("a row without a match: "), F.col("package_name")))
    return out.withColumn("matches", F.when(F.col("matches").isNull(), none).otherwise(F.col("matches")))


def sample_record(meta: dict, **sheets: DataFrame) -> dict:
    """What the samples were, for a file beside the sheets: a row's place, package, stratum or part, members, categories and advisories."""
    out = dict(meta)
    for name, rows in sheets.items():
        columns = set(rows.columns)
        ids = F.sort_array(F.array_distinct(F.transform("matches" if "matches" in columns else "records", lambda x: x["advisory_id"]))).alias("advisory_ids")
        shown = F.col("display" if "display" in columns else "package_name").alias("package_name")
        keep = [c for c in ("part", "stratum", "members", "categories", "campaign_size") if c in columns]
        counted = [F.size("matches").alias("n_matches")] if "matches" in columns else []
        out[f"{name}_rows"] = [r.asDict(recursive=True) for r in rows.select("row", "ecosystem", shown, *keep, ids, *counted).orderBy("row").collect()]
    return out
