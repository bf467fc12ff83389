"""Tables behind reports and figures: units, members, audited sheets, mechanisms, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.functions import names
from tallywright.operators import labelling, tables

# --- fixed values: what reviewers' notes say of host information -----------------------------------
HOST_FINGERPRINT = r"(?i)host[ -]?(?:fingerprint|id\b|ids\b|-id)|phone-home"
HOST_INFORMATION = r"(?i)host[- ]information|host info|hostname|whoami|\bIP\b|username|host ids?"
# --- end of fixed values -----------------------------------------------------------------------------


def members(campaigns: DataFrame) -> DataFrame:
    """One row a campaign and member: ecosystem, signature, position, package_name and the campaign's flags."""
    return campaigns.select("ecosystem", "signature", "_seq", "grammar_flag", "outcome", F.posexplode("members").alias("position", "package_name"))


def without_members(campaigns: DataFrame, excluded: DataFrame, positive: bool = True) -> DataFrame:
    """Campaigns (positive ones by default) none of whose members is in `excluded` (ecosystem, package_name)."""
    frame = (campaigns.where("outcome") if positive else campaigns).persist()  # read for the members and for what stays
    gone = excluded.select(F.col("ecosystem").alias("e"), F.col("package_name").alias("p")).distinct()
    hit = members(frame).join(gone, (F.col("ecosystem") == F.col("e")) & (F.col("package_name") == F.col("p")), "left_semi").select(F.col("ecosystem").alias("he"), F.col("signature").alias("hs")).distinct()
    return frame.join(hit, (F.col("ecosystem") == F.col("he")) & (F.col("signature") == F.col("hs")), "left_anti")


def displayed(campaigns: DataFrame, records: DataFrame) -> DataFrame:
    """ecosystem, signature, package_name: each campaign's first member that has a positive record."""
    hits = records.where("outcome").select(F.col("ecosystem").alias("e"), F.col("package_name").alias("p")).distinct()
    near = members(campaigns).join(hits, (F.col("ecosystem") == F.col("e")) & (F.col("package_name") == F.col("p")), "left_semi")
    return near.groupBy("ecosystem", "signature").agg(F.min_by("package_name", "position").alias("package_name"))


def member_flags(rows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """`rows` (ecosystem, package_name, ...) with the greatest flag of the campaigns that hold their package."""
    held = members(campaigns).groupBy(F.col("ecosystem").alias("e"), F.col("package_name").alias("p")).agg(F.bool_or("grammar_flag").alias("flag"))
    return rows.join(held, (F.col("ecosystem") == F.col("e")) & (F.col("package_name") == F.col("p")), "left").drop("e", "p")


def row_spans(records: DataFrame, taxonomy: dict, **rule) -> DataFrame:
    """Distinct (advisory, category, span) of the records, with the words matched and whether a tag list holds them."""
    whole = A.combined_text(F.col("summary"), F.col("description"))
    each = records.select("ecosystem", "package_name", "source", "advisory_id", whole.alias("whole")).withColumn("m", F.explode(labelling.matches(F.col("whole"), taxonomy, **rule)))
    hit = F.trim(F.regexp_replace("m.hit", r"(?U)\s+", " "))
    out = each.select("ecosystem", "package_name", "source", "advisory_id", "m.category", F.col("m.start").alias("start"), F.col("m.end").alias("end"), hit.alias("span"), A.in_tag_list(F.col("whole"), F.col("m.start")).alias("in_tag_list"))
    return out.dropDuplicates(["ecosystem", "package_name", "advisory_id", "category", "start", "end"])


def resolved(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two annotators' sheets by row: verdicts, notes, the final verdict and how it was reached."""
    both = tables.aligned(first, second, ["row", "package"], "verdict")
    notes = first.select(F.col("row").alias("r1"), "note", "adjudicated", "adjudication_note").join(second.select(F.col("row").alias("r2"), F.col("note").alias("note2")), F.col("r1") == F.col("r2"))
    rows = both.join(notes, F.col("row") == F.col("r1")).drop("r1", "r2")
    final = tables.final_verdict(F.col("adjudicated"), F.col("first"), F.col("second"))
    how = F.when(F.col("adjudicated").isNotNull(), "adjudicated").when(final.isNotNull(), "consensus").otherwise("missing")
    return rows.withColumn("final", final).withColumn("resolution", how)


def disagreements(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("first").eqNullSafe(F.col("second"))).select("row", "package", "first", "second", "final", "adjudication_note")


def precision_by_category(rows: DataFrame, categories: str = "categories") -> DataFrame:
    """category, k, n, single_k, single_n: a row's verdict counts for each category matched on it, then for rows with one alone."""
    used = rows.where(F.col("final").isin("REAL", "FALSE")).select(F.explode(categories).alias("category"), (F.size(categories) == 1).alias("alone"), (F.col("final") == "REAL").alias("real"))
    alone = F.col("alone")
    return used.groupBy("category").agg(F.count_if("real").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if(alone & F.col("real")).alias("single_k"), F.count_if(alone).alias("single_n"))


def misses_by_stratum(rows: DataFrame, stratum: str) -> DataFrame:
    counts = [F.count_if(F.col("final") == v).alias(v.lower()) for v in ("PRESENT", "ABSENT", "UNSURE")]
    return rows.groupBy(stratum).agg(*counts, F.count(F.lit(1)).alias("n"))


def host_notes(rows: DataFrame) -> DataFrame:
    """Absent rows whose adjudication names a host fingerprint alone, or whose notes mention host information."""
    alone = F.coalesce("adjudication_note", F.lit("")).rlike(HOST_FINGERPRINT)
    mention = F.coalesce("note", F.lit("")).rlike(HOST_INFORMATION) | F.coalesce("note2", F.lit("")).rlike(HOST_INFORMATION)
    return rows.where(F.col("final") == "ABSENT").withColumn("kind", F.when(alone, "host fingerprint").when(mention, "mentions host information")).where("kind is not null").select("row", "package", "kind")


def confirmed_misses(decisions: DataFrame, present: DataFrame, categories: list[str]) -> DataFrame:
    """category, n, n_core over the decided rows (row, package, categories, borderline); they must be the PRESENT rows."""
    both = decisions.join(present.select(F.col("row").alias("r"), F.col("package").alias("p")), (F.col("row") == F.col("r")) & (F.col("package") == F.col("p")), "full")
    known = F.array(*[F.lit(c) for c in categories])
    wrong = F.col("row").isNull() | F.col("r").isNull() | (F.size("categories") == 0) | (F.size(F.array_except("categories", known)) > 0)
    checked = F.when(wrong, F.raise_error(F.lit("decisions do not match the rows present, or name unknown categories"))).otherwise(F.col("categories"))
    each = both.select(F.explode(checked).alias("category"), "borderline")
    found = each.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("borderline")).alias("n_core"))
    every = decisions.sparkSession.createDataFrame([(c,) for c in categories], "c string")
    return every.join(found, F.col("c") == F.col("category"), "left").select(F.col("c").alias("category"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_core", F.lit(0)).alias("n_core"))


def classified_units(units: DataFrame, name_list: str = "names", **lexicon) -> DataFrame:
    """A unit is a list of names: flagged if any is, its pattern types joined, its tokens once each."""
    g = F.transform(name_list, lambda n: names.grammar(n, **lexicon))
    some = lambda *fields: F.exists("g", lambda x: sum((F.size(x[f]) for f in fields[1:]), F.size(x[fields[0]])) > 0)
    compound, trend = some("compound_prefixes", "compound_suffixes"), some("trend_suffixes")
    kind = F.when(compound & trend, "both").when(trend, "trend").when(compound, "compound").otherwise("none")
    tokens = F.array_distinct(F.flatten(F.transform("g", lambda x: F.concat(x["compound_prefixes"], x["compound_suffixes"], x["trend_suffixes"]))))
    return units.withColumn("g", g).withColumns({"flagged": compound | trend, "pattern_type": kind, "tokens": tokens}).drop("g")


def unit_summary(units: DataFrame, *strata: str) -> DataFrame:
    """n, flag count and rate, and units of each pattern type, by strata (none: all)."""
    kinds = [F.count_if(F.col("pattern_type") == k).alias(k) for k in ("none", "compound", "trend", "both")]
    out = units.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flag_count"), *kinds)
    return out.withColumn("flag_rate", F.when(F.col("n") > 0, F.col("flag_count") / F.col("n")))


def top(rows: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """The first n rows by `by`, ties in the order of `ties`: one bounded heap a task."""
    return rows.orderBy(by, *ties).limit(n)


def units_per_stratum(records: DataFrame, campaigns: DataFrame) -> DataFrame:
    """ecosystem, records, packages, campaigns."""
    r = records.groupBy("ecosystem").agg(F.count(F.lit(1)).alias("records"))
    p = records.select("ecosystem", "package_name").distinct().groupBy(F.col("ecosystem").alias("pe")).agg(F.count(F.lit(1)).alias("packages"))
    c = campaigns.groupBy(F.col("ecosystem").alias("ce")).agg(F.count(F.lit(1)).alias("campaigns"))
    return r.join(p, F.col("ecosystem") == F.col("pe")).join(c, F.col("ecosystem") == F.col("ce")).select("ecosystem", "records", "packages", "campaigns")


def campaigns_per_category(campaigns: DataFrame, records: DataFrame, excluded: str | None = None) -> DataFrame:
    """ecosystem, category, n campaigns; a campaign has the categories of all its members' records (`categories`)."""
    each = records.select(F.col("ecosystem").alias("e"), F.col("package_name").alias("p"), F.explode("categories").alias("category")).distinct()
    each = each.where(F.col("category") != excluded) if excluded else each
    held = members(campaigns).join(each, (F.col("ecosystem") == F.col("e")) & (F.col("package_name") == F.col("p"))).select("ecosystem", "signature", "category").distinct()
    return held.groupBy("ecosystem", "category").agg(F.count(F.lit(1)).alias("n"))


def packages_per_reporter_set(records: DataFrame) -> DataFrame:
    """reporters (aliases as one, sorted, joined by +), n packages."""
    sets = records.select("ecosystem", "package_name", F.explode(A.aliased(F.col("reporters"))).alias("r")).distinct()
    sets = sets.groupBy("ecosystem", "package_name").agg(F.array_join(F.sort_array(F.collect_list("r")), "+").alias("reporters"))
    return sets.groupBy("reporters").agg(F.count(F.lit(1)).alias("n"))


def per_day(records: DataFrame, at: str, start: str) -> DataFrame:
    """day (from `start`; -1 stands for all before), n."""
    day = F.datediff(A.instant(records, at), F.lit(start).cast("date"))
    return records.select(F.when(day.isNotNull(), F.greatest(day, F.lit(-1))).alias("day")).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def per_month(records: DataFrame, at: str, *by: str) -> DataFrame:
    """month (yyyy-MM; null where there is no time), n, by further columns."""
    return records.groupBy(F.date_format(A.instant(records, at), "yyyy-MM").alias("month"), *by).agg(F.count(F.lit(1)).alias("n"))


def source_agreement(records: DataFrame) -> DataFrame:
    """ghsa, osv, n: packages with records of both, by whether any of each is positive."""
    one = records.groupBy("ecosystem", "package_name").agg(F.bool_or(F.when(F.col("source") == "ghsa", F.col("outcome"))).alias("ghsa"), F.bool_or(F.when(F.col("source") == "osv", F.col("outcome"))).alias("osv"))
    return one.where("ghsa is not null and osv is not null").groupBy("ghsa", "osv").agg(F.count(F.lit(1)).alias("n"))
