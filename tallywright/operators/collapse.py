"""From records to independent units: exact dedup, canonical records, package and campaign collapse, merges.

Order is data: every input carries `_seq`, and whatever is "first" is the least
`_seq`. Each collapse is one grouped aggregate with map-side combination; lists
that grow with a group are only made where a table must show its members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.operators import order

SOURCES = ("ghsa", "osv")


def dedup_exact(records: DataFrame, keys: list[str], source: str = "source", preferred: str = "ghsa") -> DataFrame:
    """One row a key: the first, or the first of the preferred source; `_seq` is that of the key's first row."""
    rest = [c for c in records.columns if c not in keys]
    whole = F.struct(*rest)
    best = F.min_by(whole, F.struct((F.coalesce(F.col(source), F.lit("")) != preferred).alias("late"), F.col("_seq")))
    one = records.groupBy(*keys).agg(best.alias("r"), F.min("_seq").alias("first_seq"))
    return one.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "_seq"], F.col("first_seq").alias("_seq"))


def candidate_set(records: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows in order, by ranges."""
    return records.select(*columns).distinct().orderBy(*columns)


def _published(preferred: str | None) -> Column:
    late = F.col("published_at").isNull()
    order = [late.alias("late"), F.coalesce("published_at", F.lit("")).alias("at"), F.col("_seq")]
    if preferred:
        order.insert(0, (F.col("source") != preferred).alias("other"))
    return F.struct(*order)


def canonical(records: DataFrame, keys: list[str], prefer: str) -> DataFrame:
    """The earliest published record of each key in the preferred source, else in the other; others raise."""
    if prefer not in SOURCES:
        raise ValueError(f"prefer must be one of {SOURCES}, got {prefer!r}")
    rest = [c for c in records.columns if c not in keys]
    one = records.groupBy(*keys).agg(F.min_by(F.when(F.col("source").isin(*SOURCES), F.struct(*rest)), F.when(F.col("source").isin(*SOURCES), _published(prefer))).alias("r"), F.min("_seq").alias("first_seq"))
    checked = one.withColumn("r", F.when(F.col("r").isNull(), F.raise_error(F.lit("a key has no record of a known source"))).otherwise(F.col("r")))
    return checked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "_seq"], F.col("first_seq").alias("_seq"))


def source_disagreement(records: DataFrame, keys: list[str], outcome: str, prefer: str = "ghsa", other: str = "osv") -> DataFrame:
    """Keys whose canonical preferred record is negative though another source has a positive one."""
    first = F.min_by(outcome, F.when(F.col("source") == prefer, _published(None)))
    both = records.groupBy(*keys).agg(first.alias("preferred"), F.bool_or(F.when(F.col("source") == other, F.col(outcome))).alias("elsewhere"))
    return both.where((F.col("preferred") == F.lit(False)) & F.col("elsewhere")).select(*keys)


def reporters_of(records: DataFrame) -> DataFrame:
    """ecosystem, package_name, names: a package's distinct reporters in first-seen order; a list holds names, however many records there are."""
    each = records.select("ecosystem", "package_name", "_seq", F.posexplode("reporters").alias("place", "reporter"))
    first = each.groupBy("ecosystem", "package_name", "reporter").agg(F.min(F.struct("_seq", "place")).alias("at"))
    lists = first.groupBy("ecosystem", "package_name").agg(F.sort_array(F.collect_list(F.struct("at", "reporter"))).alias("l"))
    return lists.select("ecosystem", "package_name", F.transform("l", lambda x: x["reporter"]).alias("names"))


def by_package(records: DataFrame, text_source: str = "any", group_on: str = "any", keyed_by: dict | None = None) -> DataFrame:
    """Stage 1. One row a (ecosystem, package_name): whose text decides and whose text groups are set apart.

    Columns wanted: ecosystem, package_name, source, advisory_id, summary,
    description, published_at, grammar_flag, outcome, reporters, _seq. With
    `keyed_by`, switches of the signature, each record's signature is taken where it
    is read and travels in place of its text (columns: signature, not text).
    """
    for name, value in (("text_source", text_source), ("group_on", group_on)):
        if value not in ("any", *SOURCES):
            raise ValueError(f"{name} must be any or one of {SOURCES}, got {value!r}")
    text = A.record_text(F.col("summary"), F.col("description"))
    shown = text.alias("text") if keyed_by is None else A.signature(text, F.col("package_name"), **keyed_by).alias("signature")
    record = F.struct("advisory_id", shown, "grammar_flag", "outcome")
    known = F.col("source").isin(*SOURCES)
    pick = lambda prefer: F.min_by(F.when(known, record), F.when(known, _published(prefer)))
    decides = (F.bool_or("grammar_flag"), F.bool_or("outcome")) if text_source == "any" else (pick(text_source)["grammar_flag"], pick(text_source)["outcome"])
    groups = F.min_by(record, F.col("_seq")) if group_on == "any" else pick(group_on)
    one = records.groupBy("ecosystem", "package_name").agg(
        F.min("_seq").alias("_seq"),
        F.count(F.lit(1)).alias("n_records"),
        decides[0].alias("grammar_flag"),
        decides[1].alias("outcome"),
        groups.alias("g"),
        F.bool_and(A.is_no_text(F.col("description"))).alias("no_text"),
    )
    both = one.join(reporters_of(records), ["ecosystem", "package_name"], "left")
    union = F.coalesce("names", F.array().cast("array<string>"))
    carried = "text" if keyed_by is None else "signature"
    return both.select("ecosystem", "package_name", "_seq", "n_records", "grammar_flag", "outcome", "no_text", union.alias("reporters"), F.col(f"g.{carried}").alias(carried), F.col("g.advisory_id").alias("group_advisory_id"))


def by_signature(packages: DataFrame, **signature) -> DataFrame:
    """Stage 2. One row a (ecosystem, signature): any positive counts, members in first-seen order."""
    keyed = packages if "signature" in packages.columns else packages.withColumn("signature", A.signature(F.col("text"), F.col("package_name"), **signature))
    members = F.sort_array(F.collect_list(F.struct("_seq", "package_name", "reporters")))
    one = keyed.groupBy("ecosystem", "signature").agg(
        F.min("_seq").alias("_seq"), F.count(F.lit(1)).alias("member_count"), F.bool_or("grammar_flag").alias("grammar_flag"), F.bool_or("outcome").alias("outcome"), F.bool_and("no_text").alias("no_text"), members.alias("m")
    )
    names = F.transform("m", lambda x: x["package_name"])
    union = F.array_distinct(F.flatten(F.transform("m", lambda x: x["reporters"])))
    return one.select("ecosystem", "signature", A.signature_type(F.col("signature")).alias("signature_type"), "_seq", "member_count", names.alias("members"), union.alias("reporters"), "grammar_flag", "outcome", "no_text")


def collapse(records: DataFrame, text_source: str = "any", group_on: str = "any", **signature) -> DataFrame:
    return by_signature(by_package(records, text_source, group_on, signature))


def merge_places(found: list[tuple[str, str, str, int]], merges: list[dict]) -> list[tuple[str, str, int, int]]:
    """(ecosystem, signature, group, position) of campaigns that entries merge, applied in turn.

    `found` has (ecosystem, package, signature, _seq) of the listed packages. A group's
    campaigns are kept in the order the entries leave them in: those that meet are
    lined up by their first places, each with what it has gathered.
    """
    campaign = {(e, p): (e, s) for e, p, s, _ in found}
    first = {(e, s): q for e, _, s, q in found}
    line = {c: [c] for c in first}  # by the campaign a group began with
    head = {c: c for c in first}

    def top(c):
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    for entry in merges:
        met = sorted({top(campaign[entry["ecosystem"], p]) for p in entry["packages"] if (entry["ecosystem"], p) in campaign}, key=lambda c: first[c])
        for c in met[1:]:
            head[c] = met[0]
            line[met[0]] += line.pop(c)
    return [(*c, g, k) for g, cs in enumerate(line.values()) if len(cs) > 1 for k, c in enumerate(cs)]


def apply_merges(campaigns: DataFrame, merges: list[dict]) -> DataFrame:
    """Whole campaigns that share a listed name become one, where the first stood; entries apply in turn, so they chain.

    The entries are a hand-made list. Only campaigns that hold a listed name reach the
    driver, by their keys, no more than the list has names; the rows meet in one grouping,
    and campaigns that nothing merges pass by it.
    """
    for entry in merges:
        if not all(entry.get(k) for k in ("id", "ecosystem", "packages", "reason")):
            raise ValueError(f"a merge needs id, ecosystem, packages and reason: {entry}")
    spark = campaigns.sparkSession
    campaigns = campaigns.persist()  # read for the names, for what stays apart and for what meets
    names = sorted({(e["ecosystem"], p) for e in merges for p in e["packages"]})
    listed = spark.createDataFrame(names, "_e string, _p string")
    held = campaigns.select("ecosystem", "signature", "_seq", F.explode("members").alias("package")).join(F.broadcast(listed), (F.col("ecosystem") == F.col("_e")) & (F.col("package") == F.col("_p")))
    found = [(r["ecosystem"], r["package"], r["signature"], r["_seq"]) for r in held.select("ecosystem", "package", "signature", "_seq").collect()]
    places = spark.createDataFrame(merge_places(found, merges), "_e string, _s string, g int, k int")
    same = (F.col("ecosystem") == F.col("_e")) & (F.col("signature") == F.col("_s"))
    apart = campaigns.join(F.broadcast(places), same, "left_anti")
    m = F.sort_array(F.collect_list(F.struct("k", "members", "reporters")))
    first = lambda c: F.min_by(c, "k").alias(c)
    merged = campaigns.join(F.broadcast(places), same).groupBy("ecosystem", "g").agg(
        first("signature"), first("signature_type"), F.min("_seq").alias("_seq"), F.sum("member_count").alias("member_count"), m.alias("m"), F.bool_or("grammar_flag").alias("grammar_flag"), F.bool_or("outcome").alias("outcome"), F.bool_and("no_text").alias("no_text")
    )
    flat = lambda c: F.flatten(F.transform("m", lambda x: x[c]))
    merged = merged.withColumn("members", flat("members")).withColumn("reporters", F.array_distinct(flat("reporters")))
    return apart.select(*campaigns.columns).unionByName(merged.select(*campaigns.columns))


def campaign_table(campaigns: DataFrame) -> DataFrame:
    """Rows as the table file has them: ids in first-seen order, flags as 0/1, members joined."""
    marks = {k: v.cast("int") for k, v in A.reporter_indicators(F.col("reporters")).items() if k != "has_other"}
    rows = campaigns.select(
        "_seq", "ecosystem", "signature_type", F.col("member_count").alias("n_members"), F.array_join("members", ";").alias("members"),
        F.col("grammar_flag").cast("int").alias("grammar_flag"), F.col("outcome").cast("int").alias("dv"), A.n_reporters(F.col("reporters")).alias("n_reporters"), *[v.alias(k) for k, v in marks.items()],
    )
    counted = order.numbered(rows, ["_seq"])
    return counted.select(F.format_string("C%03d", F.col("number")).alias("campaign_id"), *[c for c in rows.columns if c != "_seq"])


def reporter_covariates(campaigns: DataFrame) -> DataFrame:
    n = A.n_reporters(F.col("reporters"))
    out = campaigns.withColumns({"n_reporters": n, **A.reporter_indicators(F.col("reporters"))}).withColumn("n_reporters_stratum", A.reporter_stratum(F.col("n_reporters")))
    return out.withColumn("ecosystem_x_n_reporters", F.concat_ws("|", "ecosystem", "n_reporters_stratum"))


def prefix_pairs(campaigns: DataFrame, text: str, equal: int = 120, length: int = 200) -> DataFrame:
    """Pairs that may be one campaign: same stratum, the first `equal` characters alike, the first `length` not.

    An equi-join on the prefix; texts alike in all `length` characters are one row
    first, so a common text makes no pairs with itself.
    """
    base = campaigns.where(F.length(text) >= equal).select("ecosystem", F.substring(text, 1, equal).alias("prefix"), F.substring(text, 1, length).alias("head"), "_seq")
    heads = base.groupBy("ecosystem", "prefix", "head").agg(F.min("_seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    a, b = heads.alias("a"), heads.alias("b")
    near = a.join(b, (F.col("a.ecosystem") == F.col("b.ecosystem")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.seq") < F.col("b.seq")))
    return near.select(F.col("a.ecosystem").alias("ecosystem"), F.col("a.seq").alias("first_seq"), F.col("b.seq").alias("second_seq"), (F.col("a.n") * F.col("b.n")).alias("n_pairs"), (A.diverge_at(F.col("a.head"), F.col("b.head"))).alias("diverge_at"))


def merges_of(fine: DataFrame, coarse: DataFrame, member: str, group: str) -> DataFrame:
    """Coarse groups that join two or more fine ones."""
    both = coarse.select(member, F.col(group).alias("coarse_group")).join(fine.select(F.col(member).alias("m"), F.col(group).alias("fine_group")), F.col(member) == F.col("m"))
    return both.groupBy("coarse_group").agg(F.countDistinct("fine_group").alias("n_fine")).where("n_fine >= 2")
