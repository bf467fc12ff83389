"""Advisory texts as Columns: reporters, templates, tags, masks and campaign signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import fixed

#: Lines end at line feeds only, as where the patterns come from; `m` for line anchors.
LINES, PLAIN = "(?dm)", "(?d)"


def stripped(text: Column) -> Column:
    """Without white space at both ends; the pattern, slow on long texts, is only run where an end has some."""
    open_end = F.substring(text, 1, 1).rlike(r"(?U)\s") | F.substring(text, -1, 1).rlike(r"(?U)\s")
    return F.when(open_end, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def combined_text(summary: Column, description: Column) -> Column:
    return F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))


def record_text(summary: Column, description: Column) -> Column:
    empty = F.lit("")
    return stripped(F.coalesce(F.nullif(description, empty), summary, empty))


def reporters(text: Column) -> Column:
    """Names from source headers in order, digests cut, then the boilerplate's marker; one marker for other text."""
    text = F.coalesce(text, F.lit(""))
    named = F.transform(F.regexp_extract_all(text, F.lit(LINES + fixed.REPORTER_HEADER), F.lit(1)), lambda r: stripped(F.regexp_replace(r, fixed.REPORTER_DIGEST, "")))
    found = F.concat(named, F.when(F.contains(text, F.lit(fixed.BOILERPLATE_PHRASE)), F.array(F.lit(fixed.BOILERPLATE_MARKER))).otherwise(F.array().cast("array<string>")))
    blank = stripped(text) == ""
    return F.when((F.size(found) == 0) & ~blank, F.array(F.lit(fixed.UNATTRIBUTED))).otherwise(found)


def aliased(names: Column) -> Column:
    alike = F.array(*[F.lit(a) for a in fixed.BOILERPLATE_ALIASES])
    return F.array_distinct(F.transform(names, lambda r: F.when(F.array_contains(alike, r), F.lit(fixed.BOILERPLATE_MARKER)).otherwise(r)))


def n_reporters(names: Column) -> Column:
    return F.size(aliased(names))


def reporter_indicators(names: Column) -> dict[str, Column]:
    alike = F.array(*[F.lit(a) for a in fixed.BOILERPLATE_ALIASES])
    known = F.array(*[F.lit(a) for a in fixed.BOILERPLATE_ALIASES + fixed.NAMED_REPORTERS])
    return {
        "has_kam193": F.array_contains(names, "kam193"),
        "has_amazon_inspector": F.array_contains(names, "amazon-inspector"),
        "has_other": F.exists(names, lambda r: ~F.array_contains(known, r)),
        "has_boilerplate": F.arrays_overlap(names, alike),
    }


def reporter_stratum(n: Column) -> Column:
    return F.when(n >= 2, "2+").otherwise(n.cast("string"))


def without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, LINES + p, "")
    return text


def is_no_text(text: Column) -> Column:
    """Whether nothing is left without credit, separator and rule lines; a text with none of their literals has no such line."""
    text = F.coalesce(text, F.lit(""))
    rest = without(text, fixed.CREDIT_LINE, fixed.SEPARATOR_LINE, fixed.RULE_LINE)
    some = F.contains(text, F.lit("Credit:")) | F.contains(text, F.lit("_-= Per source details.")) | F.contains(text, F.lit("---"))
    return some & (stripped(text) != "") & (stripped(rest) == "")


def is_one_liner(text: Column) -> Column:
    """Whether one sentence is all that is left without those lines; they go whole, so its words stand in the text as they are."""
    text = F.coalesce(text, F.lit(""))
    rest = without(text, fixed.SOURCE_LINE, fixed.CREDIT_LINE, fixed.SEPARATOR_LINE, fixed.RULE_LINE)
    return text.rlike("(?iuUd)was found to contain malicious code") & stripped(rest).rlike(rf"(?iuUd)^(?:{fixed.ONE_LINER})\z")


def campaign_tags(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit("(?U)" + LINES + fixed.CAMPAIGN_LINE), F.lit(1))
    return F.array_distinct(F.when(F.contains(text, F.lit("Campaign:")), found).otherwise(F.array().cast("array<string>")))


def mask_name(text: Column, name: Column) -> Column:
    """Whole-name occurrences, in any case, replaced; the name is quoted inside a pattern per row."""
    edge = fixed.NAME_CHARACTER
    quoted = F.concat(F.lit(rf"(?iu)(?<!{edge})\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{edge})"))
    return F.when(F.coalesce(name, F.lit("")) == "", text).otherwise(F.regexp_replace(text, quoted, F.lit(fixed.PACKAGE_MASK)))


def signature_text(text: Column, name: Column, mask: bool = True, urls: bool = True) -> Column:
    """`text` as record_text gives it, without source headers, name and links masked."""
    out = stripped(without(text, fixed.SOURCE_LINE_AND_END))
    out = mask_name(out, name) if mask else out
    return F.when(F.contains(text, F.lit("://")), F.regexp_replace(out, "(?U)" + fixed.URL, fixed.URL_MASK)).otherwise(out) if urls else out


def signature(text: Column, name: Column, length: int = 200, use_tag: bool = True, mask: bool = True, generic_apart: bool = True, urls: bool = True, one_liner_apart: bool = True) -> Column:
    """The key that groups a record within its stratum: its campaign tags, its own name, or how its text begins."""
    tags = campaign_tags(text)
    generic = F.array(*[F.lit(t) for t in fixed.GENERIC_TAGS])
    specific = F.array_sort(F.array_except(tags, generic))
    apart = F.contains(text, F.lit(fixed.BOILERPLATE_PHRASE)) | is_no_text(text)
    if one_liner_apart:
        apart = apart | is_one_liner(text)
    if generic_apart:
        apart = apart | ((F.size(tags) > 0) & (F.size(specific) == 0))
    by_text = F.substring(signature_text(text, name, mask, urls), 1, length)
    key = F.when(apart, F.concat(F.lit("__noboilerplate__:"), name)).otherwise(by_text)
    return F.when(F.size(specific) > 0, F.concat(F.lit("__campaign__:"), F.array_join(specific, "|"))).otherwise(key) if use_tag else key


def signature_type(key: Column) -> Column:
    return F.when(key.startswith("__campaign__:"), "campaign_tag").when(key.startswith("__noboilerplate__:"), "own_package").otherwise("text_prefix")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; two empty ones are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def diverge_at(a: Column, b: Column) -> Column:
    """First place where two texts differ, or the shorter's length."""
    shorter = F.least(F.length(a), F.length(b))
    differs = F.transform(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.array_position(differs, True).cast("int")
    return F.when((shorter == 0) | (first == 0), shorter).otherwise(first - 1)


def excerpt(text: Column, start: Column, length: int = 100, lead: int = 20) -> Column:
    at = F.when(start < lead, 0).otherwise(start)
    return F.replace(F.regexp_replace(stripped(F.substring(text, at + 1, F.lit(length))), r"(?U)\s+", " "), F.lit("|"), F.lit(r"\|"))


def snippet(text: Column, start: Column, end: Column, around: int = 100) -> Column:
    lo, hi = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    return F.concat(
        F.when(lo > 0, "…").otherwise(""), F.substring(text, lo + 1, start - lo), F.lit("⟦"), F.substring(text, start + 1, end - start), F.lit("⟧"),
        F.substring(text, end + 1, hi - end), F.when(hi < F.length(text), "…").otherwise(""),
    )


def in_tag_list(text: Column, start: Column) -> Column:
    """Whether the nearest tag header before `start` is not closed by a rule."""
    before = F.substring(text, F.lit(1), start)
    return F.contains(before, F.lit(fixed.TAG_HEADER)) & ~F.contains(F.substring_index(before, fixed.TAG_HEADER, -1), F.lit("---"))


def categories_named(categories: list[str], *texts: Column) -> Column:
    joined = F.concat_ws(" ", *texts)
    return F.filter(F.array(*[F.lit(c) for c in categories]), lambda c: F.contains(joined, c))


def instant(rows: DataFrame, name: str) -> Column:
    """A column as a timestamp: as it is where it has a type of time, else parsed; null where it is neither."""
    kind = rows.schema[name].dataType.typeName()
    return F.col(name).cast("timestamp") if kind in ("timestamp", "timestamp_ntz", "date") else F.try_to_timestamp(F.col(name).cast("string"))


def month(timestamp: Column) -> Column:
    return F.date_format(F.try_to_timestamp(timestamp), "yyyy-MM")
