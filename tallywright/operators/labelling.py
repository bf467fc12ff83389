"""Regex taxonomies over texts: flags, categories, match spans, context and negation, all as Columns.

Java's functions return no positions. The stretches between matches (`split`) and
the matches (`regexp_extract_all`) do: their lengths add up to code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import fixed
from tallywright.operators import literals

#: Case-blind with Unicode classes; a dot stops at line feeds alone.
UNICODE, ASCII = "(?iuUd)", "(?i)"
MATCHES = "array<struct<category:string,pattern:string,start:int,end:int,hit:string>>"


def spans(text: Column, category: str, pattern: str, mode: str = UNICODE) -> Column:
    """All matches of one pattern, left to right, as structs."""
    rx = mode + pattern
    hits = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    pairs = F.zip_with(hits, F.slice(F.split(text, rx, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))

    def step(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        one = F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern"), start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(rx), found).otherwise(F.array().cast(MATCHES))


def is_negated(text: Column, start: Column, cues=fixed.NEGATION_CUES, breaks=fixed.NEGATION_BREAKS, window: int = fixed.NEGATION_WINDOW, mode: str = UNICODE) -> Column:
    """Whether a cue lies wholly in the window before `start` with no break after it.

    The character before the window is looked at, so that a cue cut in two by the
    window's edge does not count, nor one that begins inside a word.
    """
    edge = start > window
    before = F.substring(text, F.greatest(start - window, F.lit(1)), F.least(start, F.lit(window + 1)))
    tail = rf"[\s\S]*?\b(?:{'|'.join(cues)})\b(?![\s\S]*(?:{'|'.join(breaks)}))"
    return F.when(edge, before.rlike(rf"{mode}\A[\s\S]{tail}")).otherwise(before.rlike(rf"{mode}\A{tail}"))


def matches(text: Column, taxonomy: dict[str, list[str]], negation: bool = True, mode: str = UNICODE, **rule) -> Column:
    text = F.coalesce(text, F.lit(""))
    every = [spans(text, c, p, mode) for c, ps in taxonomy.items() for p in ps]
    found = F.concat(*every) if every else F.array().cast(MATCHES)
    return F.filter(found, lambda m: ~is_negated(text, m["start"], mode=mode, **rule)) if negation else found


def labelled(records: DataFrame, text: str, taxonomy=fixed.MECHANISMS, context: int = 80, negation: bool = True, mode: str = UNICODE, **rule) -> DataFrame:
    """`records` with matches (context included), categories (sorted) and flag. No shuffle, no Python."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return _finished(records.withColumn("matches", matches(whole, taxonomy, negation, mode, **rule)), whole, context)


def labelled_by_literals(records: DataFrame, text: str, taxonomy=fixed.MECHANISMS, context: int = 80, negation: bool = True, **rule) -> DataFrame:
    """As `labelled`, with the matches of Python's `re` found by `literals`, and n_searched, the patterns a text was searched for.

    For large taxonomies: `labelled` searches every text for every pattern. No shuffle.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = records.withColumn("_found", literals.found(whole, taxonomy))
    every = F.col("_found.matches")
    left = F.filter(every, lambda m: ~is_negated(whole, m["start"], **rule)) if negation else every
    return _finished(rows.withColumn("matches", left).withColumn("n_searched", F.col("_found.n_searched")).drop("_found"), whole, context)


def _finished(rows: DataFrame, whole: Column, context: int) -> DataFrame:
    lo = lambda m: F.greatest(m["start"] - context, F.lit(0))
    around = F.transform("matches", lambda m: m.withField("context", F.substring(whole, lo(m) + 1, m["end"] + context - lo(m))))
    rows = rows.withColumn("matches", around)
    return rows.withColumn("categories", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["category"])))).withColumn("flag", F.size("matches") > 0)


def flags(text: Column, taxonomy: dict[str, list[str]], mode: str = UNICODE) -> dict[str, Column]:
    """Category -> whether any of its patterns occurs, without negation: one search per category."""
    return {c: (F.coalesce(text, F.lit("")).rlike(mode + "(?:" + "|".join(f"(?:{p})" for p in ps) + ")") if ps else F.lit(False)) for c, ps in taxonomy.items()}


def summary(rows: DataFrame) -> DataFrame:
    """category, n, rate over labelled rows; the row without a category has the flagged ones."""
    counted = rows.select(F.explode(F.concat(F.transform("categories", lambda c: c), F.when(F.col("flag"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))).alias("category"))
    total = rows.agg(F.count(F.lit(1)).alias("n_records"))
    return counted.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).withColumn("rate", F.when(F.col("n_records") > 0, F.col("n") / F.col("n_records")).otherwise(0.0))


def negation_drops(records: DataFrame, text: str, taxonomy=fixed.MECHANISMS, mode: str = UNICODE, cues=fixed.NEGATION_CUES, **rule) -> DataFrame:
    """cue, n: matches that negation drops, by the cue nearest before them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    every = records.select(whole.alias("whole"), F.explode(matches(whole, taxonomy, False, mode)).alias("m"))
    dropped = every.where(is_negated(F.col("whole"), F.col("m.start"), cues=cues, mode=mode, **rule))
    before = F.substring("whole", F.greatest(F.col("m.start") - rule.get("window", fixed.NEGATION_WINDOW) + 1, F.lit(1)), F.least(F.col("m.start"), F.lit(rule.get("window", fixed.NEGATION_WINDOW))))
    last = F.element_at(F.regexp_extract_all(F.lower(before), F.lit(rf"{mode}\b(?:{'|'.join(cues)})\b"), F.lit(0)), -1)
    return dropped.select(last.alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n"))


def negation_drops_by_rule(records: DataFrame, text: str, taxonomy=fixed.MECHANISMS, mode: str = UNICODE, cues=fixed.NEGATION_CUES, earlier=fixed.EARLIER_NEGATION_CUES, **rule) -> DataFrame:
    """rule, cue, n: what the present rule drops and what the earlier one dropped.

    The earlier rule has cues of its own, knows no breaks, looks at the window alone
    (its edge ends a word) and credits the first cue in it.
    """
    now = negation_drops(records, text, taxonomy, mode, cues, **rule).withColumn("rule", F.lit("now"))
    window = rule.get("window", fixed.NEGATION_WINDOW)
    whole = F.coalesce(F.col(text), F.lit(""))
    every = records.select(whole.alias("whole"), F.explode(matches(whole, taxonomy, False, mode)["start"]).alias("start"))
    before = F.substring("whole", F.greatest(F.col("start") - window, F.lit(0)) + 1, F.least(F.col("start"), F.lit(window)))
    first = F.regexp_extract(F.lower(before), rf"{mode}\b(?:{'|'.join(earlier)})\b", 0)
    then = every.select(first.alias("cue")).where("cue <> ''").groupBy("cue").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("before"))
    return then.unionByName(now).select("rule", "cue", "n")
