"""Names as Columns: normal form, grammar classes, families, near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import fixed

ALPHABET = "abcdefghijklmnopqrstuvwxyz-_"


def normalised(name: Column) -> Column:
    return F.translate(F.lower(name), "/@", "-")


def parts(name: Column) -> Column:
    """Non-empty parts between hyphens and underscores; a dot separates nothing."""
    return F.filter(F.split(F.translate(normalised(name), "_", "-"), "-"), lambda p: p != "")


def grammar(name: Column, suffixes=fixed.COMPOUND_SUFFIXES, prefixes=fixed.COMPOUND_PREFIXES, trends=fixed.TREND_SUFFIXES) -> Column:
    """struct(compound_suffixes, compound_prefixes, trend_suffixes, is_flagged, pattern_type).

    A listed token counts wherever it equals a whole part, so one that holds a
    hyphen never does.
    """
    own = parts(name)
    met = lambda words: F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.array_contains(own, w))
    a, b, c = met(suffixes), met(prefixes), met(trends)
    compound, trend = (F.size(a) + F.size(b)) > 0, F.size(c) > 0
    kind = F.when(compound & trend, "both").when(trend, "trend").when(compound, "compound").otherwise("none")
    return F.struct(a.alias("compound_suffixes"), b.alias("compound_prefixes"), c.alias("trend_suffixes"), (compound | trend).alias("is_flagged"), kind.alias("pattern_type"))


def family(name: Column, affixes=fixed.FAMILY_AFFIXES, least: int = 4) -> Column:
    """The name without any known affix next to a separator, or itself where too little would be left."""
    low = F.lower(name)
    stem = low
    for affix in affixes:
        for mark in "-_.":
            stem = F.replace(F.replace(stem, F.lit(mark + affix), F.lit("")), F.lit(affix + mark), F.lit(""))
    stem = F.regexp_replace(stem, r"^[-_.]+|[-_.]+$", "")
    return F.when(F.length(stem) < least, low).otherwise(stem)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; case counts."""
    return F.levenshtein(a, b)


def squats(names: DataFrame, name: str, real: DataFrame, real_name: str) -> DataFrame:
    """(name, near): names that are not real ones, with each real name one edit or swap of neighbours away.

    Two such names have the name itself or one of its one-letter deletions in common,
    so both sets are joined on those, some length + 1 keys a name; a key has no more names than the
    letters there are times its length. What joins is checked.
    """

    def keyed(rows, column, out):
        one = rows.select(F.col(column).alias(out)).where(F.col(column).isNotNull()).distinct()
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(out), F.lit(1))), lambda i: F.concat(F.substring(F.col(out), F.lit(1), i - 1), F.substring(F.col(out), i + 1, F.length(out))))
        return one.select(out, F.explode(F.array_distinct(F.concat(F.array(F.col(out)), cut))).alias(f"{out}_key"))

    own, known = keyed(names, name, "name"), keyed(real, real_name, "near")
    met = own.join(known, F.col("name_key") == F.col("near_key")).where("name <> near").select("name", "near").distinct()
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), i, F.lit(1)) != F.substring(F.col("near"), i, F.lit(1))), True).cast("int")
    turned = F.concat(F.substring(F.col("name"), F.lit(1), at - 1), F.substring(F.col("name"), at + 1, F.lit(1)), F.substring(F.col("name"), at, F.lit(1)), F.substring(F.col("name"), at + 2, F.length("name")))
    swapped = (F.length("name") == F.length("near")) & (turned == F.col("near"))
    close = met.where((F.levenshtein("name", "near", 1) == 1) | swapped)
    return close.join(known.select(F.col("near").alias("known")).distinct(), F.col("name") == F.col("known"), "left_anti")


def near_misses(names: DataFrame, name: str, real: DataFrame, real_name: str) -> DataFrame:
    """(name, candidate) of every single edit or swap of a name that is not itself real, 2 to 60 characters long."""
    at = F.explode(F.sequence(F.lit(0), F.length("name"))).alias("i")
    base = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().select("name", at)
    head, tail = F.substring("name", F.lit(1), F.col("i")), lambda k: F.substring(F.col("name"), F.col("i") + 1 + k, F.length("name"))
    letters = F.explode(F.array(*[F.lit(c) for c in ALPHABET])).alias("c")
    lettered = base.select("name", "i", letters)
    inner = F.col("i") < F.length("name")
    edits = [
        lettered.where(inner).select("name", F.concat(head, F.col("c"), tail(1)).alias("candidate")),
        lettered.select("name", F.concat(head, F.col("c"), tail(0)).alias("candidate")),
        base.where(inner).select("name", F.concat(head, tail(1)).alias("candidate")),
        base.where(F.col("i") < F.length("name") - 1).select("name", F.concat(head, F.substring(F.col("name"), F.col("i") + 2, F.lit(1)), F.substring(F.col("name"), F.col("i") + 1, F.lit(1)), tail(2)).alias("candidate")),
    ]
    found = edits[0]
    for more in edits[1:]:
        found = found.unionByName(more)
    found = found.distinct().where(F.levenshtein("name", "candidate").between(1, 2) & F.length("candidate").between(2, 60))
    known = real.select(F.col(real_name).alias("known")).distinct()
    return found.join(known, F.col("candidate") == F.col("known"), "left_anti")


def drawn_near_misses(names: DataFrame, name: str, real: DataFrame, real_name: str, n: int, seed: int = 0) -> DataFrame:
    """At most n near misses of each name, the least by a digest of seed, name and candidate, so that reruns agree."""
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), "name", "candidate"))
    order = F.row_number().over(Window.partitionBy("name").orderBy(turn, "candidate"))
    return near_misses(names, name, real, real_name).withColumn("turn", order).where(F.col("turn") <= n).drop("turn")
