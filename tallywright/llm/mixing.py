"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sizes are words. Sources, ranked by code point with null last, weigh 5, 2, 1,
repeating; together they are to hold as many words as all documents do. A
source's target stops at three times its size and the excess goes to the others
by weight until none is above: targets are min(cap, level * weight), the level
found in one pass over the sources sorted by cap / weight.

Within a source every document draws an exponential key -ln(u) / weight, u from
a digest of its id, the weight from its quality, and is taken in key order.
Whole epochs come first: floor(target / size) copies of every document. The rest
of the budget is filled in key order up to the first document that does not fit;
then either that document or the largest one that still fits is taken, whichever
brings the source nearer to its target.

The order within a source is never sorted in one task. Keys are cut into ranges
(a monotone map of the key), range totals are summed first, and only the one
range in which the budget runs out is sorted. A source with a third of all rows
is spread over all ranges.

Defined cases: a null or wordless text has size 0 and is never taken; a null
source is a source of its own; ties of keys and repeated ids are ordered by the
text's digest; identical rows are told apart by a row number written with them; if nothing has
a word, every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import WORD, kept
from tallywright.session import table

WEIGHTS, CAP = (5, 2, 1), 3
#: A source of n rows is cut into about n to this power ranges, so that ranges and rows in a range grow alike.
RANGE_POWER = 0.5
#: Parts of an octave that weights are told apart by.
OCTAVE = 4


def words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: ordinary prose has about six characters a word; lists, junk and joined text stray from it."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(F.length(text).cast("double") / size.cast("double") - F.lit(6.0)))


def uniform(doc_id: Column, seed: str) -> Column:
    """(0, 1) from the first 52 bits of a digest of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def drawn(docs: DataFrame, weight: Column | None = None, seed: str = "mix:") -> DataFrame:
    """Slim rows of `docs`: mix_source, mix_size, mix_key, mix_octave (the part of an octave of the weight), mix_tie and the id. No text travels further."""
    size = words(F.col("text"))
    base = docs.select(F.col("doc_id"), F.col("source").alias("mix_source"), F.col("text"), size.alias("mix_size"))
    w = quality(F.col("text"), F.col("mix_size")) if weight is None else weight
    key = F.when(F.col("mix_size") > 0, -F.ln(uniform(F.col("doc_id"), seed)) / w)
    octave = F.when(F.col("mix_size") > 0, F.floor(F.log2(w) * OCTAVE)).cast("int")
    return base.select("doc_id", "mix_source", "mix_size", key.alias("mix_key"), octave.alias("mix_octave"), F.xxhash64("text").alias("mix_tie"), F.monotonically_increasing_id().alias("mix_row"))


#: Sources whose plan is sent to every task and ranked in one; with more, the plan is joined by a shuffle and ranked by ranges.
BROADCAST_SOURCES = 20_000


def before(rows: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """`rows` with the sums over all rows before each in `order`; many rows are dealt by ranges, whose totals are summed first."""
    def upto(window):
        return [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(n) for n, c in sums.items()]

    if few:
        return rows.select("*", *upto(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    ranged = kept(rows.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "mix-ranked")
    heads = ranged.groupBy(F.col("run").alias("of_run")).agg(*[F.sum(c).alias(f"in_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("of_run").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    heads = heads.select("of_run", *[F.coalesce(F.sum(f"in_{n}").over(earlier), F.lit(0)).alias(f"head_{n}") for n in sums])
    inner = ranged.select("*", *upto(Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    met = inner.join(F.broadcast(heads), F.col("run") == F.col("of_run"))
    return met.select(*rows.columns, *[(F.col(n) + F.col(f"head_{n}")).alias(n) for n in sums])


def targets(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> tuple[DataFrame, bool]:
    """One row a source: its size, rows and target; and whether sources are few."""
    each = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    each = kept(each, "mix-sources")
    few = each.count() <= BROADCAST_SOURCES
    each = before(each, [F.col("mix_source").asc_nulls_last()], {"rank": F.lit(1)}, few)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    each = each.select("*", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("limit"))
    ratio = F.col("limit") / F.col("weight")
    each = before(each.withColumn("ratio", ratio), [F.col("ratio"), F.col("mix_source").asc_nulls_first()], {"limits_before": F.col("limit"), "weight_before": F.col("weight")}, few)
    whole = each.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(whole["size"] or 0)) - F.col("limits_before")) / (F.lit(float(whole["weight"] or 1)) - F.col("weight_before"))
    # the level rises while sources are capped; the first source whose own cap lies above it fixes it
    fixed = each.where(level * F.col("weight") <= F.col("limit")).agg(F.min_by(level, "ratio").alias("level")).first()["level"]
    open_target = F.col("limit") if fixed is None else F.lit(fixed) * F.col("weight")
    return each.select(
        "mix_source", "source_size", "source_rows",
        F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("limit"), open_target)).alias("target"),
    ), few


def with_plan(rows: DataFrame, plan: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    right = plan.withColumnRenamed("mix_source", "plan_source")
    joined = rows.join(F.broadcast(right) if few else right, F.col("mix_source").eqNullSafe(F.col("plan_source")), how)
    return joined.drop("plan_source")


#: The order documents are taken in; the last part tells rows apart that are alike in all.
ORDER = ("mix_key", "doc_id", "mix_tie", "mix_row")


def shapes(rows: DataFrame) -> DataFrame:
    """Of each source with words: which share of its documents has a weight in which part of an octave."""
    octaves = rows.where("mix_size > 0").groupBy(F.col("mix_source").alias("shape_source"), "mix_octave").agg(F.count(F.lit(1)).alias("n"))
    of = octaves.groupBy("shape_source").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("mix_octave", "n"))).alias("list"))
    share = lambda x: F.struct(F.pow(F.lit(2.0), (x["mix_octave"] + 0.5) / OCTAVE).alias("rate"), (x["n"] / F.col("all")).alias("share"))
    return of.select(F.col("shape_source").alias("mix_source"), F.transform("list", share).alias("shape"))


def placed_in(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's plan and mix_range: a monotone map of the key to a range of the source.

    A key is exponential at the rate of its document's weight, so the distribution of a source's
    keys follows from its weights' octaves, and ranges of equal probability hold about equally many.
    """
    key = F.col("mix_key")
    below = F.aggregate("shape", F.lit(0.0), lambda s, x: s + x["share"] * (F.lit(1.0) - F.exp(-key * x["rate"])))
    place = F.least(F.floor(below * F.col("ranges")), F.col("ranges") - 1)
    return with_plan(rows, plan, few).withColumn("mix_range", F.when(F.col("mix_size") > 0, place))


def first_part(order) -> Column:
    """Whether a row comes before the document its source's budget ran out in."""
    this, stop = F.struct(*order), F.struct(*[F.col(f"next.{c}").alias(c) for c in order])
    in_cut = (F.col("mix_range") == F.col("cut_range")) & (this < stop)
    return F.coalesce((F.col("mix_size") > 0) & ((F.col("mix_range") < F.col("cut_range")) | in_cut), F.lit(False))


def words_taken(order=ORDER) -> Column:
    last = F.lit(True)
    for c in order:
        last = last & F.col(c).eqNullSafe(F.col(f"last.{c}"))
    once_more = first_part(order) | (F.col("last.mix_size").isNotNull() & last)
    return ((F.col("epochs") + once_more.cast("long")) * F.col("mix_size")).cast("long")


def plan_of(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> tuple[DataFrame, bool]:
    """One row a source: target, epochs, and where its budget runs out; whether they are few enough to broadcast."""
    plan, few = targets(rows, weights, cap)
    size, rest, cut = F.col("mix_size"), F.col("rest"), F.col("cut_range")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("ranges", F.ceil(F.pow(F.col("source_rows").cast("double"), F.lit(RANGE_POWER))))
    plan = kept(with_plan(plan, shapes(rows), few, "left"), "mix-shapes")

    # where each source's budget runs out: range totals first
    ranged = placed_in(rows, plan.select("mix_source", "ranges", "shape"), few).select("mix_source", "mix_range", "mix_size")
    totals = ranged.where(size > 0).groupBy("mix_source", "mix_range").agg(F.sum(size).alias("range_size"))
    totals = with_plan(totals, plan.select("mix_source", "rest"), few)
    upto = Window.partitionBy("mix_source").orderBy("mix_range")
    ends = totals.withColumn("end", F.sum("range_size").over(upto)).where(F.col("end") > rest)
    cuts = ends.groupBy("mix_source").agg(F.min(F.struct("mix_range", (F.col("end") - F.col("range_size")).alias("before"))).alias("c"))
    plan = kept(with_plan(plan, cuts.select("mix_source", F.col("c.mix_range").alias("cut_range"), F.col("c.before").alias("before")), few, "left"), "mix-cuts")

    # only that range of each source is put in key order
    running = Window.partitionBy("mix_source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed_in(rows, plan, few).where(F.col("mix_range") == cut).withColumn("end", F.col("before") + F.sum(size).over(running))
    stops = edge.groupBy("mix_source").agg(
        F.coalesce(F.max(F.when(F.col("end") <= rest, F.col("end"))), F.first("before")).alias("filled"),
        F.min(F.when(F.col("end") > rest, F.struct(*ORDER, size))).alias("next"),
    )
    plan = kept(with_plan(plan, stops, few, "left").withColumn("gap", rest - F.col("filled")), "mix-stops")

    # what is left of the budget: the document it ran out in, or the largest that fits
    outside = (size > 0) & F.col("mix_range").isNotNull() & cut.isNotNull() & ~first_part(ORDER) & (size <= F.col("gap"))
    fitting = placed_in(rows, plan, few).where(outside).groupBy("mix_source").agg(
        F.max_by(F.struct(*ORDER, size), F.struct(size, -F.col("mix_key"), -F.col("mix_row"))).alias("filler"))
    plan = with_plan(plan, fitting, few, "left")
    left = F.col("gap") - F.coalesce(F.col("filler.mix_size"), F.lit(0))
    last = F.when(F.col("next.mix_size") - F.col("gap") < left, F.col("next")).otherwise(F.col("filler"))
    return kept(plan.withColumn("last", last), "mix-plan"), few


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, weight: Column | None = None, seed: str = "mix:") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every document."""
    rows = kept(drawn(docs, weight, seed), "mix-rows")
    plan, few = plan_of(rows, weights, cap)
    return placed_in(rows, plan, few).select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), "source_size", "target", words_taken().alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Reads what `mix` computes: the same digests, keys and choices, with one window a source instead of ranges.
SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, length(text) AS n,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN -ln(u) / (1.0 / (1.0 + abs(n::DOUBLE / size::DOUBLE - 6.0))) END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s),
w AS (SELECT source, source_size, CASE turn WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
b AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps_before,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weight_left FROM w),
l AS (SELECT *, (SELECT min_by((budget - caps_before) / weight_left, cap / weight) FROM b WHERE (budget - caps_before) / weight_left * weight <= cap) AS level FROM b),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce(level * weight, cap)) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(size) FILTER (WHERE size > 0) OVER (PARTITION BY k.source ORDER BY (size > 0) DESC, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
g AS (SELECT source, coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS filled, min({'key': key, 'doc_id': doc_id, 'size': size}) FILTER (WHERE upto > rest) AS nxt, any_value(rest) AS rest FROM p WHERE size > 0 GROUP BY source),
f AS (SELECT p.source, max({'size': p.size, 'key': -p.key, 'doc_id': -p.doc_id}) AS filler FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
      WHERE p.size > 0 AND p.upto > p.rest AND p.size <= g.rest - g.filled GROUP BY p.source),
c AS (SELECT g.source, CASE WHEN g.nxt.size - (g.rest - g.filled) < (g.rest - g.filled) - coalesce(f.filler.size, 0) THEN g.nxt.doc_id ELSE -f.filler.doc_id END AS last_id
      FROM g LEFT JOIN f ON g.source IS NOT DISTINCT FROM f.source)
SELECT p.doc_id, p.size, p.source_size, p.target,
       ((p.epochs + CASE WHEN p.size > 0 AND (p.upto <= p.rest OR p.doc_id = c.last_id) THEN 1 ELSE 0 END) * p.size)::BIGINT AS taken
FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it takes 0 times go. Columns as they came.

    The plan is read against the documents in place, so no text is shuffled; rows
    alike in id and text are taken alike.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    plan, few = plan_of(kept(drawn(docs), "mix-rows"))
    rows = docs.select(*columns, F.col("source").alias("mix_source"), words(F.col("text")).alias("mix_size"))
    key = F.when(F.col("mix_size") > 0, -F.ln(uniform(F.col("doc_id"), "mix:")) / quality(F.col("text"), F.col("mix_size")))
    rows = rows.withColumns({"mix_key": key, "mix_tie": F.xxhash64("text")})
    copies = F.floor(words_taken(ORDER[:3]) / F.col("mix_size")).cast("int")
    taken = placed_in(rows, plan, few).where("mix_size > 0").withColumn("copies", copies).where("copies > 0")
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
