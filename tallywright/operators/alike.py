"""Pairs inside groups without listing them: the least alike texts of a group, and heads that share a beginning.

Both give a row a group or a row a text, whatever the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import advisories as A

#: Token sets and tokens in a block, sets that make a cluster of their own, blocks a task meets at once, tasks of a group.
BLOCK, BLOCK_TOKENS, CLUSTER, MET, SALTS = 512, 400_000, 64, 16, 64
#: Token columns multiplied at once.
COLUMNS = 8192


def _blocks(sets: DataFrame, group: str) -> DataFrame:
    """`sets` (group, tokens, texts, seq) packed into bounded blocks: group, block and the lists of its sets.

    Sets whose two least token hashes agree are likely to be alike; where there are
    enough of them they share blocks, so that what all sets of a block hold is much.
    """
    low = F.slice(F.array_sort("tokens"), 1, 2)
    marked = sets.withColumn("cluster", F.xxhash64(low))
    many = marked.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("of_cluster")).where(F.col("of_cluster") >= CLUSTER).select(F.col(group).alias("_g"), F.col("cluster").alias("_c"))
    own = marked.join(many, (F.col(group) == F.col("_g")) & (F.col("cluster") == F.col("_c")), "left").withColumn("cluster", F.col("_c")).drop("_g", "_c")
    totals = own.groupBy(group, "cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int").alias("parts"))
    totals = totals.select(F.col(group).alias("_g"), F.col("cluster").alias("_c"), "parts")
    dealt = own.join(totals, (F.col(group) == F.col("_g")) & F.col("cluster").eqNullSafe(F.col("_c")))
    block = F.xxhash64("cluster", F.pmod(F.xxhash64("seq"), "parts"))
    return dealt.withColumn("block", block).groupBy(group, "block").agg(F.collect_list(F.struct("tokens", "texts", "seq")).alias("sets"))


def _summaries(blocks: DataFrame, group: str) -> DataFrame:
    """What decides pairs of blocks: tokens that all sets of one hold, that any holds, the largest set, texts and least place."""

    def run(batches):
        for batch in batches:
            rows = []
            for cell in batch.column(2):
                s = cell.values
                lists, sizes = s.field("tokens"), np.diff(s.field("tokens").offsets.to_numpy())
                found, times = np.unique(lists.flatten().to_numpy(), return_counts=True)
                rows.append((found[times == len(sizes)], found, int(sizes.max(initial=0)), int(s.field("texts").to_numpy().sum()), int(s.field("seq").to_numpy().min())))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [batch.schema.names[0], "block", "core", "any", "most", "texts", "least"])

    kind = blocks.schema[group].dataType.simpleString()
    return blocks.select(group, "block", "sets").mapInArrow(run, f"`{group}` {kind}, block long, core array<long>, any array<long>, most int, texts long, least long")


def _met(pairs: DataFrame, group: str, below: float) -> DataFrame:
    """(group, n_low, similarity, first_seq, second_seq) of each pair of blocks (`one`, `two`, `same`), by products of their token matrices."""

    def matrices(a, b):
        """Pieces of the two blocks' incidence matrices, COLUMNS tokens at a time."""
        sides = []
        for s in (a, b):
            lists = s.field("tokens")
            offsets = lists.offsets.to_numpy()
            sides.append((np.repeat(np.arange(len(s)), np.diff(offsets)), lists.flatten().to_numpy(), len(s)))
        tokens = np.intersect1d(sides[0][1], sides[1][1])
        for start in range(0, len(tokens), COLUMNS):
            some = tokens[start : start + COLUMNS]
            out = []
            for row, value, n in sides:
                at = np.minimum(np.searchsorted(some, value), len(some) - 1)
                hit = some[at] == value
                m = np.zeros((n, len(some)), np.float32)
                m[row[hit], at[hit]] = 1
                out.append(m)
            yield out

    def run(batches):
        for batch in batches:
            groups, rows = [], []
            for g, one, two, same in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                a, b = one.values, two.values
                both = np.zeros((len(a), len(b)))
                for x, y in matrices(a, b):
                    both += x @ y.T
                size = lambda s: np.diff(s.field("tokens").offsets.to_numpy())
                either = size(a)[:, None] + size(b)[None, :] - both
                alike = np.where(either == 0, 1.0, both / np.maximum(either, 1))
                texts = a.field("texts").to_numpy()[:, None] * b.field("texts").to_numpy()[None, :]
                p, q = a.field("seq").to_numpy()[:, None], b.field("seq").to_numpy()[None, :]
                wanted = (alike < below) & ((p < q) if same else np.ones_like(alike, bool))
                if not wanted.any():
                    continue
                i, j = np.nonzero(wanted & (alike == alike[wanted].min()))
                first, second = np.minimum(p[i, 0], q[0, j]), np.maximum(p[i, 0], q[0, j])
                k = np.lexsort((second, first))[0]
                groups.append(g)
                rows.append((int(texts[wanted].sum()), float(alike[i[k], j[k]]), int(first[k]), int(second[k])))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.types[0]), *columns], [batch.schema.names[0], "n_low", "similarity", "first_seq", "second_seq"])

    kind = pairs.schema[group].dataType.simpleString()
    return pairs.select(group, "one", "two", "same").mapInArrow(run, f"`{group}` {kind}, n_low long, similarity double, first_seq long, second_seq long")


def least_alike(members: DataFrame, group: str, text: str, below: float = 0.5) -> DataFrame:
    """Per group the least similar pair of distinct texts (token Jaccard, ties by position) and how many pairs lie below.

    Texts of one token set count together. Sets are dealt to blocks, and blocks of a
    group meet by their summaries first: where what both blocks' sets all hold makes
    every pair alike, nothing is below; where they hold no token in common, every pair
    is at 0; only the other pairs of blocks are computed, by products of matrices.
    What leaves a pair of blocks is one row. Tokens are compared by 64-bit hashes.
    A null group or text takes no part.
    """
    hashed = F.transform(A.tokens(F.col(text)), lambda t: F.xxhash64(t))
    texts = members.where(F.col(group).isNotNull() & F.col(text).isNotNull()).groupBy(group, text).agg(F.min("_seq").alias("seq"))
    sets = texts.select(group, "seq", F.array_sort(hashed).alias("tokens")).groupBy(group, "tokens").agg(F.count(F.lit(1)).alias("texts"), F.min("seq").alias("seq"))
    blocks = _blocks(sets, group).persist()
    about = _summaries(blocks, group)
    salts = about.groupBy(group).agg(F.least(F.ceil(F.count(F.lit(1)) / MET), F.lit(SALTS)).cast("int").alias("salts")).select(F.col(group).alias("_g"), "salts")
    about = about.join(salts, F.col(group) == F.col("_g")).drop("_g")
    one = about.select(group, *[F.col(c).alias(f"{c}_1") for c in ("block", "core", "any", "most", "texts", "least")], F.pmod("block", "salts").alias("salt"))
    two = about.select(F.col(group).alias("_g"), *[F.col(c).alias(f"{c}_2") for c in ("block", "core", "any", "most", "texts", "least")], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
    pairs = one.join(two, (F.col(group) == F.col("_g")) & (F.col("salt") == F.col("_salt")) & (F.col("block_1") <= F.col("block_2")))
    shared = F.size(F.array_intersect("core_1", "core_2"))
    alike = shared >= below * (F.col("most_1") + F.col("most_2") - shared)  # even for the largest sets
    apart = ~F.arrays_overlap("any_1", "any_2") & (F.col("block_1") != F.col("block_2"))
    decided = pairs.select(group, "block_1", "block_2", alike.alias("alike"), apart.alias("apart"), (F.col("texts_1") * F.col("texts_2")).alias("n"), F.least("least_1", "least_2").alias("p"), F.greatest("least_1", "least_2").alias("q"))
    # a block of empty sets alone has core and tokens of none, and no other block holds such a set
    far = decided.where("apart").select(group, F.col("n").alias("n_low"), F.lit(0.0).alias("similarity"), F.col("p").alias("first_seq"), F.col("q").alias("second_seq"))
    open_ = decided.where("not apart and not coalesce(alike, false)").select(F.col(group).alias("_g"), "block_1", "block_2")
    left = blocks.select(F.col(group).alias("g_1"), F.col("block").alias("b_1"), F.col("sets").alias("one"))
    right = blocks.select(group, F.col("block").alias("b_2"), F.col("sets").alias("two"))
    data = open_.join(left, (F.col("_g") == F.col("g_1")) & (F.col("block_1") == F.col("b_1"))).join(right, (F.col("_g") == F.col(group)) & (F.col("block_2") == F.col("b_2")))
    near = _met(data.select(group, "one", "two", (F.col("b_1") == F.col("b_2")).alias("same")), group, below)
    found = near.unionByName(far).groupBy(group).agg(F.min(F.struct("similarity", "first_seq", "second_seq")).alias("least"), F.sum("n_low").alias("n_low"))
    return found.where(F.col("least.similarity") < below).select(group, "least.*", "n_low")


# ---- heads that share a beginning ----------------------------------------------------------------------


def _common(a: Column, b: Column) -> Column:
    """Characters that two texts share at their beginning; null for null."""
    return A.diverge_at(a, b)


def prefix_heads(campaigns: DataFrame, text: str, stratum: str = "ecosystem", equal: int = 120, length: int = 200) -> DataFrame:
    """Beginnings of `length` characters that share their first `equal` with another, one row each.

    stratum, group_seq (the group's first place), seq and n (first place and number of
    texts with this head), n_heads and n_pairs (pairs of texts of the group that
    differ, this head's among them), before_seq and before_at (the head before it in
    order, and where the two diverge; null for a group's first), diverge_at (the
    furthest place up to which any other head of the group agrees).

    Heads are sorted once, by ranges. Where two heads diverge is the least of the
    `before_at` between them, so no pair is a row; a range's first head is met with
    the last of the range before.
    """
    base = campaigns.where(F.length(text) >= equal).select(F.col(stratum).alias("stratum"), F.substring(text, 1, equal).alias("prefix"), F.substring(text, 1, length).alias("head"), "_seq")
    heads = base.groupBy("stratum", "prefix", "head").agg(F.min("_seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    groups = heads.groupBy("stratum", "prefix").agg(F.min("seq").alias("group_seq"), F.count(F.lit(1)).alias("n_heads"), F.sum("n").alias("n_texts")).where("n_heads > 1")
    same = (F.col("stratum").eqNullSafe(F.col("_s"))) & (F.col("prefix") == F.col("_p"))
    several = heads.join(groups.select(F.col("stratum").alias("_s"), F.col("prefix").alias("_p"), "group_seq", "n_heads", "n_texts"), same).drop("_s", "_p")
    keys = ["stratum", "prefix", "head"]
    in_order = several.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())

    def neighbours(batches):
        before, first = None, True
        for batch in batches:
            cols = batch.to_pydict()
            n = batch.num_rows
            seqs, places, edges = [], [], []
            for s, p, h, q in zip(cols["stratum"], cols["prefix"], cols["head"], cols["seq"], strict=True):
                same_group = before is not None and before[0] == s and before[1] == p
                seqs.append(before[2] if same_group else None)
                places.append(_agree(before[3], h) if same_group else None)
                edges.append(first)
                before, first = (s, p, q, h), False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(places, pa.int32()), pa.array(edges, pa.bool_())], [*batch.schema.names, "before_seq", "before_at", "edge"])
            assert n == len(seqs)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in in_order.schema.fields) + ", before_seq long, before_at int, edge boolean"
    sorted_ = in_order.mapInArrow(neighbours, schema).persist()
    ends = sorted_.groupBy("range").agg(F.max_by(F.struct(*keys, "seq"), F.struct(*keys)).alias("last"))  # a row a range
    ends = ends.select(F.lead("range").over(Window.orderBy("range")).alias("of_range"), "last").where("of_range is not null")
    stitched = sorted_.join(ends, F.col("edge") & (F.col("range") == F.col("of_range")), "left")
    meets = F.col("last").isNotNull() & F.col("stratum").eqNullSafe(F.col("last.stratum")) & (F.col("prefix") == F.col("last.prefix"))
    stitched = stitched.withColumn("before_seq", F.when(meets, F.col("last.seq")).otherwise(F.col("before_seq"))).withColumn("before_at", F.when(meets, _common(F.col("last.head"), F.col("head"))).otherwise(F.col("before_at")))
    after = stitched.where("before_seq is not null").select(F.col("stratum").alias("_s"), F.col("before_seq").alias("_seq"), F.col("before_at").alias("after_at"))
    out = stitched.join(after, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("seq") == F.col("_seq")), "left")
    return out.select(F.col("stratum").alias(stratum), "group_seq", "seq", "n", "n_heads", (F.col("n") * (F.col("n_texts") - F.col("n"))).alias("n_pairs"), "before_seq", "before_at", F.greatest("before_at", "after_at").alias("diverge_at"))


def _agree(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while most - low > 1:  # a[:low] == b[:low] and a[:most] != b[:most]
        mid = (low + most) // 2
        low, most = (mid, most) if a[:mid] == b[:mid] else (low, mid)
    return low
