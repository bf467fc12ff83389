"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its five-word shingles. Documents of
equal sets form a class; the rest works on classes. A sketch is the KEEP least
hashes. Inverted lists of the retained values propose pairs: a short list all of
its pairs, a long one a star around a member drawn by hash (another for every
value), and the pairs or stars of its parts that agree on the next retained value
too. So candidates grow in proportion to the documents, whatever a group's size.
Estimates from the sketch of the union drop what is far below the threshold, and
what is left is confirmed on full sets: first one edge a node, then those edges
whose ends are not yet connected.

A star's centre may be near to few of its list, so members of a long list that are
still in different components are then held against each other in blocks, which
gives pairs that only long lists hold: first each in its longest list, then, for
what that leaves apart, every pair in the list of the least value both hold. Blocks
compare sketches; those with a partner the estimate lets through are written once
and compared on full sets, where a pair of blocks yields no more links than it has
components. Only lists that a pair at the threshold must share are met. The work in
a list of unlike members is quadratic in it; what is written is not.

Two documents at the threshold share no retained value with odds below 1e-18; an
estimate errs as far as FLOOR with odds below 1e-8. Only connection counts for the
result, so a pair inside a component needs no confirmation of its own.

Defined cases: a null or wordless text has an empty set and links with nothing; a
null id belongs to its class, but never names a component and leads to no link; a
repeated id keeps one row each; ids, not rows, name components. A very long text is
hashed whole in a few arrays of eight bytes a byte, one batch of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import bounded_batches, dropped, kept, map_text
from tallywright.llm.components import components
from tallywright.session import table

SHINGLE, PERCENT, KEEP, SHORT_LIST, FLOOR = 5, 85, 24, 24, 0.4
#: Rows in a block of full sets, and of sketches, which are short.
BLOCK, SKETCH_BLOCK = 128, 512
#: Columns of an incidence matrix at once; blocks of a list under one key of their join, and keys of one list at most.
COLUMNS, BLOCKS_A_KEY, SALTS = 1 << 14, 4, 32
#: Ids sent to every task to fetch texts; with more, the texts are joined by a shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE_VALUE[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]
PLACE = _rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a buffer, from running sums of byte values over powers of one base."""
    gap = SPACE[data]
    inner = np.concatenate([[True], gap, [True]])
    starts = np.flatnonzero(inner[:-1] & ~inner[1:])
    ends = np.flatnonzero(~inner[:-1] & inner[1:])
    powers = np.full(len(data) + 1, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, BASE_INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    words, starts = word_hashes(data)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(starts, begins)
    n = len(words) - SHINGLE + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        joined += words[k : k + n] * PLACE[k]
    joined = mixed(joined)
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(joined[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            whole = np.sum(words[lo:hi] * PLACE[: hi - lo], dtype=np.uint64, keepdims=True)
            out.append(mixed(whole + PLACE[SHINGLE : SHINGLE + 1] * np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def named(s: np.ndarray) -> bytes:
    """A class's name: 128 bits of its set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), node (class name; null for an empty set) and sketch of every row. One scan."""

    def run(batch):
        sets = shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist())
        lists = pa.array([s[:KEEP].view(np.int64) for s in sets], pa.list_(pa.int64()))
        nodes = pa.array([named(s) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(s) for s in sets], pa.int64()), nodes, lists], ["doc_id", "n", "node", "sketch"])

    return map_text(docs.select("doc_id", "text"), run, "doc_id long, n long, node binary, sketch array<long>", limit=1 << 20)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and set of the classes in `nodes` (node, doc_id of one member)."""
    few = nodes.count() <= BROADCAST_IDS
    wanted = nodes.select(F.col("doc_id").alias("wanted_id"), F.col("node").alias("wanted"))
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("wanted_id")).select("wanted", "text")

    def run(batch):
        sets = shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist())
        wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist()
        found = [(w, s) for w, s in zip(wanted, sets, strict=True) if len(s) and named(s) == w]  # an id may have several texts
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["node", "items"])

    return map_text(rows, run, "node binary, items array<long>", limit=1 << 20).dropDuplicates(["node"])


def short_and_long(lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings of lists with two to SHORT_LIST members, and of longer ones."""
    counts = lists.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    counts = counts.select(*[F.col(k).alias(f"of_{k}") for k in keys], "members")
    on = [F.col(k) == F.col(f"of_{k}") for k in keys]
    sized = lists.join(counts, on).drop(*[f"of_{k}" for k in keys])
    return sized.where(F.col("members") <= SHORT_LIST), sized.where(F.col("members") > SHORT_LIST)


def fits(a: str, b: str):
    """Sizes that allow the threshold."""
    return (F.lit(100) * F.least(a, b)) >= (F.lit(PERCENT) * F.greatest(a, b))


def pairs_of(short: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of lists with at most SHORT_LIST members."""
    lists = short.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    left = lists.select("m", F.posexplode("m").alias("i", "x"))
    each = left.select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(SHORT_LIST))).alias("y"))
    return each.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")).where(fits("na", "nb"))


def stars_of(long: DataFrame, keys: list[str]) -> DataFrame:
    """Each member of a long list with the one its list's hash draws."""
    centre = long.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("node", *keys).alias("h"), F.col("node").alias("a"), F.col("n").alias("na"))).alias("c"))
    centre = centre.select(*[F.col(k).alias(f"of_{k}") for k in keys], "c.a", "c.na")
    hung = long.join(centre, [F.col(k) == F.col(f"of_{k}") for k in keys]).where((F.col("a") != F.col("node")) & fits("na", "n"))
    return hung.select(F.least("a", "node").alias("a"), F.when(F.col("a") < F.col("node"), F.col("na")).otherwise(F.col("n")).alias("na"),
                       F.greatest("a", "node").alias("b"), F.when(F.col("a") < F.col("node"), F.col("n")).otherwise(F.col("na")).alias("nb"))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs a < b of classes that inverted lists propose, each once with its overlap (lists it was met in); the short and the long lists."""
    at = F.posexplode("sketch").alias("i", "value")
    postings = classes.select("node", "n", "sketch", at).select("node", "n", "value", F.coalesce(F.try_element_at("sketch", F.col("i") + 2), F.lit(0)).alias("next"))
    short, long = short_and_long(postings, ["value"])
    short, long = kept(short.drop("members"), "short"), kept(long, "long")
    parts_short, parts_long = short_and_long(long.drop("members"), ["value", "next"])
    found = pairs_of(short, ["value"]).unionByName(stars_of(long, ["value"])).unionByName(pairs_of(parts_short, ["value", "next"])).unionByName(stars_of(parts_long, ["value", "next"]))
    return found.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("overlap")), short, long


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketch of the union puts the similarity at FLOOR or more."""
    one = classes.select(F.col("node").alias("node_a"), F.col("sketch").alias("sketch_a"))
    two = classes.select(F.col("node").alias("node_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(one, F.col("a") == F.col("node_a")).drop("node_a").join(two, F.col("b") == F.col("node_b"))
    unsigned = lambda x: F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))  # noqa: E731  order of the hash
    union = F.slice(F.array_sort(unsigned(F.array_union("sketch_a", "sketch_b"))), 1, KEEP)
    shared = F.size(F.array_intersect(union, unsigned(F.array_intersect("sketch_a", "sketch_b"))))
    return both.where(shared >= F.lit(FLOOR) * F.size(union)).select("a", "na", "b", "nb")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that reach the threshold on full sets."""
    one = sets.select(F.col("node").alias("node_a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("node").alias("node_b"), F.col("items").alias("items_b"))
    both = pairs.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(F.lit(100) * shared >= F.lit(PERCENT) * (F.size("items_a") + F.size("items_b") - shared)).select("a", "b")


def prefixes(long: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings (value, node, members) of long lists that a pair which no short list holds must share one of.

    Two sketches of a pair that estimated() lets through share FLOOR of their values
    or more. With every sketch in one order, rarest first, they then share one that in
    neither is among the last FLOOR of its values less one, and short lists come first.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("members"), F.desc("value")))
    kept_of = classes.select(F.col("node").alias("of"), F.ceil(F.lit(FLOOR) * F.size("sketch")).alias("least"))
    return long.select("value", "node", "members").withColumn("rank", rank).join(kept_of, F.col("node") == F.col("of")).where(F.col("rank") >= F.col("least")).select("value", "node", "members")


def apart_in_lists(prefix: DataFrame, found: DataFrame, one_list: bool) -> DataFrame:
    """(value, node, component, outer) of long lists that hold several components.

    Of two members in different components one at least is not in the list's largest:
    those are outer. With `one_list` a node is outer in the longest of its lists alone.
    """
    placed = prefix.join(found.select(F.col("node").alias("f"), "component"), F.col("node") == F.col("f"), "left").select("value", "node", "members", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("value", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy(F.col("value").alias("v")).agg(F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("v", F.col("main.component").alias("main"))
    met = placed.join(main, F.col("value") == F.col("v"))
    outer = F.col("component") != F.col("main")
    if one_list:
        outer &= F.row_number().over(Window.partitionBy("node").orderBy(F.desc("members"), "value")) == 1
    return met.select("value", "node", "component", outer.alias("outer"))


def in_parts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """`rows` with the number of blocks, of about `block`, that each side of their list makes: every, outers, others.

    Joined once, one row a posting; all that is dealt into blocks later reads it from there.
    """
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = rows.groupBy(F.col("value").alias("of")).agg(parts(F.count(F.lit(1))).alias("every"), parts(F.count_if("outer")).alias("outers"), parts(F.count_if(~F.col("outer"))).alias("others"))
    return rows.join(sizes, F.col("value") == F.col("of")).drop("of")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows in blocks of outer members alone or of others alone, dealt by hash: value, outer, outers, others, the block's number in its list and the block."""
    number = F.when(F.col("outer"), F.pmod(F.xxhash64("node"), "outers")).otherwise(F.col("outers") + F.pmod(F.xxhash64("node"), "others"))
    tried = F.col("tried") if "tried" in rows.columns else F.array().cast("array<long>").alias("tried")
    dealt = rows.withColumn("part", number.cast("int"))
    return dealt.groupBy("value", "outer", "part", "outers", "others").agg(F.collect_list(F.struct("node", "component", "items", "held", tried)).alias("block"))


def block_pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    """value, part, left, right: every block of side `left` (every, outers, others) with every block of side `right` in one list, two blocks of others excepted.

    Rows: value, node, component, outer, items, held and the numbers of blocks. The left blocks of one kind in a long list are dealt to up to SALTS keys, and
    right blocks go to each of them; how many there are stands in every row. One merge join makes all pairs, those of a left block one after another.
    """
    bounded_batches(rows.sparkSession)
    salts = lambda n: F.least(F.ceil(F.col(n) / F.lit(BLOCKS_A_KEY)), F.lit(SALTS)).cast("int")
    of = lambda side, dealt: dealt if side == "every" else dealt.where("outer" if side == "outers" else "not outer")
    one = of(left, blocks(rows)).select("value", "outer", "part", F.pmod("part", F.when(F.col("outer"), salts("outers")).otherwise(salts("others"))).alias("salt"), F.col("block").alias("left"))
    keys = lambda n, outer: F.transform(F.filter(F.sequence(F.lit(0), salts(n)), lambda k: k < salts(n)), lambda k: F.struct(F.lit(outer).alias("outer"), k.alias("salt")))
    to = {"outers": keys("outers", True), "others": keys("others", False)}
    none = F.filter(to["others"], lambda k: F.lit(False))
    met = {"outers": to["outers"], "others": F.when(F.col("outer"), to["others"]).otherwise(none)}
    sent = F.concat(met["outers"], met["others"]) if left == "every" else met[left]
    two = of(right, blocks(rows)).select(F.col("value").alias("right_of"), F.explode(sent).alias("to"), F.col("block").alias("right"))
    two = two.select("right_of", F.col("to.outer").alias("right_to"), F.col("to.salt").alias("right_salt"), "right")
    same = (F.col("value") == F.col("right_of")) & (F.col("outer") == F.col("right_to")) & (F.col("salt") == F.col("right_salt"))
    return one.join(two.hint("merge"), same).select("value", "part", "left", "right")


def split(cell):
    names, homes = (cell.values.field(x).to_pylist() for x in ("node", "component"))
    return names, homes, *([x.values.to_numpy() for x in cell.values.field(c)] for c in ("items", "held", "tried"))


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both sides' sets and of all intersections: products of incidence matrices over the values both sides have, COLUMNS at a time."""
    sizes = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    values = np.intersect1d(np.concatenate(one), np.concatenate(two))
    both = np.zeros((len(one), len(two)), np.float32)
    if len(values):
        flats = []
        for sets, n in zip((one, two), sizes, strict=True):
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
            here = values[at] == flat
            at, rows = at[here], np.repeat(np.arange(len(sets)), n)[here]
            order = np.argsort(at, kind="stable")
            flats.append((at[order], rows[order], len(sets)))
        for lo in range(0, len(values), COLUMNS):
            width = min(COLUMNS, len(values) - lo)
            grids = []
            for at, rows, n in flats:
                x, y = np.searchsorted(at, [lo, lo + width])
                grid = np.zeros((n, width), np.float32)
                grid[rows[x:y], at[x:y] - lo] = 1
                grids.append(grid)
            both += grids[0] @ grids[1].T
    return sizes[0][:, None], sizes[1][None, :], both


def compared(left, right, value: int | None = None):
    """Names and component numbers of both blocks, which pairs are met here, and their sizes and overlaps.

    Met are pairs in different components; given the list's `value`, those of them that hold no lesser value together
    and of whom neither holds a list that the other has tried.
    """
    (ln, lc, li, lh, lt), (rn, rc, ri, rh, rt) = split(left), split(right)
    homes = np.unique(np.array([int.from_bytes(x, "big") for x in lc + rc], object), return_inverse=True)[1]
    at_left, at_right = homes[: len(ln)], homes[len(ln) :]
    met = at_left[:, None] != at_right[None, :]
    if value is not None:
        met &= overlaps([x[x < value] for x in lh], [x[x < value] for x in rh])[2] == 0
        met &= (overlaps(lt, rh)[2] == 0) & (overlaps(lh, rt)[2] == 0)
    return ln, rn, at_left, at_right, met, *overlaps(li, ri)


def near_in_lists(rows: DataFrame, once: bool) -> DataFrame:
    """Postings (value, node) with a partner of another component in their list that the estimate lets through.

    Rows as in_parts() deals them, with items (sketches), held (values of all the node's postings) and, if any, tried
    (those of its lists where it has met every member, whoever was near on full sets). With `once` a pair is met in the
    list of the least value that both hold alone, unless it has met in a list tried. A block meets all blocks of its list one
    after another, and its near members are one row, after the last. Where Spark splits a skewed partition a block
    has a row a split; these meet by block, so each posting comes once.
    """
    def run(batches):
        key, names, near = None, [], np.zeros(0, bool)

        def out():
            found = [n for n, x in zip(names, near.tolist(), strict=True) if x]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([found], pa.list_(pa.binary()))], ["value", "part", "nodes"])

        for batch in batches:
            for value, part, left, right in zip(*(batch.column(i) for i in range(4)), strict=True):
                ln, _, _, _, other, one, two, both = compared(left, right, value.as_py() if once else None)
                if (value.as_py(), part.as_py()) != key:
                    if near.any():
                        yield out()
                    key, names, near = (value.as_py(), part.as_py()), ln, np.zeros(len(ln), bool)
                if ln != names:  # the same block again, read in another order
                    at = {n: i for i, n in enumerate(ln)}
                    picked = [at[n] for n in names]
                else:
                    picked = slice(None)
                near |= (other & (both >= FLOOR * np.minimum(KEEP, one + two - both))).any(axis=1)[picked]
        if near.any():
            yield out()

    near = block_pairs(rows, "every", "every").mapInArrow(run, "value long, part long, nodes array<binary>")
    return near.groupBy("value", "part").agg(F.array_distinct(F.flatten(F.collect_set("nodes"))).alias("nodes")).select("value", F.explode("nodes").alias("node"))


def links_in_lists(rows: DataFrame) -> DataFrame:
    """Components (a, b) that links at the threshold join, of each pair of blocks as many as connect its components.

    Rows as in_parts() deals them, with items (full sets) and held (not read).
    """

    def run(batches):
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                _, _, lh, rh, other, one, two, both = compared(left, right)
                lc, rc = (x.values.field("component") for x in (left, right))
                good = other & (100 * both >= PERCENT * (one + two - both))
                at = list(range(int(max(lh.max(), rh.max())) + 1))

                def root(x, at=at):
                    while at[x] != x:
                        at[x] = x = at[at[x]]
                    return x

                for i in np.flatnonzero(good.any(axis=1)):
                    where = np.flatnonzero(good[i])
                    kinds, first = np.unique(rh[where], return_index=True)
                    for kind, j in zip(kinds.tolist(), where[first].tolist(), strict=True):
                        x, y = root(int(lh[i])), root(kind)
                        if x != y:
                            at[x] = y
                            a.append(lc[int(i)].as_py())
                            b.append(rc[j].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return block_pairs(rows, "outers", "every").mapInArrow(run, "a binary, b binary")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size) and component_id of every row."""
    rows = kept(sketches(docs), "sketches")
    classes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = kept(classes, "classes")
    proposed, short, long = candidates(classes)
    pairs = kept(estimated(proposed, classes), "pairs")
    prefix = kept(prefixes(long, classes), "prefix")
    dropped(short, long)
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    used = kept(classes.select("node", "doc_id").join(used, "node", "left_semi"), "used")
    sets = kept(full_sets(docs, used), "sets")

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        """The components that `links` make of those found: stars, not the links that led to them, and the new links."""
        stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return kept(components(stars.unionByName(links)), "found")

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = kept(components(confirmed(first, sets)), "found")
    left, right = found.select(F.col("node").alias("l"), F.col("component").alias("lc")), found.select(F.col("node").alias("r"), F.col("component").alias("rc"))
    apart = pairs.join(left, F.col("a") == F.col("l"), "left").join(right, F.col("b") == F.col("r"), "left").where(F.coalesce("lc", "a") != F.coalesce("rc", "b")).select("a", "b")
    old, found = found, joined(found, confirmed(apart, sets))
    dropped(old, pairs, used, sets)

    tried = None
    for one_list in (True, False):  # most of a group connects in one list; the rest then has few outside, and what has met there need not meet again
        apart = kept(apart_in_lists(prefix, found, one_list), "apart")
        if apart.where("outer").isEmpty():
            dropped(apart, *([] if tried is None else [tried]))
            continue
        held = prefix.groupBy(F.col("node").alias("holder")).agg(F.collect_list("value").alias("held"))
        sketched = in_parts(apart, SKETCH_BLOCK).join(classes.select(F.col("node").alias("of"), F.col("sketch").alias("items")), F.col("node") == F.col("of")).join(held, F.col("node") == F.col("holder")).drop("of", "holder")
        if tried is not None:
            lists = tried.where("outer").select(F.col("node").alias("trier"), F.array("value").alias("tried"))
            sketched = sketched.join(lists, F.col("node") == F.col("trier"), "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<long>"))).drop("trier")
        sketched = kept(sketched, "sketched")
        near = kept(near_in_lists(sketched, once=not one_list), "near")
        dropped(sketched)
        wanted = near.select("node").distinct()
        if not wanted.isEmpty():
            sets = kept(full_sets(docs, classes.select("node", "doc_id").join(wanted, "node", "left_semi")), "sets")
            met = kept(in_parts(apart.join(near, ["value", "node"], "left_semi")), "met")
            rows_met = met.join(sets, "node").withColumn("held", F.array().cast("array<long>"))
            old, found = found, joined(found, links_in_lists(rows_met))
            dropped(old, sets, met)
        dropped(near, *([] if tried is None else [tried]), *([] if one_list else [apart]))
        tried = apart

    named_by = classes.select("node", "doc_id").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    least = named_by.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = kept(named_by.join(least, "component").select(F.col("node").alias("of"), "component_id"), "named")
    dropped(found, classes, prefix)
    out = rows.select("doc_id", "n", "node").join(by_node, F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "n", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of least id; rows without an id stay. Columns as they came."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    gone = linked(docs.select("doc_id", "text")).where("doc_id is not null and component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = kept(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.select(*columns).join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("gone"), "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
