"""Near-duplicate vectors by NN-descent.

Rows of equal label and equal vector form a class. A first neighbour graph comes
from orders of random projections: classes are sorted by label, sign code and
projection, and each meets the few before it. NN-descent then refines the graph:
around every node its neighbours and those it is a neighbour of are compared with
each other, and each keeps the best.

After every round the graph is audited twice. About AUDIT classes, drawn by hash,
are compared with all of their label by brute force, in blocks; for each, the
components that its links lead to count, not the links, so that links inside dense
groups do not outweigh lone ones. And each drawn class has a planted partner, a
vector in a random direction just above the threshold; those of classes without
links show how many lone pairs the graph finds, whether or not the table has any.
Until both recalls reach RECALL, rounds go on with more orders and longer lists;
after ROUNDS without that, all classes are compared with their label in blocks.
Where the audit passes, classes whose lists are full of links are.

Edges at the threshold, checked in double precision, give components. Lists of
nodes in a component may be saturated, their true neighbours more than a list
holds, so they are enlarged to the component: its members are compared in blocks
and only counts leave a block. So link counts are whole wherever the graph
connects, whatever a group's size, and no pair inside a group is ever a row.

Defined cases: a null label, a null, empty or zero vector, one with a null or
non-finite component, and a null id link with nothing; vectors of different
length never link; equal rows count as other vectors of each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import bounded_batches, dropped, kept
from tallywright.llm.components import components
from tallywright.session import table

THRESHOLD, RECALL = 0.98, 0.99
ORDERS, NEAR, LIST, ROUNDS = 16, 8, 10, 4
#: Of the places in an order that are looked at, those from here on count only at a cosine of CLOSE; classes of one code.
FAR, CLOSE, CELL = 4, 0.9, 32
#: Classes drawn for the audit; planted pairs of classes without links that tell enough.
AUDIT, LEAST_PLANTED, BLOCK = 400, 20, 512
#: Blocks of a key in one task, and tasks of a key at most; cosines this near to the threshold are summed term by term.
BLOCKS_A_KEY, SALTS, BAND = 4, 32, 1e-9
EDGE = "u long, v long, sim float"


def matrix(column, kind=np.float64) -> np.ndarray:
    """A list column whose rows are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def classes_of(vectors: DataFrame) -> DataFrame:
    """node, label, width, vec (double), least (vec_id), members of each distinct usable vector of a label."""
    vec = F.col("embedding").cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(good, F.lit(False)))
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    found = rows.select("vec_id", "label", plain.alias("vec")).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
    return found.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("width"), "vec", "least", "members")


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def first_graph(classes: DataFrame, rows: int, turn: int = 0) -> DataFrame:
    """Edges between classes that stand close in one of ORDERS orders; other orders each `turn`."""
    bits = int(np.clip(np.ceil(np.log2(max(rows, 2) / CELL)), 2, 32))

    def coded(batches):
        for batch in batches:
            names = batch.schema.names
            widths = batch.column(names.index("width")).to_numpy()
            for w in np.unique(widths):
                part = batch.filter(pa.array(widths == w))
                v = unit(matrix(part.column(names.index("vec"))))
                for t in range(turn * ORDERS, (turn + 1) * ORDERS):
                    planes = np.random.default_rng([int(w), t]).standard_normal((int(w), bits + 1))
                    p = v @ planes
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float32).ravel()), int(w)).cast(pa.list_(pa.float32()))
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part.column(names.index("label")), part.column(names.index("width")), pa.array(np.full(n, t, np.int32)), pa.array(code.astype(np.int64)), pa.array(p[:, bits]), part.column(names.index("node")), lists],
                        ["label", "width", "turn", "code", "place", "node", "vec"],
                    )

    order = ("label", "width", "turn", "code", "place", "node")
    label = classes.schema["label"].dataType.simpleString()
    dealt = classes.select("node", "label", "width", "vec").mapInArrow(coded, f"label {label}, width int, turn int, code long, place double, node long, vec array<float>")
    dealt = dealt.repartitionByRange(*order[:5]).sortWithinPartitions(*order)

    def close(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            widths = col["width"].to_numpy()
            labels = col["label"].dictionary_encode().indices.to_numpy()  # of any type; only equality counts
            keys = np.stack([labels.astype(np.int64), widths, col["turn"].to_numpy(), col["code"].to_numpy()], axis=1)
            nodes = col["node"].to_numpy()
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                v, k, n = matrix(col["vec"].take(pa.array(at)), np.float32), keys[at], nodes[at]
                for d in range(1, min(NEAR, len(at) - 1) + 1):
                    same = np.flatnonzero((k[d:] == k[:-d]).all(axis=1))
                    if len(same):
                        sim = np.einsum("ij,ij->i", v[same + d], v[same])
                        if d > FAR:
                            same, sim = same[sim >= CLOSE], sim[sim >= CLOSE]
                        yield pa.RecordBatch.from_arrays([pa.array(n[same + d]), pa.array(n[same]), pa.array(sim.astype(np.float32))], ["u", "v", "sim"])

    return dealt.mapInArrow(close, EDGE)


def best(edges: DataFrame, length: int) -> DataFrame:
    """Both directions of `edges`, each node's `length` nearest."""
    both = edges.select("u", "v", "sim").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    one = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return one.withColumn("rank", rank).where(F.col("rank") <= length).drop("rank")


def refined(graph: DataFrame, units: DataFrame, length: int) -> DataFrame:
    """One round: around each pivot, those in its list and those that list it (the nearest of both) meet."""
    back = F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("sim"), "node"))
    around = graph.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "sim").unionByName(graph.select(F.col("v").alias("pivot"), F.col("u").alias("node"), "sim"))
    around = around.distinct().withColumn("rank", back).where(F.col("rank") <= 2 * length).select("pivot", "node")
    met = around.join(units.select(F.col("node").alias("of"), "vec"), F.col("node") == F.col("of")).select("pivot", "node", "vec")
    width = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(width, "pivot").sortWithinPartitions("pivot", "node")

    def meet(batches):
        for batch in batches:
            pivots, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            cuts = np.flatnonzero(np.diff(pivots, prepend=pivots[0] - 1 if len(pivots) else 0))
            ends = np.append(cuts[1:], len(pivots))
            us, vs, sims = [], [], []
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(np.concatenate([[0], sizes]))
            for lo, hi in zip(cuts, ends, strict=True):
                m = hi - lo
                if m < 2:
                    continue
                v = flat[starts[lo] : starts[hi]].reshape(m, -1)
                s = v @ v.T
                np.fill_diagonal(s, -2)
                take = min(4, m - 1)
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                us.append(np.repeat(nodes[lo:hi], take))
                vs.append(nodes[lo:hi][top].ravel())
                sims.append(np.take_along_axis(s, top, axis=1).ravel())
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(sims).astype(np.float32))], ["u", "v", "sim"])

    new = dealt.mapInArrow(meet, EDGE)
    return best(graph.unionByName(new), length)


def forest(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect whatever `good` connects; fewer than it has rows and columns."""
    row, col = good.any(axis=1), good.any(axis=0)
    out: list[tuple[int, int]] = []
    for start in range(len(good)):
        if not row[start]:
            continue
        row[start], todo = False, [(start, True)]
        while todo:
            at, is_row = todo.pop()
            new = np.flatnonzero(good[at] & col if is_row else good[:, at] & row).tolist()
            (col if is_row else row)[new] = False
            out += [(at, x) if is_row else (x, at) for x in new]
            todo += [(x, not is_row) for x in new]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def reaches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two matrices have a cosine of THRESHOLD or more.

    Products of unit vectors decide all but a narrow band, whose pairs are summed
    term by term, as `exact` and SQL do.
    """
    near = unit(left) @ unit(right).T
    good = near >= THRESHOLD
    for i, j in zip(*np.nonzero(np.abs(near - THRESHOLD) < BAND), strict=True):
        x, y = left[i].tolist(), right[j].tolist()
        norms = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        good[i, j] = 0 < norms < math.inf and sum(v * w for v, w in zip(x, y, strict=True)) / norms >= THRESHOLD
    return good


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Rows of `left` against all of `right` with equal keys, in blocks; `what` picks links, a forest of them a block, or counts.

    Both sides: keys, node, vec, members. The left blocks of a key are dealt to up to
    SALTS tasks, and its right blocks go to each of them.
    """

    bounded_batches(left.sparkSession)

    def blocked(rows, side):
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts")).select(*[F.col(k).alias(f"of_{k}") for k in keys], "parts")
        dealt = rows.join(sizes, [F.col(k) == F.col(f"of_{k}") for k in keys]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        packed = dealt.groupBy(*keys, "part", "parts").agg(F.collect_list(F.struct("node", "vec", "members")).alias(side))
        return packed.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.col("part").alias(f"{side}_part"), F.col("parts").alias(f"{side}_parts"), side)

    salts = F.least(F.ceil(F.col("one_parts") / F.lit(BLOCKS_A_KEY)), F.lit(SALTS)).cast("int")
    one = blocked(left, "one").withColumn("one_salt", F.col("one_part") % salts)
    wide = one.groupBy(*[F.col(f"one_{k}").alias(f"wide_{k}") for k in keys]).agg(F.max(salts).alias("salts"))
    two = blocked(right, "two").join(wide, [F.col(f"two_{k}") == F.col(f"wide_{k}") for k in keys])
    two = two.select(*[f"two_{k}" for k in keys], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("two_salt"), "two")
    pairs = one.join(two, [*(F.col(f"one_{k}") == F.col(f"two_{k}") for k in keys), F.col("one_salt") == F.col("two_salt")]).select("one", "two")

    def split(cell):
        rows = cell.values
        return rows.field("node").to_numpy(), matrix(rows.field("vec")), rows.field("members").to_numpy()

    def run(batches):
        for batch in batches:
            first, second, third = [], [], []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                (a, va, _), (b, vb, mb) = split(one), split(two)
                good = reaches(va, vb)
                good &= a[:, None] != b[None, :]
                if what == "count":
                    first.append(a)
                    second.append(good @ mb)
                else:
                    i, j = np.nonzero(good) if what == "links" else forest(good)
                    first.append(a[i])
                    second.append(b[j])
                third.append(np.ones(len(first[-1]), np.float32))
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second).astype(np.int64)), pa.array(np.concatenate(third))], ["u", "v", "sim"])

    return pairs.mapInArrow(run, EDGE)


def exact(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) that reach the threshold in double precision; candidates are a little below it at least."""
    near = edges.where(F.col("sim") >= THRESHOLD - 1e-4).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    one, two = (classes.select(F.col("node").alias(f"n{i}"), F.col("vec").alias(f"v{i}")) for i in (1, 2))
    both = near.join(one, F.col("u") == F.col("n1")).join(two, F.col("v") == F.col("n2"))
    dot = F.aggregate(F.zip_with("v1", "v2", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.where(dot / (norm(F.col("v1")) * norm(F.col("v2"))) >= THRESHOLD).select("u", "v")


def planted(asked: DataFrame) -> DataFrame:
    """node (-1 - the class's), label, width, vec of a partner for each class, in a random direction and just above the threshold."""
    label = asked.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            nodes, widths = (batch.column(names.index(c)).to_numpy() for c in ("node", "width"))
            for w in np.unique(widths[widths > 1]):
                at = pa.array(widths == w)
                part = batch.filter(at)
                v = unit(matrix(part.column(names.index("vec"))))
                own = nodes[widths == w]
                side = np.stack([np.random.default_rng(int(n)).standard_normal(int(w)) for n in own])
                side = unit(side - (side * v).sum(axis=1, keepdims=True) * v)
                cos = THRESHOLD + 1e-4
                partner = cos * v + math.sqrt(1 - cos * cos) * side
                lists = pa.FixedSizeListArray.from_arrays(pa.array(partner.ravel()), int(w)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(-1 - own), part.column(names.index("label")), part.column(names.index("width")), lists], ["node", "label", "width", "vec"])

    return asked.select("node", "label", "width", "vec").mapInArrow(run, f"node long, label {label}, width int, vec array<double>")


def audited(graph: DataFrame, true: DataFrame, plants: DataFrame) -> float:
    """The lesser of two recalls: of the components that `true` links lead to, and of the planted partners of classes without links; 0 where there are too few of both."""
    near = graph.where(F.col("sim") >= THRESHOLD - 1e-4).select(F.col("u").alias("a"), F.col("v").alias("b"))
    placed = kept(components(near), "placed")  # a link inside one component is found: its blocks hold it

    def place(rows, node, name):
        ends = placed.select(F.col("node").alias(f"_{name}"), F.col("component").alias(name))
        return rows.join(ends, F.col(node) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(name, node)).drop(f"_{name}")

    led = place(place(true.select("u", "v"), "u", "mine"), "v", "theirs").select("u", "mine", "theirs").distinct()
    seen = led.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mine") == F.col("theirs")).alias("found")).first()
    sizes = placed.where("node >= 0").groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("members"))
    pairs = place(place(plants.select(F.col("node").alias("partner"), (-1 - F.col("node")).alias("host")), "host", "mine"), "partner", "theirs")
    lone = pairs.join(sizes, F.col("mine") == F.col("_c"), "left").where("coalesce(members, 1) <= 1")
    set_ = lone.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mine") == F.col("theirs")).alias("found")).first()
    dropped(placed)
    if max(seen["n"], set_["n"]) < LEAST_PLANTED:  # nothing to tell by, as in small tables
        return 0.0
    return min(seen["found"] / seen["n"] if seen["n"] else 1.0, set_["found"] / set_["n"] if set_["n"] >= LEAST_PLANTED else 1.0)


def links(classes: DataFrame) -> tuple[DataFrame, float]:
    """Edges (u, v) at the threshold and the audited recall of the graph they come from; 1 where blocks hold every pair."""
    n = classes.count()
    columns, keys = ["label", "width", "node", "vec", "members"], ["label", "width"]
    asked = kept(classes.where(F.pmod(F.xxhash64("least"), F.lit(max(n, 1))) < AUDIT), "asked")
    plants = kept(planted(asked), "plants")
    true = kept(in_blocks(asked.select(*columns), classes.select(*columns), keys, "links"), "audit")
    everything = classes.select(*plants.columns).unionByName(plants)
    units = kept(unit_rows(everything), "units")
    length, recall = LIST, 0.0
    graph = kept(best(first_graph(everything, n), length), "graph")
    for turn in range(1, ROUNDS + 1):
        before, graph = graph, kept(refined(graph, units, length), "graph")
        dropped(before)
        recall = audited(graph, true, plants)
        if recall >= RECALL or turn == ROUNDS:
            break
        length *= 2
        before, graph = graph, kept(best(graph.unionByName(first_graph(everything, n, turn)), length), "graph")
        dropped(before)
    graph = graph.where("u >= 0 and v >= 0")
    rest = classes
    if recall >= RECALL:  # a list that ends above the threshold may have lost links: such classes meet all of their label
        full = graph.where(F.col("sim") >= THRESHOLD - 1e-4).groupBy("u").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= length - 1)
        rest = classes.join(full.select(F.col("u").alias("node")), "node", "left_semi")
    more = kept(in_blocks(rest.select(*columns), classes.select(*columns), keys, "forest"), "more")
    dropped(units, asked, plants)
    return exact(graph.unionByName(true).unionByName(more), classes), recall if recall >= RECALL else 1.0


def unit_rows(rows: DataFrame) -> DataFrame:
    """Unit vectors in single precision, for the graph's similarities."""
    scale = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumn("scale", scale).select("node", F.transform("vec", lambda x: (x / F.col("scale")).cast("float")).alias("vec"))


def linked(vectors: DataFrame) -> tuple[DataFrame, float]:
    """vec_id, n_links, component_id of every row, and the audited recall."""
    classes = kept(classes_of(vectors.select("vec_id", "label", "embedding")), "classes")
    edges, recall = links(classes)
    found = kept(components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))), "found")
    named = classes.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").drop("of").withColumn("component", F.coalesce("component", "node"))
    inside = named.where(F.col("component").isNotNull()).join(found.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi").select("component", "node", "vec", "members")
    counts = in_blocks(inside, inside, ["component"], "count").groupBy("u").agg(F.sum("v").alias("others"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    done = named.join(least, F.col("component") == F.col("c")).join(counts, F.col("node") == F.col("u"), "left")
    done = kept(done.select("label", "vec", "component_id", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links")), "done")
    dropped(classes, found)
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors.select("vec_id", F.col("label").alias("of_label"), plain.alias("of_vec"))
    out = rows.join(done, (F.col("of_label") == F.col("label")) & (F.col("of_vec") == F.col("vec")) & F.col("vec_id").isNotNull(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), recall


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall that the audit found is the result's attribute `audited_recall`."""
    rows, recall = linked(table(spark, sf_dir, "embeddings"))
    out = rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out.audited_recall = recall
    return out


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
      WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
