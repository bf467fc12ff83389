"""Removal of passages that repeat: every byte covered by a LENGTH-byte string that also starts earlier.

A string of LENGTH bytes contains LENGTH - GRAM + 1 GRAM-byte windows; the one of
least hash (the leftmost, if equal) is its anchor. Equal strings have equal
anchors at equal places, about one in thirty-four positions is an anchor, and the
strings that share one are consecutive: their union is the anchor's stretch. So
only stretches whose anchor occurs again have suffixes worth sorting.

1. Anchors' hashes are counted; those met twice set bits of a filter.
2. Anchors that pass it are written with the hash of their stretch. Of equal
   stretches all but the earliest are repeats throughout.
3. Where one anchor has several stretches (an edit nearby, the end of a passage),
   the bytes of each earliest stretch are dealt by anchor, and every task sorts the
   suffixes it holds by a difference cover modulo 3: triples of the sampled suffixes
   are sorted and named, the string of names is sorted the same way, and the
   suffixes left over are merged in. Suffixes that start with the same string have
   one anchor, so they meet in one task and stand next to each other there: equal
   prefixes of neighbours are repeats of the earliest. An anchor with more than
   GROUP stretches is not held in one task; its strings are rows of their own,
   named by two independent 64-bit hashes and reduced before they are shuffled.
4. Spans meet their documents, and what they do not cover is kept.

Texts travel only where a document has something to cut or compare, which a filter
of document keys tells; filters grow with what they hold up to 64 MB, and where
they fill they let more through, which costs a shuffle and changes no result.
Groups of equal anchors, stretches and strings are reduced to their earliest
member in each batch and task before they are shuffled, so a passage in a third of
all documents is a skewed join, which Spark splits, and never a group in one task.

Defined cases: a null text counts as empty; null ids come last; of documents with
one id the order is that of the text's hash; rows alike in both are one document
and get the same spans; texts shorter than LENGTH lose nothing; a very long text is
read in overlapping pieces of PIECE bytes, whose stretches count as others do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import dropped, kept, map_text
from tallywright.session import table

LENGTH, GRAM = 100, 24
#: The filter: 2 ** CELL_BITS cells, each of 16 bits a hash it holds within these bounds (4 kB to 16 kB; 16 MB to 64 MB in all).
CELL_BITS, IN_CELL, MOST_IN_CELL, PROBES = 12, 15, 17, 3
#: Starts of strings in one piece of a text, and bytes that are hashed at once.
PIECE, TOGETHER = 1 << 21, 1 << 21
PLACE_BITS = 24
#: Stretches of one anchor that are compared in one task, about 1 MB of bytes; and rows taken together there.
GROUP, ROWS = 8192, 4096

_rng = np.random.default_rng(20240301)
VALUES = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretches of a buffer, by running sums of byte values over powers of a base."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[which][data] * powers(base, len(data) + 1)[:-1], out=self.sums[1:])
        self.back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) + 1)

    def of(self, lo, hi) -> np.ndarray:
        x = (self.sums[hi] - self.sums[lo]) * self.back[lo]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple:
    """Of a buffer of pieces with the given ends: each anchor's piece, place, and the first and last start of its strings; its hash."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.astype(np.uint64)
    rolling = Rolling(data)
    m = len(data) - GRAM + 1
    gram = rolling.of(slice(0, m), slice(GRAM, GRAM + m))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~low) | np.arange(m, dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    starts = np.flatnonzero(np.arange(n) + LENGTH <= ends[owner])
    place = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1) | (np.diff(starts, prepend=-2) != 1) | np.diff(owner[starts], prepend=-1))
    last = np.append(new[1:], len(starts)) - 1 if len(new) else new
    return owner[starts[new]], place[new], starts[new], starts[last], gram[place[new]]


def buffers(texts: list):
    """(bytes, ends of pieces, their texts, their starts in these): pieces of the texts, about TOGETHER bytes at a time.

    Pieces overlap by LENGTH - 1 bytes, so every string of a text is in one of them; texts with no string have none.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    offsets: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for at in range(0, len(raw) - LENGTH + 1, PIECE):
            parts.append(raw[at : at + PIECE + LENGTH - 1])
            owners.append(i)
            offsets.append(at)
            size += len(parts[-1])
            if size >= TOGETHER:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners), np.array(offsets)
                parts, owners, offsets, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(owners), np.array(offsets)


def probes(h: np.ndarray, in_cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each hash and its bits there (PROBES rows). Anchors are least hashes, so their leading bits are no guide."""
    cell = (h & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
    mask = np.uint64((1 << in_cell) - 1)
    return cell, np.stack([((h >> np.uint64(CELL_BITS + in_cell * i)) & mask).astype(np.int64) for i in range(PROBES)])


def filled(hashes: DataFrame) -> np.ndarray:
    """The filter of the written hashes `h`: cells are filled where their hashes meet; the driver gets the cells."""
    in_cell = int(np.clip(np.ceil(np.log2(max(1, hashes.count()) * 16)) - CELL_BITS, IN_CELL, MOST_IN_CELL))
    cells = hashes.select("h", F.col("h").bitwiseAND(F.lit((1 << CELL_BITS) - 1)).alias("cell")).repartition("cell")

    def fill(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, bits = probes(batch.column(0).to_numpy().view(np.uint64), in_cell)
            order = np.argsort(cell, kind="stable")
            cell, bits = cell[order], bits[:, order]
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(cell)), strict=True):
                row = found.setdefault(int(cell[lo]), np.zeros((1 << in_cell) // 8, np.uint8))
                place = bits[:, lo:hi].ravel()
                np.bitwise_or.at(row, place >> 3, (128 >> (place & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["cell", "bits"])

    out = np.zeros((1 << CELL_BITS, (1 << in_cell) // 8), np.uint8)
    for r in cells.mapInArrow(fill, "cell long, bits binary").toLocalIterator():  # at most 2 ** CELL_BITS rows
        out[r["cell"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(table_: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell, bits = probes(h, (table_.shape[1] * 8).bit_length() - 1)
    keep = np.ones(len(h), bool)
    for b in bits:
        keep &= (table_[cell, b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
    return keep


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """h: the anchors' hashes that occur twice or more."""

    def run(batch):
        found = [anchors(data, ends)[4] for data, ends, _, _ in buffers(batch.column(0).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    counts = map_text(docs.select("text"), run, "h long", limit=2 << 20).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").select("h")


#: Documents in order: id (a null one last), then the text's hash.
KEY = ("id", "tie")
LAST_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


STRETCH = "id long, tie long, lo int, hi int, h long, s long, again boolean"


def stretches(docs: DataFrame, passing) -> DataFrame:
    """Stretches [lo, hi) in bytes whose anchor's hash h passes the filter, with their own hash s.

    `again`: an equal stretch stands earlier in the same batch, so this one repeats.
    """

    def run(batch):
        names = batch.schema.names
        ids, ties = (batch.column(names.index(k)).to_numpy() for k in KEY)
        columns: list[list[np.ndarray]] = []
        for data, ends, owners, offsets in buffers(batch.column(names.index("text")).to_pylist()):
            owner, place, first, last, h = anchors(data, ends)
            keep = passes(passing.value, h)
            owner, place, first, last, h = (x[keep] for x in (owner, place, first, last, h))
            stop = last + LENGTH
            shape = ((place - first) * 256 + (stop - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            s = Rolling(data, 1).of(first, stop) + shape
            lo = first - (ends - np.diff(ends, prepend=0))[owner] + offsets[owner]
            columns.append([ids[owners[owner]], ties[owners[owner]], lo, lo + stop - first, h.view(np.int64), s.view(np.int64)])
        id_, tie, lo, hi, h, s = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else [np.zeros(0, np.int64)] * 6
        order = np.lexsort((lo, tie, id_, s, h))
        id_, tie, lo, hi, h, s = (x[order] for x in (id_, tie, lo, hi, h, s))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        at = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (id_ != id_[at]) | (tie != tie[at]) | (lo != lo[at])
        keep = new | again  # rows alike are one document
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x[keep], k) for x, k in zip((id_, tie, lo, hi, h, s, again), kinds, strict=True)], [*KEY, "lo", "hi", "h", "s", "again"])

    return map_text(keyed(docs), run, STRETCH, limit=2 << 20)


MARK = "mark"


def listed(rows: DataFrame, *columns: str) -> DataFrame:
    """A row a document: its key, a hash of that, and the list of its `columns`, which no more than its own places fill."""
    each = rows.groupBy(*KEY).agg(F.collect_set(F.struct(*columns)).alias("listed"))
    return each.withColumn(MARK, F.xxhash64(*KEY))


def with_lists(rows: DataFrame, lists: DataFrame, others: bool) -> DataFrame:
    """`rows` (key, text and more) with their list; only documents that may have one are shuffled. With `others` the rest follow, with a null list."""
    passing = rows.sparkSession.sparkContext.broadcast(filled(lists.select(F.col(MARK).alias("h"))))
    marked = rows.withColumn(MARK, F.xxhash64(*KEY))

    def chosen(wanted):
        def run(batch):
            hit = passes(passing.value, batch.column(batch.schema.get_field_index(MARK)).to_numpy().view(np.uint64))
            return batch.filter(pa.array(hit == wanted))

        return map_text(marked, run, marked.schema)

    right = lists.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "listed")
    met = chosen(True).join(right, [F.col(k) == F.col(f"of_{k}") for k in KEY], "left" if others else "inner").drop(MARK, *[f"of_{k}" for k in KEY])
    if not others:
        return met
    return met.unionByName(chosen(False).drop(MARK).withColumn("listed", F.lit(None).cast(lists.schema["listed"].dataType)))


def edge_bytes(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The bytes of the stretches `edges` (key, lo, hi, h, shapes)."""
    rows = with_lists(keyed(docs), kept(listed(edges, "lo", "hi", "h", "shapes"), "wanted"), others=False)

    def run(batch):
        names = batch.schema.names
        lists = batch.column(names.index("listed"))
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        raw = [t.encode() for t in batch.column(names.index("text")).to_pylist()]
        lo, hi, h, shapes = (pa.compute.struct_field(lists.flatten(), i) for i in range(4))
        cut = [raw[o][a:b] for o, a, b in zip(owner.tolist(), lo.to_pylist(), hi.to_pylist(), strict=True)]
        keys = [batch.column(names.index(k)).take(pa.array(owner)) for k in KEY]
        return pa.RecordBatch.from_arrays([*keys, lo, h, pa.array(cut, pa.binary()), shapes], [*KEY, "lo", "h", "bytes", "shapes"])

    return map_text(rows, run, "id long, tie long, lo int, h long, bytes binary, shapes long", limit=2 << 20)


# ---- suffixes of stretches, by a difference cover modulo 3 ------------------------------------------


def in_order(*columns: np.ndarray) -> np.ndarray:
    """One integer a row that orders rows as their columns (not negative) do."""
    out = columns[0]
    for c in columns[1:]:
        if (int(out.max(initial=0)) + 1) * (int(c.max(initial=0)) + 1) >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * (int(c.max(initial=0)) + 1) + c
    return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` (integers, not negative) in lexicographic order."""
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(3, np.int64)])
    # places 1 and 2 modulo 3; the first kind ends in a triple that reaches beyond the end, so no name runs from one kind into the other
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    distinct, names = np.unique(in_order(s[sample], s[sample + 1], s[sample + 2]), return_inverse=True)
    order = np.argsort(names) if len(distinct) == len(sample) else suffix_order(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ranked = sample[order]
    ranked = ranked[ranked < n]

    rest = np.arange(0, n, 3)
    by_next = in_order(s[:n], rank[1 : n + 1])
    rest = rest[np.argsort(by_next[rest])]
    one, two = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    both = np.concatenate([two, rest])
    by_second = in_order(s[both], s[both + 1], rank[both + 2])
    place = np.arange(len(rest)) + np.searchsorted(by_next[one], by_next[rest]) + np.searchsorted(by_second[: len(two)], by_second[len(two) :])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = rest, ranked
    return out


def again_in(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces and starts of the strings that an earlier place of the pieces holds too."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    # every piece ends in a symbol of its own, so that no prefix runs on into the next
    symbols = np.full(len(owner) + len(pieces), 0, np.int64)
    at = np.arange(len(owner)) + owner
    symbols[at] = data[: len(owner)].astype(np.int64) + len(pieces)
    symbols[begins + sizes + np.arange(len(pieces))] = np.arange(len(pieces))
    where = np.full(len(symbols), -1)
    inner = np.arange(len(owner)) - begins[owner]
    where[at] = np.where(inner + LENGTH <= sizes[owner], np.arange(len(owner)), -1)
    starts = where[suffix_order(symbols)]
    starts = starts[starts >= 0]

    words = np.zeros(len(owner), np.uint64)
    for k in range(8):
        words |= data[k : k + len(owner)].astype(np.uint64) << np.uint64(8 * k)
    same = np.arange(1, len(starts))
    for step in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same = same[words[starts[same] + step] == words[starts[same - 1] + step]]
    new = np.ones(len(starts), bool)
    new[same] = False
    first = np.minimum.reduceat(starts, np.flatnonzero(new)) if len(starts) else starts
    late = np.sort(starts[starts != first[np.cumsum(new) - 1]])
    return owner[late], inner[late]


def digests_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every LENGTH-byte string of the pieces: its piece, its start there, and the two halves of its digest."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[owner] + inner
    one, two = (Rolling(data, i).of(at, at + LENGTH) for i in (0, 1))
    return owner, inner, one, two


def strings(rows: DataFrame) -> DataFrame:
    """(key, at, d1, d2): every LENGTH-byte string of the stretches with its digest."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            pieces = batch.column(names.index("bytes")).to_pylist()
            if pieces:
                owner, inner, one, two = digests_of(pieces)
                lo = batch.column(names.index("lo")).to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(k)).take(pa.array(owner)) for k in KEY), pa.array((lo[owner] + inner).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], [*KEY, "at", "d1", "d2"])

    return rows.select(*KEY, "lo", "bytes").mapInArrow(run, "id long, tie long, at int, d1 long, d2 long")


def whole_groups(batches, column: str):
    """Tables of ROWS rows or more that hold every row of a value of the sorted `column` (the last may be smaller)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            rows = pa.Table.from_batches(held)
            values = rows.column(column).to_numpy()
            cut = int(np.flatnonzero(np.append(True, values[1:] != values[:-1]))[-1])
            if cut:
                yield rows.slice(0, cut)
                held = rows.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def compared_in_place(rows: DataFrame) -> DataFrame:
    """(key, lo, hi): ranges of the stretches whose strings an earlier one of the same anchor holds."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*KEY, "lo", "h", "bytes").repartition(width, "h").sortWithinPartitions("h", *KEY, "lo")

    def run(batches):
        for group in whole_groups(batches, "h"):
            keys = [group.column(k).to_numpy() for k in (*KEY, "lo", "h")]
            new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))  # rows alike are one document
            group = group.filter(pa.array(new))
            owner, inner = again_in(group.column("bytes").to_pylist())
            if not len(owner):
                continue
            start = np.flatnonzero((np.diff(inner, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
            end = np.append(start[1:], len(owner)) - 1
            who = owner[start]
            lo = group.column("lo").to_numpy()[who]
            yield pa.RecordBatch.from_arrays(
                [*(group.column(k).combine_chunks().take(pa.array(who)) for k in KEY), pa.array((lo + inner[start]).astype(np.int32)), pa.array((lo + inner[end] + LENGTH).astype(np.int32))],
                [*KEY, "lo", "hi"],
            )

    return dealt.mapInArrow(run, "id long, tie long, lo int, hi int")


def earliest(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """Per group its earliest place and number of rows."""
    return rows.groupBy(*by).agg(F.min(F.struct(*KEY, place)).alias("first"), F.count(F.lit(1)).alias("n"))


def later(rows: DataFrame, groups: DataFrame, by: list[str], place: str) -> DataFrame:
    """Rows that are not the earliest of their group."""
    several = groups.where("n > 1").select(*[F.col(b).alias(f"of_{b}") for b in by], "first")
    return rows.join(several, [F.col(b) == F.col(f"of_{b}") for b in by]).where(F.struct(*KEY, place) > F.col("first"))


def spans(docs: DataFrame) -> DataFrame:
    """(key, lo, hi): byte ranges that repeat an earlier string; they may overlap."""
    spark = docs.sparkSession
    common = kept(repeated_anchors(docs), "common")
    passing = spark.sparkContext.broadcast(filled(common))
    slim = kept(stretches(docs, passing), "stretches")
    first = slim.where(~F.col("again"))
    groups = kept(first.groupBy("h", "s").agg(F.min(F.struct(*KEY, "lo", "hi")).alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    whole = later(first, groups.withColumn("first", F.struct(*[F.col(f"first.{k}") for k in (*KEY, "lo")])), ["h", "s"], "lo")
    whole = kept(whole.select(*KEY, "lo", "hi").unionByName(slim.where("again").select(*KEY, "lo", "hi")), "whole")
    dropped(common, slim)

    several = groups.groupBy(F.col("h").alias("of")).agg(F.count(F.lit(1)).alias("shapes")).where("shapes > 1")
    edges = groups.join(several, F.col("h") == F.col("of")).select("first.*", "h", "shapes")
    edge = kept(edge_bytes(docs, edges), "edges")
    dropped(groups)
    near = kept(compared_in_place(edge.where(F.col("shapes") <= GROUP)), "near")
    parts = kept(strings(edge.where(F.col("shapes") > GROUP)), "strings")
    dropped(edge)
    single = later(parts, earliest(parts, ["d1", "d2"], "at"), ["d1", "d2"], "at")
    single = kept(single.select(*KEY, F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi")), "single")
    dropped(parts)
    return whole.unionByName(near).unionByName(single)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def joined_runs(found) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and text of every row, with runs: byte ranges (lo, hi) whose union is what repeats; null where nothing does."""
    lists = kept(listed(spans(docs.select("doc_id", "text")), "lo", "hi"), "runs")
    rows = docs.select(*[F.col(c).alias(f"own_{c}") for c in keep], "doc_id", "text")
    rows = rows.select(*[f"own_{c}" for c in keep], F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    out = with_lists(rows, lists, others=True)
    return out.select(*[F.col(f"own_{c}").alias(c) for c in keep if c != "text"], "text", F.col("listed").alias("runs"))


def removed(docs: DataFrame) -> DataFrame:
    rows = with_spans(docs, ["doc_id"]).select("doc_id", "text", "runs")

    def run(batch):
        out = []
        ids, texts, runs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "runs"))
        for i, t, found in zip(ids, texts, runs, strict=True):
            raw = (t or "").encode()
            cut = joined_runs((r["lo"], r["hi"]) for r in found or ())
            digest, at = hashlib.sha256(), 0
            for lo, hi in cut:
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            out.append((i, len(raw), sum(b - a for a, b in cut), len(cut), digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_text(rows, run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
