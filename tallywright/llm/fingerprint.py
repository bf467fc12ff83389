"""Document fingerprints: improbable-feature digests in chained Bloom filters.

Every 64-byte window of a text has a collision entropy (Renyi, order 2). Over
all documents the entropies are counted, and a window's rank is how common its
entropy is: rare ones are improbable, hence telling. In each run of 64 windows the leftmost
of least rank scores a point; windows with enough points are features. A
feature's hash sets five bits of a 2048-bit Bloom filter; a filter takes 160
features, then the next one is chained. Two digests compare by the overlap of
their filters' bits, less what chance gives and over what the smaller could
give; each filter of the shorter digest takes its best partner.

Texts of fewer than 400 bytes have few such features; their 8-byte windows are
chained on in filters of their own (the whole text where it is shorter still),
and count for more by being fuller. A text that only
repeats a short passage has next to no improbable window: it is treated as a short
one, and may show no likeness to itself with other text added. Equal texts have equal digests; two empty ones have
likeness 1, an empty and another 0.

Windows are measured over whole batches at once: how many equal bytes stand
within 63 places before and after each byte comes from 63 shifted comparisons,
and a window's sum of squared counts is a running sum of their differences.

For the query, each document needs its successor by id. Documents are dealt by
ranges of the id, and each range also gets the rows that begin the next range;
the driver holds the bounds alone, and no window spans all rows.

Defined cases: a null text counts as empty; null ids come last; repeated ids are
ordered by a hash of the text; a single document is its own successor; a very long
text is measured STEP windows at a time.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import map_text, partitions
from tallywright.session import table

WINDOW, POINTS, SHORT = 64, 16, 400
FILTER_BYTES, FILTER_FEATURES, HASHES = 256, 160, 5
#: A text with fewer features (one that repeats itself throughout) is treated as a short one.
FEW = 4
LEVELS = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each 64-byte window as a level below LEVELS (-log2 of the share of equal pairs, over 6 bits)."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    step = 1 << 17
    for lo in range(0, len(data), step):  # blocks that stay in cache
        hi = min(len(data), lo + step)
        for d in range(1, WINDOW):
            if hi - d <= max(0, lo - d):
                break
            a = max(lo, d)
            same = data[a:hi] == data[a - d : hi - d]
            before[a:hi] += same
            after[a - d : hi - d] += same
    first = data[:WINDOW]
    start = int((np.bincount(first, minlength=256) ** 2).sum())
    moves = 2 * (before[WINDOW:].astype(np.int32) - after[: n - 1].astype(np.int32))
    squares = np.concatenate([[start], start + np.cumsum(moves)])
    return LEVEL_OF[squares]


LEVEL_OF = np.clip(((12 - np.log2(np.arange(1, WINDOW * WINDOW + 2) * 1.0)) / 6 * LEVELS), 0, LEVELS - 1).astype(np.int32)
LEVEL_OF = np.concatenate([[LEVELS - 1], LEVEL_OF[:-1]])


#: Windows measured at once, whatever a text's length.
STEP = 1 << 20


def features(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of selected windows in a buffer of texts, and which text each is in. `starts` has the end as its last."""
    n = len(data) - WINDOW + 1
    runs = n - WINDOW + 1
    if runs <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.zeros(n, np.uint8)
    for lo in range(0, runs, STEP):
        hi = min(runs, lo + STEP)
        rank = ranks[levels(data[lo : hi + 2 * (WINDOW - 1)])].astype(np.int64)
        least = (rank << 40) | np.arange(len(rank))
        width = 1
        while width < WINDOW:  # the least of 64 by doubling
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        first = np.searchsorted(starts, np.arange(lo, hi), "right")
        inside = np.arange(lo, hi) + 2 * (WINDOW - 1) < starts[first]
        points[lo : lo + len(rank)] += np.bincount(least[inside] & ((1 << 40) - 1), minlength=len(rank)).astype(np.uint8)
    at = np.flatnonzero(points >= POINTS)
    return at, np.searchsorted(starts, at, "right") - 1


def hashed(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the `width` bytes (a multiple of 8) at each place."""
    out = np.full(len(at), width, np.uint64)
    for k in range(0, width, 8):
        word = np.zeros(len(at), np.uint64)
        for b in range(8):
            word |= data[at + k + b].astype(np.uint64) << np.uint64(8 * b)
        out = (out ^ word) * MIX
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chained filters (k x FILTER_BYTES) of distinct features in order of first appearance."""
    _, first = np.unique(hashes, return_index=True)
    kept = hashes[np.sort(first)]
    k = -(-len(kept) // FILTER_FEATURES)
    bits = np.zeros(k * FILTER_BYTES * 8, bool)
    base = (np.arange(len(kept)) // FILTER_FEATURES) * (FILTER_BYTES * 8)
    for j in range(HASHES):
        bits[base + ((kept >> np.uint64(11 * j)) & np.uint64(2047)).astype(np.int64)] = True
    return np.packbits(bits).reshape(k, FILTER_BYTES)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text; texts are measured together, block by block."""
    out: list[np.ndarray] = [np.zeros((0, FILTER_BYTES), np.uint8)] * len(texts)
    block: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) >= 2 * WINDOW:
            block.append(i)
            size += len(t)
        if block and (size > 1 << 20 or i + 1 == len(texts)):
            _measure([texts[j] for j in block], block, ranks, out)
            block, size = [], 0
    if block:
        _measure([texts[j] for j in block], block, ranks, out)
    for i, t in enumerate(texts):
        if 0 < len(t) < SHORT or (t and np.unpackbits(out[i]).sum() < FEW * HASHES):
            data = np.frombuffer(t.ljust(8, b"\0"), np.uint8)
            out[i] = np.concatenate([out[i], filters(hashed(data, np.arange(len(data) - 7), 8))])
    return out


def _measure(texts: list[bytes], places: list[int], ranks: np.ndarray, out: list) -> None:
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    at, owner = features(data, starts, ranks)
    h = hashed(data, at, WINDOW)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, i in enumerate(places):
        out[i] = filters(h[cuts[k] : cuts[k + 1]])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how much of the shorter digest's filters the other's overlap, beyond chance."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    both = x @ y.T
    most = np.minimum(nx[:, None], ny[None, :])
    chance = nx[:, None] * ny[None, :] / (FILTER_BYTES * 8)
    cut = chance + 0.3 * (most - chance)
    score = np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0, 1).max(axis=1)
    # filters count by how full they are
    return float(min(1.0, (score * nx).sum() / nx.sum()))


def written(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of each level the texts hold; no window runs from one text into the next."""
    total = np.zeros(LEVELS, np.int64)
    block: list[bytes] = []
    size = 0

    def add():
        data = np.frombuffer(b"".join(block), np.uint8)
        inside = np.ones(len(data) - WINDOW + 1, bool)
        for end in np.cumsum([len(t) for t in block])[:-1].tolist():
            inside[end - WINDOW + 1 : end] = False
        return np.bincount(levels(data)[inside], minlength=LEVELS)

    for t in texts:
        for lo in range(0, len(t) - WINDOW + 1, STEP):
            block.append(t[lo : lo + STEP + WINDOW - 1])
            size += len(block[-1])
            if size >= STEP:
                total += add()
                block, size = [], 0
    return total + add() if block else total


def rank_table(docs: DataFrame) -> np.ndarray:
    """How common each entropy level is over all documents' windows, as a rank: the rarest level is 0."""

    def run(batch):
        total = level_counts([t.encode() for t in batch.column(0).to_pylist() if t])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    counted = map_text(docs.select("text"), run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).where("n > 0").collect()
    n = np.zeros(LEVELS, np.int64)
    for r in counted:
        n[r["level"]] = r["n"]
    ranks = np.full(LEVELS, LEVELS, np.int64)
    seen = np.flatnonzero(n)
    ranks[seen[np.lexsort((seen, n[seen]))]] = np.arange(len(seen))
    return ranks


def fingerprint(docs: DataFrame, ranks: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` columns with the digest of `text`, base64 of the chained filters. One scan, no shuffle."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["fingerprint string"])

    def run(batch):
        texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        out = pa.array([written(d) for d in digests(texts, ranks)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [out], [*keep, "fingerprint"])

    return map_text(docs.select(*keep, *([] if "text" in keep else ["text"])), run, schema)


QUERY_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Bytes of text in a part, and parts at most: beyond, parts grow and a task streams a larger one.
PART_BYTES, MOST_PARTS = 24 << 20, 100_000


def with_successors(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, doc_id, text, tie, guest) in which each part also holds, as guests, what can follow its last row.

    Parts are ranges of the id that begin with an id of the table, so the rows that
    follow a part are those whose id begins the next. The driver sees the bounds alone.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"), F.min(order).alias("first")).first()
    width = max(1, min(partitions(spark, facts["b"] or 0, PART_BYTES), facts["n"], MOST_PARTS))
    cuts = base.where(F.col("doc_id").isNotNull()).select("doc_id").stat.approxQuantile("doc_id", [i / width for i in range(1, width)], 0.2 / width) if width > 1 else []
    bounds = spark.sparkContext.broadcast((np.array(sorted({int(c) for c in cuts}), np.int64), facts["first"]))

    def run(batches):
        begins, first = bounds.value
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("doc_id"))
            empty = column.is_null().to_numpy(zero_copy_only=False)
            ids, ties = column.fill_null(0).to_numpy(), batch.column(names.index("tie")).to_numpy()
            part = np.where(empty, len(begins), np.searchsorted(begins, ids, "right"))
            opens = np.flatnonzero(~empty & (part > 0) & (begins[np.maximum(part, 1) - 1] == ids)) if len(begins) else np.zeros(0, np.int64)
            top = np.flatnonzero((empty == first["last"]) & (ids == first["id"]) & (ties == first["tie"]))
            rows = np.concatenate([np.arange(len(ids)), opens, top])
            host = np.concatenate([part, part[opens] - 1, np.full(len(top), len(begins))])
            guest = np.arange(len(rows)) >= len(ids)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(host.astype(np.int32)), pa.array(guest)], [*names, "part", "guest"])

    return base.mapInArrow(run, "doc_id long, text string, tie long, part int, guest boolean"), width


def compare(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Each document's digest against its edited text's and its successor's."""
    rows, width = with_successors(docs)
    dealt = rows.repartition(width, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_last(), "tie")

    def finish(own: list[tuple], following: list[tuple]):
        """own: (id, text); following: the (id, text) after each."""
        texts = [t.encode() for _, t in own]
        edited = []
        for (_, t), (_, after) in zip(own, following, strict=True):
            k = len(t) // 4
            edited.append((t[: len(t) - k] + after[:k]).encode())
        successors = digests([following[-1][1].encode()], ranks)
        first, second = digests(texts, ranks), digests(edited, ranks)
        nexts = first[1:] + successors
        rows = [
            (i, len(t), hashlib.sha256(e).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c))
            for (i, t), e, a, b, c in zip(own, edited, first, second, nexts, strict=True)
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], list(names))

    def run(batches):
        own, size, part = [], 0, None
        for batch in batches:
            for i, t, p, g in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
                if g:
                    if part == p and own:  # rows alike can give several guests; the first will do
                        yield finish(own, own[1:] + [(i, t)])
                        own, size = [], 0
                    continue
                if part == p and own and size > 4 << 20:
                    yield finish(own, own[1:] + [(i, t)])
                    own, size = [], 0
                part = p
                own.append((i, t))
                size += len(t)

    return dealt.mapInArrow(run, QUERY_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare(docs, rank_table(docs))
