"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence s gets a probability from the
words in it, and the document is toxic if any sentence is:

    p_s = max(0, (sigmoid(b + w.x_s) - sigmoid(b)) / (1 - sigmoid(b)))
    P   = 1 - (1 - leak) * prod_s (1 - p_s)

Only document labels train it. A sentence without evidence has p_s = 0, so a
long clean document does not drift upward with its number of sentences. The
weights are sparse (proximal L1), so scoring looks up the weighted features and
splits sentences only in texts that hold one which raises; every weight that
training leaves and every sentence counts, as in training. Features are words and
their four- to six-character beginnings.

Defined cases: a null or empty text scores the leak; a null label is no label; an
id with both labels is toxic; documents that repeat an id each count as their own
row; an empty training set gives leak 0. Where no feature has the rows it takes,
the leak is the share of toxic rows among all labelled ones that are not held out,
LEAST_KNOWN at most, so that nothing is rejected without evidence. A very long
text is scored whole, a sentence at a time. A kept column that has the name of a
result gives way to it.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import crc_of_id, map_text
from tallywright.session import table

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")

#: Bounds of the training sample, by label and in characters a document.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE, SAMPLE_CHARS = 2500, 4000, 12_000
BIAS = -4.0
#: The leak that training starts from, and its most where no feature is learnt.
LEAST_KNOWN = 0.05
SHORTEST = 4
#: Words whose features a task keeps.
REMEMBERED = 60_000


def features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    leak: float = 0.0

    def __post_init__(self):
        self.starts = {f.rstrip("*")[:SHORTEST] for f in self.weights}


#: Sentences whose features are handled at once in training.
SENTENCES = 1 << 14


def train(texts: list[str], labels: list[int], epochs: int = 30, l1: float = 25.0, rate: float = 0.25, least: int = 10, share: float | None = None) -> Model:
    """Full-batch proximal Adam on the noisy-or likelihood; deterministic. l1 is in documents' worth of gradient.

    `share`: of toxic rows where `texts` are not drawn in proportion.
    """
    if not texts:
        return Model()
    seen: Counter = Counter()
    for t in texts:
        seen.update({f for w in set(TOKEN.findall((t or "").lower())) for f in features(w)})
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    del seen
    parts = {f.rstrip("*")[:SHORTEST] for f in vocabulary}
    y = np.array(labels, float)
    owners, starts, columns = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for m in SENTENCE.finditer((t or "").lower()):
            ids = {vocabulary[f] for w in set(TOKEN.findall(m[0])) if w[:SHORTEST] in parts for f in features(w) if f in vocabulary}
            if ids:
                owners.append(d)
                starts.append(len(columns))
                columns.extend(sorted(ids))
    rate_of_label = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    if not columns:
        return Model({}, min(LEAST_KNOWN, rate_of_label if share is None else share))
    owners, starts, columns = (np.frombuffer(x, np.int32) for x in (owners, starts, columns))
    ends = np.append(starts[1:], len(columns))
    blocks = [slice(i, min(i + SENTENCES, len(starts))) for i in range(0, len(starts), SENTENCES)]
    w, m, v = (np.zeros(len(vocabulary)) for _ in range(3))
    leak, base = min(LEAST_KNOWN, rate_of_label), 1 / (1 + np.exp(-BIAS))
    for step in range(1, epochs + 1):
        z = np.concatenate([np.add.reduceat(w[columns[starts[b][0] : ends[b][-1]]], starts[b] - starts[b][0]) for b in blocks])
        s = 1 / (1 + np.exp(-np.clip(BIAS + z, -30, 30)))
        p = np.clip((s - base) / (1 - base), 0, 1 - 1e-9)
        log_clean = np.bincount(owners, np.log1p(-p), minlength=len(y)) + np.log1p(-leak)
        clean = np.exp(log_clean)
        # the loss's slope in log_clean, then in each sentence's logit; one at p = 0 can only be raised
        pull = (y * clean / np.maximum(1 - clean, 1e-9) - (1 - y)) / len(y)
        by_logit = -pull[owners] * s * (1 - s) / ((1 - base) * (1 - p))
        by_logit[(s < base) & (by_logit > 0)] = 0
        grad = np.zeros(len(w))
        for b in blocks:
            grad += np.bincount(columns[starts[b][0] : ends[b][-1]], np.repeat(by_logit[b], ends[b] - starts[b]), minlength=len(w))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= scale * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1 * 0.3 / len(y), 0)
        quiet = np.bincount(owners, p, minlength=len(y)) < 1e-3
        if quiet.any():
            leak = float(np.clip(y[quiet].mean(), 1e-4, 0.25))
    return Model({f: float(w[i]) for f, i in vocabulary.items() if w[i]}, leak)


def training_sample(docs: DataFrame, labels: DataFrame) -> list:
    """A bounded sample of labelled rows in an order that depends on hashes alone.

    The draw joins ids and hashes, never texts; the ids drawn (no more than the
    two bounds) are then sent to the scan that fetches their texts. The two labels
    are not weighed back to their shares: held-out log loss was worse for it.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("one")).where(F.col("one").isin(0, 1))
    known = known.groupBy("label_id").agg(F.max("one").alias("label"))
    slim = docs.where((crc_of_id() % 4 != 2) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", F.xxhash64("text", "doc_id").alias("turn"))
    drawn = slim.join(known, F.col("doc_id") == F.col("label_id")).select("label", "turn")
    picks = []
    for label, most in ((1, SAMPLE_POSITIVE), (0, SAMPLE_NEGATIVE)):
        picks += drawn.where(F.col("label") == label).orderBy("turn").limit(most).collect()
    if not picks:
        return []
    chosen = docs.sparkSession.createDataFrame([(r["turn"], r["label"]) for r in picks], "pick long, label int").dropDuplicates(["pick"])
    found = docs.withColumn("turn", F.xxhash64("text", "doc_id")).join(F.broadcast(chosen), F.col("turn") == F.col("pick"))
    return sorted(found.select("label", "text", "turn").collect(), key=lambda r: (r["turn"], r["label"]))


def toxic_share(labels: DataFrame) -> float:
    """Of the labelled ids that are not held out."""
    known = labels.where((crc_of_id() % 4 != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return float(known.agg(F.avg("label").alias("share")).first()["share"] or 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = training_sample(docs.select("doc_id", "text"), labels)
    return train([r["text"] or "" for r in sample], [r["label"] for r in sample], share=toxic_share(labels))


def word_features(model: Model, known: dict[str, tuple], word: str) -> tuple[str, ...]:
    """The weighted features of a token."""
    found = known.get(word)
    if found is None:
        found = known[word] = tuple(f for f in features(word) if f in model.weights)
    return found


def score_text(model: Model, known: dict[str, tuple], text: str | None) -> tuple[float, float, int, int]:
    """P, then the worst sentence: its score, start and end in code points (-1 where there is none).

    `known` keeps the features of words met before; it is emptied when it grows large.
    """
    if not text or not model.weights:
        return model.leak, 0.0, -1, -1
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; offsets stay those of the text
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    if len(known) > REMEMBERED:
        known.clear()
    raising = [w for w in set(TOKEN.findall(low)) if w[:SHORTEST] in model.starts and any(model.weights[f] > 0 for f in word_features(model, known, w))]
    if not raising:
        return model.leak, 0.0, -1, -1
    clean, worst, base = 1.0 - model.leak, (0.0, -1, -1), 1 / (1 + math.exp(-BIAS))
    for m in SENTENCE.finditer(low):
        part = m[0]
        if not any(w in part for w in raising):  # its evidence cannot be above nothing
            continue
        z = sum(model.weights[f] for f in sorted({f for w in set(TOKEN.findall(part)) if w[:SHORTEST] in model.starts for f in word_features(model, known, w)}))
        if z > 0:
            p = (1 / (1 + math.exp(-min(30.0, BIAS + z))) - base) / (1 - base)
            clean *= 1 - min(p, 1 - 1e-9)
            if p > worst[0]:
                worst = (p, m.start(), m.end())
    return min(1.0, max(0.0, 1 - clean)), *worst


RESULTS = ["score", "worst_score", "worst_start", "worst_end"]
SCORE_SCHEMA = "score double, worst_score double, worst_start long, worst_end long"


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of every row with its score and worst sentence. One scan, no shuffle."""
    keep = [c for c in keep if c not in RESULTS]
    slim = docs.select(*keep, *([text] if text not in keep else []))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [SCORE_SCHEMA])

    known: dict[str, tuple] = {}

    def run(batch):
        found = [score_text(model, known, t) for t in batch.column(text).to_pylist()]
        kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
        extra = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + extra, keep + RESULTS)

    return map_text(slim, run, schema, text)


def query(spark: SparkSession, sf_dir: str, cut: float = 0.3) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, cut: float = 0.3) -> DataFrame:
    """Documents that are not rejected, with the columns they came with."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return score(docs, model, columns).where(F.col("score") < cut).select(*columns)
