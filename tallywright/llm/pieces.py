"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked as SentencePiece does (a dummy space in front, spaces as marks)
and cut before every mark that follows another character and around line feeds;
no piece of the vocabulary crosses such a cut, which is checked when it is read.
The distinct marked words of a batch are sorted, which lays out a trie, and
walked depth-first: the stack holds the best score of every prefix, and a word
starts from those of the prefix it shares with the word before. Words met in
earlier batches are remembered, up to a bound.

The vocabulary is a byte-pair one whose scores are negated merge ranks. Viterbi
maximises a sum over pieces, for which a rank is turned into a log-probability
under Zipf's law, -log(rank + ZIPF); among segmentations of equal score the one
with the longer last piece wins. The result is a best segmentation in that sense,
which is not always the one greedy merging reaches. Characters outside the
vocabulary, line feeds and a literal mark are spelt in byte pieces, so decoding
gives back every text exactly.

Defined cases: a text without spaces is one word, however long, and is not remembered; a null text has null ids and decodes to null; an empty text has no
ids; lone surrogates cannot occur in Spark strings; unknown ids raise.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import map_text
from tallywright.session import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 while a text is marked: a lone surrogate, which no Spark string holds.
LITERAL = "\ud800"
ZIPF, BYTE_SCORE, REMEMBERED, LONG = 1000.0, -40.0, 250_000, 64
CUT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")


class Vocabulary:
    """Pieces, their Viterbi scores, and byte pieces, read from a model file (or its bytes) with the installed library."""

    def __init__(self, model: str | bytes = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        self.is_byte = {i: b for b, i in self.bytes.items()}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary must spell out bytes")
        self.scores: dict[str, tuple[float, int]] = {}
        for i, p in enumerate(self.piece):
            if not (i in self.is_byte or model.is_control(i) or model.is_unknown(i)):
                if SPACE in p.lstrip(SPACE) or "\n" in p:
                    raise ValueError(f"piece {i} crosses a cut")
                rank = min(-model.get_score(i), 1e5)
                self.scores[p] = (-math.log(rank + ZIPF), i)
        self.longest = max(map(len, self.scores))
        starts = {p[-k:] for p in self.scores for k in range(1, len(p) + 1)}
        self.tails = starts  # every ending of a piece: a suffix outside cannot grow into one
        spelt = [bytes([self.is_byte[i]]) if i in self.is_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.flat, self.sizes = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (SPACE if char == LITERAL else char).encode()]


class Encoder:
    """Encodes texts batch by batch; keeps the ids of words it has met, as bytes, and forgets them when they are many.

    Words of more than LONG characters are kept for their batch alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        self.kind = np.dtype("<u2" if len(vocabulary.piece) <= 65536 else "<u4")

    def marked_words(self, text: str) -> list[str]:
        return CUT.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))

    def ids_of(self, word: str) -> np.ndarray:
        return np.frombuffer(self.known[word], self.kind)

    def learn(self, words: set[str]) -> None:
        """Walk the sorted words depth-first; scores[k] is the best of the first k characters."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = sorted(w for w in words if w not in self.known)
        pieces, tails, longest, known = self.v.scores, self.v.tails, self.v.longest, self.known
        scores, backs, before = [0.0], [(0, -1)], ""
        for word in new:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], backs[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = scores[end - 1] + BYTE_SCORE * len(word[end - 1].encode("utf-8", "surrogatepass"))
                back = (end - 1, -1)
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    part = word[start:end]
                    if part not in tails:
                        break
                    hit = pieces.get(part)
                    if hit is not None:
                        score = scores[start] + hit[0]
                        if score >= best:
                            best, back = score, (start, hit[1])
                scores.append(best)
                backs.append(back)
            ids, at = [], len(word)
            while at:
                start, piece = backs[at]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(reversed(self.v.spell(word[start])))
                at = start
            known[word] = np.array(ids[::-1], self.kind).tobytes()
            before = word

    def encode(self, texts: list) -> list:
        """Ids of each text, None for None."""
        cut = [self.marked_words(t) if t else [] for t in texts]
        words = set().union(*cut) if cut else set()
        self.learn(words)
        out = [None if t is None else np.frombuffer(b"".join(map(self.known.__getitem__, ws)), self.kind) for t, ws in zip(texts, cut, strict=True)]
        for w in words:
            if len(w) > LONG:
                del self.known[w]
        return out


def decode(vocabulary: Vocabulary, ids) -> str | None:
    """The text the ids came from."""
    if ids is None:
        return None
    ids = np.asarray(ids, np.int64)
    sizes = vocabulary.sizes[ids]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(vocabulary.begins[ids] - ends + sizes, sizes)
    text = vocabulary.flat[at].tobytes().decode()
    return text[1:] if text.startswith(" ") else text


def listed(ids: list) -> pa.Array:
    """Id arrays as one Arrow list column, without an object an id."""
    sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
    values = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in ids if x is not None)])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    gone = np.array([x is None for x in ids] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=gone), pa.array(values, pa.int32()))


def shipped(rows: DataFrame, path: str):
    """The vocabulary file of the driver, for every executor; such files have a few MB at most."""
    with open(path, "rb") as file:
        return rows.sparkSession.sparkContext.broadcast(file.read())


def encoded(docs: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """`keep` columns with ids (array<int>) of `text`. One scan, no shuffle."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["ids array<int>"])
    state: dict = {}
    model = shipped(docs, path)

    def run(batch):
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(Vocabulary(model.value)))
        ids = encoder.encode(batch.column(batch.schema.get_field_index("text")).to_pylist())
        flat = listed(ids)
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [flat], [*keep, "ids"])

    return map_text(docs.select(*keep, *([] if "text" in keep else ["text"])), run, schema, limit=2 << 20)


def decoded(rows: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """`keep` columns with the text of `ids`."""
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])

    model = shipped(rows, path)

    def run(batches):
        vocabulary = Vocabulary(model.value)
        for batch in batches:
            texts = [decode(vocabulary, x) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], [*keep, "text"])

    return rows.select(*keep, "ids").mapInArrow(run, schema)


DIGEST = "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Number of pieces, digests of the ids (little-endian 32-bit), of the text and of what the ids decode to."""
    state: dict = {}
    model = shipped(docs, path)

    def run(batch):
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(Vocabulary(model.value)))
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        sha = lambda b: None if b is None else hashlib.sha256(b).hexdigest()
        n, by_ids, by_text, by_decoded = [], [], [], []
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            back = decode(encoder.v, ids)
            n.append(None if ids is None else len(ids))
            by_ids.append(None if ids is None else sha(ids.astype("<u4").tobytes()))
            by_text.append(None if t is None else sha(t.encode()))
            by_decoded.append(None if back is None else sha(back.encode()))
        columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (by_ids, by_text, by_decoded))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_sha256", "text_sha256", "decoded_sha256"])

    return map_text(docs.select("doc_id", "text"), run, DIGEST, limit=2 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest(table(spark, sf_dir, "documents"))
    return rows.withColumn("round_trip", F.col("text_sha256").eqNullSafe(F.col("decoded_sha256")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its text."""
    return encoded(docs, ["doc_id", "text", "lang", "source", "n_chars"])
