"""Token counts by batch encoding: Arrow batches go in, only lengths come out.

Texts arrive in Arrow batches cut by bytes. A long text is split where the
vocabulary cannot join what stands on both sides, and the parts of a batch are
dealt to calls of about equal bytes, so that one long text never makes one long
call and ids live only until they are counted.

Safe boundaries:

* `.model` (sentencepiece): between two characters that no piece holds side by
  side. Merging only ever joins neighbours into a piece, so nothing crosses such
  a place, and merges on either side of it do not touch each other. Parts after
  the first start with a line feed, which no piece holds, so that the space the
  library puts in front of a text stays out of them; its tokens are taken off.
* `.json` (tokenizers): before a single space between ASCII letters or digits,
  where pre-tokenizers that split words begin a new word. Whether the given file
  does so is tried when it is read; if not, texts are encoded whole.

Special strings in a text are handled as each library does by default; nothing is
added in front or behind, truncated or padded.

Defined cases: a null text counts as empty, and empty texts have 0 bytes and
tokens; a text without a safe boundary (one character repeated, say) is one part,
however long, and takes the library's memory for it; rows that repeat an id, null
ids and other columns are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import map_text
from tallywright.session import table

#: Characters in a part of a long text, and bytes in one call of the library.
PART, CALL = 16_384, 1 << 20
LIMIT = 4096
SPACE = "▁"
WORD_START = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


class Pieces:
    """A sentencepiece model as a counter of tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # a model that folds white space, puts nothing in front or joins line feeds may see a part otherwise than the whole
        plain = "".join(self.library.encode("a  b ", out_type=str)) == f"{SPACE}a{SPACE}{SPACE}b{SPACE}" and not any("\n" in p for p in pieces)
        self.front, self.extra = ("\n", self.sizes(["\n"])[0]) if plain else (None, 0)

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def parts(self, text: str) -> list[str]:
        """`text` cut at safe boundaries into parts of PART characters or a little more."""
        if len(text) <= PART or self.front is None:
            return [text]
        cuts, at, marked, joined = [0], PART, text.replace(" ", SPACE), self.joined
        while at < len(text):
            if marked[at - 1 : at + 1] in joined:
                at += 1
            else:
                cuts.append(at)
                at += PART
        return [text[a:b] if a == 0 else self.front + text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Words:
    """A tokenizers file as a counter of tokens."""

    front, extra = "", 0

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(model)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        tried = (("One two", " three4 five"), ("a1", " 22b"), ("Don't", " it"))
        self.splits = not any(t.lstrip or t.rstrip or " " in t.content for t in added) and all(sum(self.sizes([a, b])) == self.sizes([a + b])[0] for a, b in tried)

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        if len(text) <= PART or not self.splits:
            return [text]
        cuts, at = [0], PART
        while (hit := WORD_START.search(text, at)) is not None:
            cuts.append(hit.start())
            at = hit.start() + PART
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def counter(path: str, model: bytes) -> Pieces | Words:
    if path.endswith(".model"):
        return Pieces(model)
    if path.endswith(".json"):
        return Words(model)
    raise ValueError("a tokenizer is a .model or a .json file")


def lengths(by: Pieces | Words, texts: list[str]) -> np.ndarray:
    """Tokens of each text, by calls of about CALL bytes over the parts of all."""
    out, call, owners, size = np.zeros(len(texts), np.int64), [], [], 0

    def flush():
        np.add.at(out, owners, by.sizes(call))
        call.clear()
        owners.clear()

    for row, text in enumerate(texts):
        if not text:
            continue
        parts = by.parts(text)
        out[row] = -by.extra * (len(parts) - 1)
        for part in parts:
            call.append(part)
            owners.append(row)
            size += len(part.encode()) if not part.isascii() else len(part)
            if size >= CALL:
                flush()
                size = 0
    if call:
        flush()
    return out


def token_counts(docs: DataFrame, keep: list[str], path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`keep` columns with n_bytes, n_tokens and over_limit of `text`. One scan, no shuffle.

    `path` is read on the driver and shipped to the executors; such files have a
    few MB. A kept column that has one of the three names gives way to it.
    """
    named = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    state: dict = {}

    def run(batch):
        by = state.get("by") or state.setdefault("by", counter(path, model.value))
        column = pc.fill_null(batch.column(len(named)), "")
        n_tokens = lengths(by, column.to_pylist())
        sizes = pc.cast(pc.binary_length(column), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(named))] + [sizes, pa.array(n_tokens), pa.array(n_tokens > limit)], [*named, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in named] + ["n_bytes long, n_tokens long, over_limit boolean"])
    return map_text(docs.select(*named, F.col(text).alias("_text")), run, schema, text="_text", limit=2 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
