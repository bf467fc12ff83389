import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallywright.llm import lengths

from .conftest import doc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts(n=60):
    rng = random.Random(3)
    alphabet = ["the ", " a", "  ", "\n", "\t", "é", "😀", "▁", "ing", "<s>", "</s>", "x", "0", "zq", "文", "\x00", "ﬁ", "word", "-"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(n)]


def test_query_against_the_library_on_whole_texts(spark, corpus):
    rows = [doc(i, t) for i, t in enumerate(texts())] + [doc(None, None), doc(900, ""), doc(901, " "), doc(902, "word " * 9000), doc(902, "word " * 9000), doc(903, "a" * 40_000), doc(904, "zq" * 60_000)]
    out = lengths.query(spark, corpus(documents=rows))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(i), len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()) == want


@pytest.mark.parametrize("part", [1, 3, 17, 200])
def test_parts_add_up_wherever_they_are_cut(part, monkeypatch):
    monkeypatch.setattr(lengths, "PART", part)
    monkeypatch.setattr(lengths, "CALL", 50)
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        with open(path, "rb") as f:
            by = lengths.counter(path, f.read())
        some = texts() + ["Don't stop it's 3 4 5five  six", "á b ́c", "", "<|endoftext|> a <|endoftext|>b c", " lead", "x" * 50]
        whole = [len(by.library.encode(t)) if name.endswith(".model") else len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in some]
        assert lengths.lengths(by, some).tolist() == whole
        assert max(len(by.parts(t)) for t in some) > 1


def test_kept_columns_and_unknown_kinds(spark):
    docs = spark.createDataFrame([(1, "one two", "here", 7)], "doc_id long, body string, text string, n_tokens long")
    row = lengths.token_counts(docs, ["doc_id", "text", "n_tokens"], MODEL, text="body", limit=1).first()
    assert row.asDict() == {"doc_id": 1, "text": "here", "n_bytes": 7, "n_tokens": 2, "over_limit": True}
    with pytest.raises(ValueError):
        lengths.counter("x.vocab", b"")


def test_empty_table(spark, corpus):
    assert lengths.query(spark, corpus(documents=[])).count() == 0
