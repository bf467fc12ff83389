import hashlib
import random
import re

import pytest

from tallywright.llm import pieces

from .conftest import doc

TEXTS = ["", " ", "  two  spaces ", "plain words here", "line\nbreaks\n\n\tand tabs\r\n", "▁literal▁ ▁▁ mark", "naïve 東京 😀 é", "\x00\x01", "", "a" * 3000, "word " * 2000, "<0x41> <s> </s> <unk>"]


def brute(vocabulary, word):
    """Best score over all segmentations, by recursion."""
    best = {0: 0.0}
    for end in range(1, len(word) + 1):
        options = [best[end - 1] + pieces.BYTE_SCORE * len(word[end - 1].encode("utf-8", "surrogatepass"))]
        options += [best[s] + vocabulary.scores[word[s:end]][0] for s in range(end) if word[s:end] in vocabulary.scores]
        best[end] = max(options)
    return best[len(word)]


def score(vocabulary, ids):
    by_id = {i: s for s, i in vocabulary.scores.values()}
    return sum(by_id.get(i, pieces.BYTE_SCORE) for i in ids)


def test_shared_prefixes_give_the_best_segmentation():
    v = pieces.Vocabulary()
    rng = random.Random(1)
    words = {pieces.SPACE + "".join(rng.choices(["the", "re", "in", "tion", "é", "x", "東", "1"], k=rng.randint(1, 6))) for _ in range(300)}
    words |= {w[:k] for w in list(words) for k in (2, 3)}
    e = pieces.Encoder(v)
    e.learn(words)
    for w in words:
        assert score(v, e.ids_of(w)) == pytest.approx(brute(v, w))
        assert pieces.decode(v, e.ids_of(w)).lstrip(" ") == w.lstrip(pieces.SPACE)


def test_round_trip_of_awkward_texts():
    v = pieces.Vocabulary()
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([32, 10, 0x2581, 97, 233, 0x1F600, 0xE000, 0xFFFF])) for _ in range(50)) for _ in range(200)]
    e = pieces.Encoder(v)
    assert [pieces.decode(v, x) for x in e.encode(texts)] == texts
    assert e.encode([None]) == [None] and pieces.decode(v, None) is None


def test_forgetting_changes_nothing(monkeypatch):
    v = pieces.Vocabulary()
    whole = pieces.Encoder(v).encode(TEXTS)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    e = pieces.Encoder(v)
    assert [e.encode([t])[0].tolist() for t in TEXTS] == [x.tolist() for x in whole]
    assert not any(len(w) > pieces.LONG for w in e.known)


def test_query_and_columns(spark, corpus):
    rows = [doc(i, t) for i, t in enumerate(TEXTS)] + [doc(None, None), doc(3, "again"), doc(3, "again")]
    path = corpus(documents=rows)
    out = pieces.query(spark, path).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as ids")
    back = pieces.decoded(pieces.encoded(docs, ["doc_id"]), ["doc_id"])
    assert sorted(map(str, [r["text"] for r in back.collect()])) == sorted(map(str, [r[1] for r in rows]))
    assert pieces.query(spark, corpus(documents=[])).count() == 0


def plain_ids(v, text):
    """Every word on its own, every piece tried at every place; of equal scores the longer last piece."""
    out = []
    for word in re.findall(f"{pieces.SPACE}*[^{pieces.SPACE}\n]+|{pieces.SPACE}+|\n+", pieces.SPACE + text.replace(pieces.SPACE, pieces.LITERAL).replace(" ", pieces.SPACE)):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            char = word[end - 1]
            spelt = [v.bytes[b] for b in (pieces.SPACE if char == pieces.LITERAL else char).encode()]
            options = [(best[end - 1][0] + pieces.BYTE_SCORE * len(char.encode("utf-8", "surrogatepass")), best[end - 1][1] + spelt)]
            for start in range(end):
                if word[start:end] in v.scores:
                    score, i = v.scores[word[start:end]]
                    options.append((best[start][0] + score, best[start][1] + [i]))
            most = max(s for s, _ in options)
            by_piece = [o for o in options[1:] if o[0] == most]
            best.append(by_piece[0] if by_piece else options[0])
        out += best[-1][1]
    return out


def test_digests_against_a_plain_version(spark, corpus):
    v = pieces.Vocabulary()
    rng = random.Random(4)
    texts = [t for t in TEXTS if len(t) < 100] + [" ".join("".join(rng.choices("etaoin shrdlu.é東\n", k=rng.randint(1, 9))) for _ in range(12)) for _ in range(25)]
    out = pieces.query(spark, corpus(documents=[doc(i, t) for i, t in enumerate(texts)])).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]]
        ids = plain_ids(v, text) if text else []
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_pieces"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest()), text
        assert r["text_sha256"] == r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
