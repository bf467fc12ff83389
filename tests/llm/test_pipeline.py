import random
import re
from collections import Counter

import corpus_pipeline
from tallywright.llm import mixing, pieces, pii

from .conftest import doc
from .test_minhash import brute as near_brute
from .test_minhash import varied


def test_stages_against_replay(spark, corpus):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(vocabulary, k=60)
        bad = i % 4 == 0
        text = " ".join(words) + (". you total grumbler. " if bad else ". a fine day. ")
        rows.append(doc(i, text + (f"mail x{i}@y.com" if i % 5 == 0 else ""), source=f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    for i in range(240, 270):
        rows.append(doc(i, varied(rng, rows[i - 239][1].split(" "), 1), source="s1"))
    path = corpus(documents=rows, labels=labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    toxic = {r[0] for r in rows if "grumbler" in r[1]}
    left = [r for r in rows if r[0] not in toxic]
    left = [r for r, (_, _, _, keep) in zip(left, sorted(near_brute(left)), strict=True) if keep]
    clean = {r[0]: (re.sub(r"x\d+@y\.com", "[EMAIL]", r[1]), r[3]) for r in left}
    frame = spark.createDataFrame([doc(i, t, source=s) for i, (t, s) in clean.items()], docs.schema)
    copies = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(frame).collect()})
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in out) == +copies
    v = pieces.Vocabulary()
    assert all(pieces.decode(v, r["ids"]) == r["text"] == clean[r["doc_id"]][0] for r in out)
    assert pii.KINDS and corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, corpus):
    assert corpus_pipeline.run(spark, corpus(documents=[], labels=[])).count() == 0
