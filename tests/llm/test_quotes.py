import random

import duckdb

from tallywright.llm import quotes


def chain():
    return [
        (1, 0, "user", "First question here.\nSecond line."),
        (1, 1, "assistant", "> first   QUESTION here.\nAn answer."),
        (1, 2, "user", ">> First question here.\n> An answer.\nFollow up."),
        (1, 3, "user", "Unrelated."),
        (1, 4, "assistant", "> > an answer.\n>follow up.\nDone.\n> nobody wrote this"),
        (1, 5, "user", "> Second line.\nBack to the start."),
        (2, 0, "user", "First question here."),
        (2, 1, "user", "> Unrelated.\nother conversation"),
        (None, 0, "user", "> First question here."),
        (3, None, None, "x"),
        (3, 0, None, None),
        (3, 0, "user", "said twice"),
        (3, 1, "user", "> said twice\r\nand  kept"),
        (3, 1, "user", "> said twice"),
    ]


def test_chain(spark, corpus):
    path = corpus(conversations=chain())
    rows = quotes.formatted(spark.read.parquet(f"{path}/conversations.parquet")).collect()
    got = {(r["conv_id"], r["turn"]): r for r in rows if r["conv_id"] in (1, 2)}
    assert [(got[1, t]["parent_turn"], got[1, t]["thread_turn"], got[1, t]["depth"]) for t in range(6)] == [(-1, 0, 0), (0, 0, 1), (1, 0, 2), (-1, 3, 0), (2, 0, 3), (0, 0, 1)]
    assert got[1, 2]["chat"] == "<|user|>\nFollow up.\n" and got[1, 2]["quote_levels"] == 2
    assert got[2, 1]["parent_turn"] == -1
    assert len(rows) == len(chain())


def test_conversations_in_reply_order(spark, corpus):
    out = {(r["conv_id"], r["thread_turn"]): r for r in quotes.query(spark, corpus(conversations=chain())).collect()}
    one = out[1, 0]
    assert (one["turns"], one["n_messages"], one["n_links"], one["n_quoted"]) == ("0,1,2,4,5", 5, 4, 7)
    assert one["chat"] == (
        "<|user|>\nFirst question here.\nSecond line.\n<|assistant|>\nAn answer.\n<|user|>\nFollow up.\n<|assistant|>\nDone.\n<|user|>\nBack to the start.\n"
    )
    assert out[1, 3]["turns"] == "3" and out[3, 0]["n_messages"] == 4
    assert sum(r["n_messages"] for r in quotes.query(spark, corpus(conversations=chain())).collect()) == len(chain())


def test_most_quoted_text_wins(spark, corpus):
    """A quoted paragraph outweighs a quoted `ok`, and a whole passage the same lines from two messages."""
    rows = [
        (1, 0, "a", "A long paragraph that says a lot.\nIts second line, too."), (1, 1, "b", "ok"), (1, 2, "c", "Its second line, too.\nok"),
        (1, 3, "d", "> A long paragraph that says a lot.\n> Its second line, too.\nyes\n> ok\nfine"),
        (1, 4, "e", "> ok\nI agree"), (1, 5, "f", ">> A long paragraph that says a lot.\n> ok\ndeep"),
    ]
    got = {r["turn"]: r["parent_turn"] for r in quotes.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: -1, 1: -1, 2: -1, 3: 0, 4: 1, 5: 1}


def test_branches_do_not_interleave(spark, corpus):
    rows = [(1, 0, "a", "root"), (1, 1, "b", "> root\nleft"), (1, 2, "c", "> root\nright"), (1, 3, "d", "> left\nunder left"), (1, 4, "e", "> right\nunder right"), (1, 5, "f", "> under left\nlast")]
    (r,) = quotes.query(spark, corpus(conversations=rows)).collect()
    assert r["turns"] == "0,1,3,5,2,4"


def test_against_sql(spark, corpus):
    rng = random.Random(6)
    rows = chain()
    for c in range(10, 40):
        said = []
        for t in range(rng.randint(1, 12)):
            lines = [f"line {rng.randrange(6)} of {c}" for _ in range(rng.randint(0, 3))]
            quoted = ["> " * rng.randint(1, 3) + x for x in rng.sample(said, min(len(said), rng.randint(0, 2)))]
            said += lines
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(quoted + lines)))
        if c % 3 == 0:  # a whole passage, quoted
            rows += [(c, 50, "user", "one\ntwo\n\nthree\nfour"), (c, 51, "user", "> three\n> four\nyes"), (c, 52, "user", ">> three\n> yes\n\n> one\n> two\nno")]
    path = corpus(conversations=rows + [(99, 0, "user", "long line " * 20000)])
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    out = quotes.query(spark, path)
    found = con.execute(f"select {', '.join(out.columns)} from ({quotes.SQL})").fetchall()
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in out.collect())
    assert any(r["n_links"] > 2 for r in out.collect())


def test_empty(spark, corpus):
    assert quotes.query(spark, corpus(conversations=[])).count() == 0


def test_extra_columns_with_clashing_names(spark, corpus):
    rows = [(1, 0, "a", "first", 9, "p"), (1, 1, "b", "> first\nsecond", 9, "q")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent int, chat string")
    (r,) = quotes.conversations(quotes.formatted(m)).collect()
    assert r["turns"] == "0,1" and "second" in r["chat"]
