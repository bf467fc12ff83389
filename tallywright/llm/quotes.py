"""Chat formatting by quotation linking, in DataFrame functions only.

A line that begins with one or more `>` (blanks between them allowed) is quoted;
their number is its level. A passage is a run of consecutive lines of one level
between blank ones, lower-cased, blanks collapsed, trimmed and hashed; it is hashed
whole and line by line, so a quotation that was cut still links. Within a
conversation each hash is joined to the message that wrote it first (level 0), so
there is one original a hash whatever the number of messages that repeat it. What
a message quotes of an original is weighed by its characters, whole passages on top
of their lines. A message replies to the original of its least level with the most
text quoted, the latest of those alike. Threads come from pointer doubling over
the replies: a message's thread is its topmost original, and the turns on the way
are its path. Ordered by path, every message follows the one it answers and no two
branches interleave. `conversations` gives one row a thread: its messages in that
order, each without its quotes.

Defined cases: a null text has no lines and an empty message; a null conversation
or turn links with nothing and is a thread of its own; rows that repeat a turn are
kept, share its reply's target and follow each other by role and text; parent_turn
is -1 where a message answers none; it never replies to itself or a later turn. A
thread is one row and must fit in one; `formatted` has a row a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import dropped, kept
from tallywright.session import table

PREFIX = r"^[ \t]*(?:>[ \t]*)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, PREFIX, ""), r"[ \t\r]+", " ")))


def passages(lines: Column) -> Column:
    """Runs of two lines or more of one level between blank ones: (level, key), the keys of their lines joined."""
    def begins(i):
        at, before = F.get(lines, i), F.get(lines, i - 1)
        return (i == 0) | (at["key"] == "") | (before["key"] == "") | (before["level"] != at["level"])

    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)

    def run(b, i):
        part = F.slice(lines, b + 1, F.coalesce(F.get(starts, i + 1), F.size(lines)) - b)
        return F.struct(F.get(lines, b)["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["key"]), "\n").alias("key"), F.size(part).alias("lines"))

    return F.transform(F.filter(F.transform(starts, run), lambda r: r["lines"] > 1), lambda r: F.struct(r["level"].alias("level"), r["key"].alias("key")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (level, key), own (the message without quotes), max_level and n_quoted."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = messages.select("conv_id", "turn", "role", lines.alias("raw"))
    rows = rows.withColumn("lines", F.transform("raw", lambda x: F.struct(level(x).alias("level"), normal(x).alias("key"))))
    own = F.trim(F.array_join(F.filter("raw", lambda x: level(x) == 0), "\n"))
    return rows.select(
        "conv_id", "turn", "role", "lines", own.alias("own"),
        F.array_max(F.transform("lines", lambda s: s["level"])).alias("max_level"),
        F.size(F.filter("lines", lambda s: s["level"] > 0)).cast("long").alias("n_quoted"),
    )


def replies(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the message each quoting turn answers."""
    units = F.concat(F.filter("lines", lambda x: x["key"] != ""), passages(F.col("lines")))
    each = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units).alias("unit"))
    each = each.select("conv_id", "turn", "unit.level", F.sha2("unit.key", 256).alias("passage"), F.length("unit.key").alias("weight"))
    quoted = each.where("level > 0").distinct()
    asked = quoted.select(F.col("conv_id").alias("c"), F.col("passage").alias("p")).distinct()
    # originals are wanted only for passages that someone quotes
    first = each.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))
    first = first.join(asked, (F.col("conv_id") == F.col("c")) & (F.col("passage") == F.col("p"))).select("c", "p", "origin")
    met = quoted.join(first, (F.col("conv_id") == F.col("c")) & (F.col("passage") == F.col("p"))).where(F.col("origin") < F.col("turn"))
    shared = met.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("weight").alias("matched"))
    best = shared.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("matched")).alias("most"), (-F.col("origin")).alias("late"))).alias("best"))
    return best.select("conv_id", "turn", (-F.col("best.late")).alias("parent"))


def threads(links: DataFrame, rounds: int = 64) -> DataFrame:
    """conv_id, turn, parent, thread (the topmost original), depth and path (the turns from there down), by doubling."""
    now = kept(links.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.array("turn").alias("below")), "threads")
    before = now
    for _ in range(rounds):
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("higher"), F.col("below").alias("above"))
        joined = now.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        below = F.when(F.col("above").isNull(), F.col("below")).otherwise(F.concat("above", "below"))
        after = kept(joined.select("conv_id", "turn", "parent", F.coalesce("higher", "thread").alias("thread"), below.alias("below"), F.col("higher").isNotNull().alias("moved")), "threads")
        dropped(before)
        before, now = after, after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now.select("conv_id", "turn", "parent", "thread", F.size("below").cast("long").alias("depth"), F.concat(F.array("thread"), "below").alias("path"))
    raise RuntimeError("threads did not settle")


def formatted(messages: DataFrame) -> DataFrame:
    """One row a message, without quotes, with what it answers, its thread and its path there."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text"))
    found = threads(replies(rows)).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "parent", "thread", "depth", "path")
    out = rows.join(found, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return out.select(
        "conv_id", "turn", "role", F.col("max_level").cast("long").alias("quote_levels"), "n_quoted", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("path", F.array("turn")).alias("path"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("chat"),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """Of `formatted` rows, one row a thread: how many messages, quoted lines and links it has, its turns in reply order, and the chat."""
    message = F.struct("path", "chat", "turn", "n_quoted", "parent_turn")
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    several = rows.where(~alone).groupBy("conv_id", "thread_turn").agg(F.array_sort(F.collect_list(message)).alias("m"))
    single = rows.where(alone).select("conv_id", "thread_turn", F.array(message).alias("m"))
    both = several.unionByName(single)
    number = lambda f: F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return both.select(
        "conv_id", "thread_turn", F.size("m").cast("long").alias("n_messages"), number(lambda x: x["n_quoted"]).alias("n_quoted"),
        number(lambda x: (x["parent_turn"] >= 0).cast("long")).alias("n_links"), F.array_join(F.transform("m", lambda x: x["turn"].cast("string")), ",").alias("turns"),
        F.array_join(F.transform("m", lambda x: x["chat"]), "").alias("chat"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(formatted(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS raw FROM conversations),
x AS (SELECT id, conv_id, turn, unnest(raw) AS line, unnest(range(len(raw))) AS i FROM m),
l AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
        lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', ''), '[ \t\r]+', ' ', 'g'))) AS key FROM x),
o AS (SELECT id, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '')) AS own, count(*) FILTER (WHERE level > 0) AS n_quoted FROM l GROUP BY id),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM l WHERE key <> ''),
u AS (SELECT conv_id, turn, level, key FROM g
      UNION SELECT conv_id, turn, level, string_agg(key, chr(10) ORDER BY i) FROM g GROUP BY id, conv_id, turn, level, run HAVING count(*) > 1),
f AS (SELECT conv_id, key, min(turn) AS origin FROM u WHERE level = 0 AND turn IS NOT NULL GROUP BY conv_id, key),
s AS (SELECT u.conv_id, u.turn, u.level, f.origin, sum(length(u.key)) AS matched FROM u JOIN f USING (conv_id, key) WHERE u.level > 0 AND f.origin < u.turn GROUP BY u.conv_id, u.turn, u.level, f.origin),
p AS (SELECT conv_id, turn, arg_max(origin, {'level': -level, 'matched': matched, 'late': origin}) AS parent FROM s GROUP BY conv_id, turn),
t(conv_id, turn, top, below) AS (SELECT conv_id, turn, parent, [turn] FROM p UNION ALL SELECT t.conv_id, t.turn, p.parent, list_prepend(p.turn, t.below) FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.top),
h AS (SELECT conv_id, turn, arg_max(top, len(below)) AS thread, arg_max(list_prepend(top, below), len(below)) AS path FROM t GROUP BY conv_id, turn),
r AS (SELECT m.id, m.conv_id, m.turn, coalesce(h.thread, m.turn) AS thread_turn, coalesce(h.path, [m.turn]) AS path, o.n_quoted, h.thread IS NOT NULL AS linked,
        '<|' || coalesce(m.role, '') || '|>' || chr(10) || o.own || chr(10) AS chat
      FROM m JOIN o USING (id) LEFT JOIN h ON h.conv_id = m.conv_id AND h.turn = m.turn)
SELECT conv_id, thread_turn, count(*)::BIGINT AS n_messages, sum(n_quoted)::BIGINT AS n_quoted, count(*) FILTER (WHERE linked)::BIGINT AS n_links,
       coalesce(string_agg(turn::VARCHAR, ',' ORDER BY path, chat), '') AS turns, string_agg(chat, '' ORDER BY path, chat) AS chat
FROM r GROUP BY conv_id, thread_turn, CASE WHEN conv_id IS NULL OR turn IS NULL THEN id END
"""
