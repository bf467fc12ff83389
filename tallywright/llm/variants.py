"""Spelling variants: words one edit apart, found by forward and reversed sorted dictionaries.

Take two words that differ by one inserted, deleted or replaced code point, the
longer of L code points, and let a be the length of their common prefix. All that
follows the edit agrees, so they share a suffix of L - 1 - a. Either a reaches
L // 2 and they stand in one block of the forward dictionary (words by length and
first half), or the edit lies before it and they stand in one block of the
reversed dictionary (words by length and last half). A block is thus a range of a
such that the edit lies between a shared beginning of p and a shared end of s
code points. Blocks of more than BLOCK words are divided again by the same rule,
half of what lies between at a time; where one code point is left, a block holds
at most one word for each letter and the one word that lacks it. So no block is
unbounded and no pair is lost, and each pair is found in one block only, that of
its own a.

Blocks meet by a sort-merge join on their bounds, in which the edit distance is
checked; what leaves the join is near pairs alone.

Defined cases: a null text has no words; a null id is the empty text in the hash;
rows that repeat an id count each; a word of any length is one key; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import dropped, kept, map_text_stream
from tallywright.session import table

RUN = re.compile("[a-zÀ-ÿ]+")
LONGER, OFTEN, EVERY, RATIO = 5, 3, 97, 2
#: Words in a block beyond which it is divided.
BLOCK = 64
#: Characters of a text that are split into words at once; words and characters that a task holds before it hands counts on.
WINDOW, HELD, HELD_CHARS = 1 << 20, 200_000, 8 << 20
BOUNDS = ["size", "head_size", "tail_size", "head", "tail"]


def runs(text: str):
    """Lists of the lower-cased runs of letters of `text`, a window at a time; windows end between runs."""
    text = text.encode().lower().decode()  # bytes.lower changes A-Z alone
    at = 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        if end < len(text) and (more := RUN.match(text, end)):
            end = more.end()
        yield RUN.findall(text, at, end)
        at = end


def altered(doc_id, run: str) -> str:
    """The run, without one of its code points where the hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, change=None, longer: int = LONGER, often: int = OFTEN) -> DataFrame:
    """(word, n) of words with at least `longer` code points and `often` occurrences; `change` maps (doc_id, run) to the word to count."""

    def count(batches):
        held: dict[str, int] = {}
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[str, int] = {}
                for window in runs(text) if text else ():
                    for run in window:
                        seen[run] = seen.get(run, 0) + 1
                for run, n in seen.items():
                    word = change(doc_id, run) if change else run
                    if len(word) >= longer:
                        if word not in held:
                            chars += len(word)
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD or chars > HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held, chars = {}, 0
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counts = map_text_stream(docs.select("doc_id", "text"), count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _tail(word: Column | str, size: Column | str) -> Column:
    return F.reverse(F.substring(F.reverse(F.col(word)), F.lit(1), F.col(size)))


def _bounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.substring(F.col("word"), F.lit(1), F.col("head_size"))).withColumn("tail", _tail("word", "tail_size"))


def divided(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that its block (size, head_size, tail_size) is divided into."""
    between = F.col("size") - F.col("head_size") - F.col("tail_size")
    half = F.floor(between / 2).cast("int")
    two = F.array(
        F.struct((F.col("head_size") + half).alias("p"), F.col("tail_size").alias("s")),  # the edit lies after the half
        F.struct(F.col("head_size").alias("p"), (F.col("tail_size") + between - half).alias("s")),  # before it
    )
    out = rows.drop("head", "tail").withColumn("to", F.explode(two))
    return _bounded(out.withColumn("head_size", F.col("to.p")).withColumn("tail_size", F.col("to.s")).drop("to"))


def first_blocks(words: DataFrame) -> DataFrame:
    """Every word as the longer of a pair and as the shorter, in the forward and the reversed dictionary."""
    sized = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    return divided(sized.withColumn("head_size", F.lit(0)).withColumn("tail_size", F.lit(0)))


def blocks(words: DataFrame, most: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of `words` in blocks of at most `most` words (or of one open code point), and the tables to drop afterwards."""
    level, ready, temporary = first_blocks(words), None, []
    while True:
        wide = F.col("size") - F.col("head_size") - F.col("tail_size") > 1
        crowded = kept(level.where(wide).groupBy(*BOUNDS).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most).drop("members"), "crowded")
        temporary.append(crowded)
        if crowded.isEmpty():
            return (level if ready is None else ready.unionByName(level)), temporary
        small = level.join(crowded, BOUNDS, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        level = kept(divided(level.join(crowded, BOUNDS, "left_semi").select("word", "n", "size", "head_size", "tail_size")), "blocks")
        temporary.append(level)


def near_pairs(words: DataFrame, most: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(u, u_n, v, v_n), once for each two words one edit apart, and the tables to drop afterwards."""
    rows, temporary = blocks(words, most)
    longer = rows.where(F.length("word") == F.col("size")).select(*BOUNDS, F.col("word").alias("u"), F.col("n").alias("u_n")).alias("longer")
    other = rows.select(*BOUNDS, F.col("word").alias("v"), F.col("n").alias("v_n")).alias("other")
    size, edge = F.col("longer.size"), F.col("longer.size") - F.col("longer.tail_size")
    own = F.substring(F.col("u"), F.lit(1), edge) != F.substring(F.col("v"), F.lit(1), edge)  # the common prefix ends within the block
    once = (F.length("v") < size) | (F.col("u") < F.col("v"))
    on = once & own & (F.levenshtein("u", "v", 1) == 1)
    for c in BOUNDS:
        on = (F.col(f"longer.{c}") == F.col(f"other.{c}")) & on
    return longer.join(other, on).select("u", "u_n", "v", "v_n"), temporary


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of `forms` (word, form): the last word that following forms reaches, by doubling steps.

    Chains are short (each form has RATIO times the occurrences), so a handful of rounds ends them.
    """
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = kept(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(now)
        settled, now = after.where("moved").isEmpty(), after
        if settled:
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of `words` (word, n).

    A word's form is its near word of largest n (ties: the smallest) if that has at least `ratio` times its n.
    """
    words = kept(words, "words")
    pairs, temporary = near_pairs(words, most)
    both = F.array(F.struct(F.col("u").alias("word"), F.col("u_n").alias("n"), F.col("v").alias("near"), F.col("v_n").alias("near_n")), F.struct(F.col("v").alias("word"), F.col("v_n").alias("n"), F.col("u").alias("near"), F.col("u_n").alias("near_n")))
    linked = pairs.select(F.explode(both).alias("x")).select("x.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    found = linked.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    near = kept(found.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "near")
    dropped(*temporary)
    ends = roots(near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), altered)).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 bit by bit, near words by wildcards and deletions, roots by recursion.
SQL = """
WITH RECURSIVE
runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
bits AS (
  SELECT run, c, flatten(list_transform(range(0, octet_length(encode(s))::BIGINT),
      lambda i: list_transform(range(0, 8), lambda k: (('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT >> k) & 1))) AS b
  FROM (SELECT run, c, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs)),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) AS h FROM bits),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS z FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT x.word AS u, y.word AS v FROM cut x JOIN cut y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.a || c.z
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.a || c.z),
ranked AS (
  SELECT u, v, w.n AS v_n, row_number() OVER (PARTITION BY u ORDER BY w.n DESC, v) AS k, count(*) OVER (PARTITION BY u) AS n_near
  FROM near JOIN words w ON w.word = v),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.v_n >= 2 * w.n THEN r.v END AS form, CASE WHEN r.v_n >= 2 * w.n THEN r.v_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.u = w.word AND r.k = 1),
follow AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT f.word, x.form FROM follow f JOIN formed x ON x.word = f.at WHERE x.form IS NOT NULL)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM formed f JOIN (SELECT w.word, w.at FROM follow w JOIN formed x ON x.word = w.at WHERE x.form IS NULL) e ON e.word = f.word
"""
