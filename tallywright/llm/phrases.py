"""Phrase collocations by level-wise passes over whole texts.

Pass k counts phrases of k words, a language at a time, and emits one only where
both overlapping phrases of k - 1 words are frequent. These reach the tasks as a
bit filter, built by the executors a segment each, whose size follows the number
of frequent phrases up to FILTER_BITS. What a filter lets through by mistake is
counted like the rest and falls to the exact count that follows, so its size
changes the work, never the result. Within a batch phrases are told apart by exact
ranks of their words, not by hashes.

The counts of a level are a table. A candidate's cuts are joined to the tables of
the parts, the lowest score counts, and candidates that a longer phrase explains
are dropped. Scores are computed in decimals of 38 digits.

Defined cases: a null text is empty; a null language is `und`, together with
texts that say so; words that stand alone between delimiters are counted;
repeated rows and ids count each; a word or piece of any length is taken whole;
fewer candidates than asked for are all returned; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import dropped, kept, map_text_stream
from tallywright.session import table

FREQUENT, LONGEST, FIRST, EXPLAINED, SCALE = 30, 4, 2000, 80, 2_000_000
#: A byte that no UTF-8 text holds stands for the delimiters `.,;:!?` and LF, VT, FF, CR.
END = b"\xff"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)
#: Bytes of text whose phrases are ranked at once.
WINDOW = 4 << 20
#: Bits of a filter for each phrase, at least and at most in all, and in a segment.
PER_PHRASE, LEAST_BITS, FILTER_BITS, SEGMENT_BITS = 16, 1 << 16, 1 << 29, 1 << 23
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(raw: bytes, k: int, limit: int = WINDOW):
    """The words of `raw`, with ENDs, in lists of about `limit` bytes; each k words in a row stand together in exactly one."""
    raw = raw.translate(PLAIN)
    at, carried = 0, []
    while at < len(raw):
        end = min(at + limit, len(raw))
        if end < len(raw):  # cut before a space or an END; beyond the limit where a word is longer
            cut = max(raw.rfind(b" ", at + 1, end + 1), raw.rfind(END, at + 1, end + 1))
            if cut < 0:
                cut = min((x for x in (raw.find(b" ", end), raw.find(END, end)) if x >= 0), default=len(raw))
            end = cut
        words = carried + raw[at:end].replace(END, b" " + END + b" ").split()
        yield words
        carried, at = words[len(words) - k + 1 :] if k > 1 else [], end


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(of: np.ndarray, lang: str, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, given those of the words."""
    out = np.full(max(len(of) - k + 1, 0), hashes([lang.encode()])[0])
    for j in range(k):
        out = (out ^ of[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


def probes(of: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places in a filter of `bits` (a power of two)."""
    last = np.uint64(bits - 1)
    return [of & last, (of >> np.uint64(32)) & last]


class Filter:
    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, len(packed) * 8

    def holds(self, of: np.ndarray) -> np.ndarray:
        found = np.ones(len(of), bool)
        for at in probes(of, self.bits):
            found &= (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(frequent: DataFrame, k: int) -> Filter:
    """The filter of phrases of k words in `frequent` (lang, phrase); segments are filled where they are dealt to."""
    bits = LEAST_BITS
    n = frequent.count()
    while bits < min(n * PER_PHRASE, FILTER_BITS):
        bits *= 2
    segment = min(bits, SEGMENT_BITS)

    def places(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                out[i] = mixed(hashes(phrase.encode().split(b" ")), lang, k)[0]
            at = np.concatenate(probes(out, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // segment).astype(np.int32)), pa.array((at % segment).astype(np.int32))], ["segment", "at"])

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segments, at = (batch.column(i).to_numpy() for i in (0, 1))
            for s in np.unique(segments):
                packed = held.setdefault(int(s), np.zeros(segment // 8, np.uint8))
                mine = at[segments == s]
                np.bitwise_or.at(packed, mine >> 3, np.left_shift(1, mine & 7).astype(np.uint8))
        for s, packed in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["segment", "packed"])

    dealt = frequent.select("lang", "phrase").mapInArrow(places, "segment int, at int").repartition(max(1, bits // segment), "segment")
    packed = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(fill, "segment int, packed binary").collect():  # FILTER_BITS at most
        start = row["segment"] * (segment // 8)
        packed[start : start + segment // 8] |= np.frombuffer(row["packed"], np.uint8)
    return Filter(packed)


def ranked(ids: np.ndarray, at: np.ndarray, k: int, size: int) -> np.ndarray:
    """A number for each phrase of k words that starts at `at`; equal numbers, equal phrases. ids are below `size`."""
    code, bound = ids[at].astype(np.int64), size
    for j in range(1, k):
        if bound * size >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            bound = len(distinct)
        code = code * size + ids[at + j]
        bound *= size
    return code


def tallied(words: list[bytes], lang: str, k: int, known: Filter | None) -> tuple[list[pa.Array], np.ndarray]:
    """The words of each distinct phrase of k words in a row that `known` lets through, a column a place, and its count."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    ids, distinct = coded.indices.to_numpy(), coded.dictionary
    ends = np.array([w == END for w in distinct.to_pylist()], bool)
    inside = ~ends[ids]
    n = max(len(ids) - k + 1, 0)
    allowed = np.ones(n, bool)
    for j in range(k):
        allowed &= inside[j : j + n]
    if known is not None and n:
        shorter = known.holds(mixed(hashes(distinct.to_pylist())[ids], lang, k - 1))
        allowed &= shorter[:n] & shorter[1 : n + 1]
    at = np.flatnonzero(allowed)
    _, first, counts = np.unique(ranked(ids, at, k, len(distinct)), return_index=True, return_counts=True)
    return [distinct.take(pa.array(ids[at[first] + j])) for j in range(k)], counts


def level(docs: DataFrame, k: int, known: Filter | None) -> DataFrame:
    """(lang, phrase, f) of phrases of k words; `known` holds the frequent ones of k - 1 words. One pass over `docs` (lang, text)."""
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known.packed.tobytes())

    def count(batches):
        import pyarrow.compute  # noqa: F401

        allowed = None if sent is None else Filter(np.frombuffer(sent.value, np.uint8))
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for words in windows(END.join(texts), k):
                    columns, counts = tallied(words, lang, k, allowed)
                    spelt = [c.cast(pa.string()) for c in columns]
                    joined = pc.binary_join_element_wise(*spelt, " ") if k > 1 else spelt[0]
                    for at in range(0, len(counts), 50_000):
                        some = joined.slice(at, 50_000)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(counts[at : at + 50_000].astype(np.int64))], ["lang", "phrase", "f"])

    return map_text_stream(docs, count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _joined(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """`candidates` (lang, phrase, k, a) with l, r and score of their lowest-scoring cut; `parts` (lang, phrase, f) holds every part's count."""
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", _joined(words, 1, F.col("cut"))).withColumn("right", _joined(words, F.col("cut") + 1, F.col("k") - F.col("cut")))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "decimal(38,0)"
    score = F.expr(f"CAST((CAST({SCALE}BD * a AS {wide}) DIV (CAST(l AS {wide}) + CAST(r AS {wide}))) AS long)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("lowest")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(lowest).select("lang", "phrase", "k", "a", "lowest.l", "lowest.r", "lowest.score")


def unexplained(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """`candidates` without those inside a longer one that has at least EXPLAINED percent of their count."""
    words = F.split("phrase", " ", -1)

    def of_size(size: int) -> Column:
        """The phrases of `size` words inside one, none where it is no longer."""
        begins = F.sequence(F.lit(1), F.greatest(F.col("k") - size + 1, F.lit(1)))
        return F.when(F.col("k") > size, F.transform(begins, lambda i: _joined(words, i, size))).otherwise(F.array().cast("array<string>"))

    inner = F.flatten(F.array(*map(of_size, range(2, longest))))
    around = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    gone = F.expr(f"CAST(100BD * around AS decimal(38,0)) >= CAST({EXPLAINED}BD * a AS decimal(38,0))")
    return candidates.join(around, ["lang", "phrase"], "left").where(~F.coalesce(gone, F.lit(False))).drop("around")


def first_of_each(rows: DataFrame, first: int = FIRST, cells: int = 64) -> DataFrame:
    """`rows` with their rank in their language, up to `first`; ranked in cells of a language before the few that stay meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(cells)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))).where(F.col("rank") <= first)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first).drop("cell")


def collocations(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of `docs` (lang, text)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = kept(level(texts, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    tables = [kept(words.where(F.col("f") >= frequent), "phrases")]
    for k in range(2, longest + 1):
        tables.append(kept(level(texts, k, filter_of(tables[-1], k - 1)).where(F.col("f") >= frequent), "phrases"))
    totals = kept(totals, "totals")
    dropped(words)
    parts = tables[0]
    for t in tables[1:-1]:
        parts = parts.unionByName(t)
    candidates = None
    for k, t in enumerate(tables[1:], 2):
        of_k = t.select("lang", "phrase", F.lit(k).alias("k"), F.col("f").alias("a"))
        candidates = of_k if candidates is None else candidates.unionByName(of_k)
    best = first_of_each(scored(unexplained(candidates, longest), parts), first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: Every phrase of two to four words counted, without levels.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spoken, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, k, a, size, unnest(range(1, k - size + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS size) WHERE size < k)),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
left_over AS (
  SELECT x.* FROM lowest x LEFT JOIN around y ON y.lang = x.lang AND y.phrase = x.phrase
  WHERE x.o = 1 AND NOT coalesce(100 * y.most >= 80 * x.a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
