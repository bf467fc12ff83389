"""Language identification by interpolated Kneser-Ney character models.

One model a language, orders 1 to ORDER, over lower-cased text between marks. A
symbol is a code point (one outside the basic plane is hashed into the private
area), so no script shares a symbol with another and an n-gram is one 64-bit
integer. The counts of the highest order cover every training text (a shuffle of
n-gram counts, combined in each batch first); the lower orders' continuation counts
follow from its types, and the discounts from all counts. Nothing is pruned and no
language is left out, so the model grows with the input.

The model is kept in arrays sorted by a multiplicative hash, with a table of the
hash's leading bits to enter them, one column of log-probabilities a language.
Where it has more than PART values it is cut into parts by the last symbol of the
context: all an n-gram needs but the (few) single symbols lies in one part. Parts are
built and sent one at a time, each scan adds up the n-grams of its part, and the
sums of a document meet by its key; with one part there is one scan and no shuffle.

A text's score in a language is its mean log2 probability a character; the
lowest cross-entropy wins. Confidence is a softmax of the differences over a
temperature, and a prediction whose confidence lies under a threshold is rejected:
both are fitted on at most CALIBRATION_ROWS training texts that no model counted.

Defined cases: a null text or one without a letter is `und` with score 0; ties
go to the first language by code point; without training rows all is `und`;
a null lang trains nothing; a null id counts as the empty text in the split; a very
long text is scored in blocks of BLOCK characters that continue each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import crc_of_id, dropped, kept, map_text
from tallywright.session import table

ORDER, BITS, MARK = 4, 16, 0xFFFE
#: Log-probabilities in one part of the model: 4 bytes each, and at most 8 for a key.
PART = 6_000_000
#: Characters scored at once.
BLOCK = 1 << 19
#: Training texts that fit the temperature and the rejection threshold: a tenth at most, of languages with LEAST_ROWS.
CALIBRATION_ROWS, CALIBRATION_CHARS, LEAST_ROWS = 1500, 4000, 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PRIVATE, PRIVATE_SIZE = 0xE000, 6400


def symbols(text: str) -> np.ndarray:
    """ORDER-1 marks, the text's symbols, one mark."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    far = points >= MARK
    if far.any():
        points[far] = PRIVATE + (points[far] * FACTOR >> np.uint64(40)) % np.uint64(PRIVATE_SIZE)
    edge = np.full(ORDER - 1, MARK, np.uint64)
    return np.concatenate([edge, points, edge[:1]])


def grams(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each symbol after the leading marks."""
    out = np.zeros(len(sym) - (ORDER - 1), np.uint64)
    for k in range(order):
        at = ORDER - order + k
        out = (out << np.uint64(BITS)) | sym[at : at + len(out)]
    return out


def lower(keys: np.ndarray, order: int) -> np.ndarray:
    """The last `order` symbols."""
    return keys & np.uint64((1 << (BITS * order)) - 1)


def context(keys: np.ndarray) -> np.ndarray:
    """All symbols but the last."""
    return keys >> np.uint64(BITS)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Highest-order n-grams of several texts, and where each text's begin."""
    parts = [grams(symbols(t)) for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), starts


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds what an n-gram needs: by the last symbol of its context."""
    return lower(context(keys), 1) * np.uint64(40503) % np.uint64(65521) % np.uint64(parts)


def part_column(gram, parts: int):
    """`part_of` for Spark."""
    last = F.shiftrightunsigned(gram, BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    return last * F.lit(40503) % F.lit(65521) % F.lit(parts)


@dataclass
class Sorted:
    """Rows of `values` by key, sorted by hash, entered through the hash's leading bits."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.bits = max(4, min(22, int(len(self.keys)).bit_length() + 2))
        h = self.keys * FACTOR
        order = np.argsort(h, kind="stable")
        no_key = np.uint64((1 << 64) - 1)
        self.keys, self.values = np.append(self.keys[order], no_key), np.ascontiguousarray(self.values[order])
        lead = (h[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.enter = np.searchsorted(lead, np.arange(1 << self.bits)).astype(np.int32)
        self.longest = int(np.bincount(lead).max()) if len(lead) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = self.enter[((wanted * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.where(self.keys[at] == wanted, at, -1)
        left = np.flatnonzero(out < 0)
        for step in range(1, self.longest):
            if not len(left):
                break
            spot = np.minimum(at[left] + step, len(self.keys) - 1)
            hit = self.keys[spot] == wanted[left]
            out[left[hit]] = spot[hit]
            left = left[~hit]
        return out


def types_before(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Continuation counts of `order` from the n-grams of the next: how many symbols precede each."""
    k, n = np.unique(lower(keys, order), return_counts=True)
    return k, n.astype(float)


def discount_of(ones, twos) -> float:
    return min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))


class Model:
    """Interpolated Kneser-Ney over symbols; `tables[n]` has log2 P, `contexts[n]` log2 of the back-off weight.

    `counts` has (n-grams, counts) a language. `whole` gives what a part cannot see:
    the discounts by order and language, the continuation counts of single symbols a
    language, and how many symbols there are.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], whole: tuple | None = None):
        self.languages = languages
        self.tables: dict[int, Sorted] = {}
        self.contexts: dict[int, Sorted] = {}
        by_order = []
        for keys, n in counts:
            levels = {ORDER: (keys, n.astype(float))}
            for order in range(ORDER - 1, 0, -1):
                levels[order] = types_before(levels[order + 1][0], order)
            by_order.append(levels)
        if whole is None:
            discounts = {o: [discount_of((lv[o][1] == 1).sum(), (lv[o][1] == 2).sum()) for lv in by_order] for o in range(1, ORDER + 1)}
            kinds = len(np.unique(np.concatenate([np.zeros(0, np.uint64), *(lv[1][0] for lv in by_order)])))
        else:
            discounts, singles, kinds = whole
            for lv, one in zip(by_order, singles, strict=True):
                lv[1] = one
        self.floor = -np.log2(kinds + 1)
        for order in range(1, ORDER + 1 if languages else 1):
            keys = np.unique(np.concatenate([lv[order][0] for lv in by_order]))
            ctx = np.unique(context(keys))
            prob = np.empty((len(keys), len(languages)), np.float32)
            weight = np.zeros((len(ctx), len(languages)), np.float32)
            shorter = self.log_prob(lower(keys, order - 1), order - 1)
            of_key = np.searchsorted(ctx, context(keys))
            for j, lv in enumerate(by_order):
                k, n = lv[order]
                discount = discounts[order][j]
                where = np.searchsorted(ctx, context(k))
                total = np.bincount(where, n, minlength=len(ctx))
                types = np.bincount(where, minlength=len(ctx))
                share = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
                weight[:, j] = np.log2(np.maximum(share, 1e-9))
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, k)] = n - discount
                prob[:, j] = np.log2(np.maximum(own, 0) / np.maximum(total[of_key], 1) + share[of_key] * np.exp2(shorter[:, j].astype(float)) + 1e-12)
            self.tables[order] = Sorted(keys, prob)
            self.contexts[order] = Sorted(ctx, weight)

    def log_prob(self, keys: np.ndarray, order: int) -> np.ndarray:
        """log2 P of each n-gram in each language; unseen ones back off by their context's weight."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        tab = self.tables[order]
        at = tab.find(keys)
        out = tab.values[at] if len(tab.values) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            ctx = self.contexts[order]
            c = ctx.find(context(keys[miss]))
            held = np.where((c >= 0)[:, None], ctx.values[c], np.float32(0)) if len(ctx.values) else np.float32(0)
            out[miss] = held + self.log_prob(lower(keys[miss], order - 1), order - 1)
        return out

    def sums(self, texts: list[str], part: int = 0, parts: int = 1) -> np.ndarray:
        """log2 probability of each text in each language, as far as this part knows it."""
        out = np.zeros((len(texts), len(self.languages)))
        lo = 0 if self.languages else len(texts)
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= BLOCK:
                size += len(texts[hi])
                hi += 1
            keys, starts = joined(texts[lo:hi])
            owner = np.repeat(np.arange(lo, hi), np.diff(starts))
            if parts > 1:
                mine = part_of(keys, parts) == part
                keys, owner = keys[mine], owner[mine]
            for at in range(0, len(keys), BLOCK):
                who = owner[at : at + BLOCK]
                lp = self.log_prob(keys[at : at + BLOCK], ORDER)
                first = np.flatnonzero(np.diff(who, prepend=-1))
                out[who[first]] += np.add.reduceat(lp, first, axis=0, dtype=float)
            lo = hi
        return out


@dataclass
class Decision:
    """What turns cross-entropies into a language, a confidence and a rejection."""

    languages: list[str]
    temperature: float = 0.05
    threshold: float = 0.0

    def of(self, sums: np.ndarray, lengths: np.ndarray) -> tuple[list[str], list[float], list[bool]]:
        """`lengths` has the number of n-grams, 0 for a text that cannot be told."""
        lang, score = ["und"] * len(lengths), [0.0] * len(lengths)
        some = np.flatnonzero(lengths) if self.languages else []
        if len(some):
            e = -sums[some] / lengths[some, None]
            best, p = e.argmin(axis=1), 1 / np.exp(-(e - e.min(axis=1, keepdims=True)) / self.temperature).sum(axis=1)
            for i, b, q in zip(some.tolist(), best, p, strict=True):
                lang[i], score[i] = self.languages[b], float(q)
        return lang, score, [s < self.threshold or x == "und" for x, s in zip(lang, score, strict=True)]

    def calibrate(self, sums: np.ndarray, lengths: np.ndarray, labels: list[str], keep: float = 0.98) -> None:
        """Temperature by likelihood; the threshold under which `1 - keep` of right predictions fall."""
        usable = [i for i, (n, y) in enumerate(zip(lengths, labels, strict=True)) if n and y in self.languages]
        if not usable or len(self.languages) < 2:
            return
        e = -sums[usable] / lengths[usable, None]
        y = np.array([self.languages.index(labels[i]) for i in usable])
        gap = e - e.min(axis=1, keepdims=True)
        grid = np.geomspace(0.01, 1.0, 24)
        loss = [np.mean(gap[np.arange(len(y)), y] / t + np.log(np.exp(-gap / t).sum(axis=1))) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        right = (1 / np.exp(-gap / self.temperature).sum(axis=1))[gap[np.arange(len(y)), y] == 0]
        self.threshold = float(np.quantile(right, 1 - keep)) if len(right) else 0.0


def told(texts: list) -> np.ndarray:
    """Number of n-grams of each text, 0 where it is null or has no letter."""
    return np.array([len(t.lower()) + 1 if t and any(map(str.isalpha, t)) else 0 for t in texts], np.int64)


def gram_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """lang (place in `names`), gram, n over every training text; each batch counts before anything is shuffled."""
    place = {x: i for i, x in enumerate(names)}

    def run(batch):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for lang in sorted(set(langs)):
            keys, _ = joined([t for t, x in zip(texts, langs, strict=True) if x == lang])
            k, n = np.unique(keys, return_counts=True)
            found.append((np.full(len(k), place[lang], np.int32), k, n))
        lang, gram, n = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return map_text(rows, run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Fitted:
    """The counted training texts, what all parts share, and the decision."""

    def __init__(self, names: list[str], counted: DataFrame | None):
        self.names, self.counted, self.decision = names, counted, Decision(names)
        self.parts, self._only = 1, None
        if counted is None:
            return
        ones, twos = F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")
        level, discounts, shorter = counted, {}, []
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                mask = F.lit((1 << (BITS * order)) - 1)
                level = kept(level.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{order}")
                shorter.append(level)
            facts = {r["lang"]: r for r in level.groupBy("lang").agg(ones, twos, F.count(F.lit(1)).alias("types")).collect()}
            discounts[order] = [discount_of(facts[j]["ones"], facts[j]["twos"]) if j in facts else discount_of(0, 0) for j in range(len(names))]
            if order == ORDER:
                self.parts = max(1, -(-sum(r["types"] for r in facts.values()) * len(names) // PART))
        single = level.toArrow()  # the symbols of each language
        lang, gram, n = (single.column(c).to_numpy() for c in ("lang", "gram", "n"))
        singles = []
        for j in range(len(names)):
            order = np.flatnonzero(lang == j)[np.argsort(gram[lang == j])]
            singles.append((gram[order].astype(np.uint64), n[order].astype(float)))
        self.whole = discounts, singles, len(np.unique(gram))
        dropped(*shorter)

    def models(self) -> Iterator[tuple[int, Model]]:
        """The parts, one at a time; the driver holds no more than one."""
        for p in range(self.parts):
            if self._only is not None:
                yield p, self._only
                continue
            rows = self.counted if self.parts == 1 else self.counted.where(part_column(F.col("gram"), self.parts) == p)
            flat = rows.toArrow()
            lang, gram, n = (flat.column(c).to_numpy() for c in ("lang", "gram", "n"))
            del flat
            counts = []
            for j in range(len(self.names)):
                own = lang == j
                order = np.argsort(gram[own].view(np.uint64))
                counts.append((gram[own].view(np.uint64)[order], n[own][order]))
            model = Model(self.names, counts, self.whole)
            if self.parts == 1:
                self._only = model
            yield p, model


def fit(docs: DataFrame) -> Fitted:
    """`docs`: text and lang of the training rows."""
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Fitted([], None)
    turn = F.xxhash64("text", "lang")
    large = F.create_map(*[F.lit(x) for kv in ((k, n >= LEAST_ROWS) for k, n in sizes.items()) for x in kv])
    drawn = rows.where((F.length("text") <= CALIBRATION_CHARS) & F.element_at(large, F.col("lang"))).select(turn.alias("pick")).distinct()
    picks = [r["pick"] for r in drawn.orderBy("pick").limit(min(CALIBRATION_ROWS, sum(sizes.values()) // 10)).collect()]
    chosen = docs.sparkSession.createDataFrame([(p,) for p in picks], "pick long")
    marked = rows.withColumn("turn", turn)
    held = marked.join(F.broadcast(chosen), F.col("turn") == F.col("pick")).dropDuplicates(["turn"]).sort("turn").select("text", "lang").collect()
    counted = marked.join(F.broadcast(chosen), F.col("turn") == F.col("pick"), "left_anti").select("text", "lang")
    fitted = Fitted(names, kept(gram_counts(counted, names), "grams"))
    texts = [r["text"] for r in held]
    sums = np.zeros((len(texts), len(names)))
    for p, model in fitted.models():
        sums += model.sums(texts, p, fitted.parts)
    fitted.decision.calibrate(sums, told(texts), [r["lang"] for r in held])
    return fitted


def identify(docs: DataFrame, fitted: Fitted, keep: list[str]) -> DataFrame:
    """`keep` columns with lang_pred, score and rejected. One scan a part of the model; a part has a fixed size bound."""
    spark = docs.sparkSession
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added, decision, parts = ["lang_pred", "score", "rejected"], fitted.decision, fitted.parts

    def decided(batch, sums, lengths):
        lang, score, rejected = decision.of(sums, lengths)
        return [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    def scored(texts, model, part):
        n = told(texts)
        return n, model.sums([t if k else "" for t, k in zip(texts, n, strict=True)], part, parts)

    slim = docs.select(*keep, *([] if "text" in keep else ["text"]))
    if parts == 1:
        shared = spark.sparkContext.broadcast(next(fitted.models())[1] if fitted.names else Model([], []))

        def run(batch):
            n, sums = scored(batch.column(batch.schema.get_field_index("text")).to_pylist(), shared.value, 0)
            return pa.RecordBatch.from_arrays(decided(batch, sums, n), [*keep, *added])

        return map_text(slim, run, f"{fields}, lang_pred string, score double, rejected boolean", limit=2 << 20)

    # parts: sums by text, which equal texts share
    tie = F.xxhash64("text"), F.md5(F.col("text").cast("binary"))
    rows = docs.select(*[F.col(c).alias(f"own_{c}") for c in keep], tie[0].alias("tie"), tie[1].alias("tie2"))
    texts = docs.select("text", tie[0].alias("tie"), tie[1].alias("tie2")).where("text is not null")
    found = None
    for p, model in fitted.models():
        shared = spark.sparkContext.broadcast(model)

        def add(batch, shared=shared, p=p):
            n, sums = scored(batch.column(batch.schema.get_field_index("text")).to_pylist(), shared.value, p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("tie")), batch.column(batch.schema.get_field_index("tie2")), pa.array(n), lists], ["tie", "tie2", "n", "sums"])

        one = map_text(texts, add, "tie long, tie2 string, n long, sums array<double>", limit=2 << 20)
        one = kept(one.groupBy("tie", "tie2").agg(F.first("n").alias("n"), F.first("sums").alias("sums")), "sums")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array(*[F.lit(0.0)] * len(fitted.names))
    total = found.groupBy("tie", "tie2").agg(F.first("n").alias("n"), F.aggregate(F.collect_list("sums"), zero, plus).alias("sums"))
    met = rows.join(total.select(F.col("tie").alias("t"), F.col("tie2").alias("t2"), "n", "sums"), (F.col("tie") == F.col("t")) & (F.col("tie2") == F.col("t2")), "left")
    met = met.select(*[F.col(f"own_{c}").alias(c) for c in keep], F.coalesce("n", F.lit(0)).alias("own_n"), F.coalesce("sums", zero).alias("own_sums"))

    def decide(batches):
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("own_n")).to_numpy()
            sums = batch.column(batch.schema.get_field_index("own_sums")).flatten().to_numpy().reshape(len(n), -1)
            yield pa.RecordBatch.from_arrays(decided(batch, sums, n), [*keep, *added])

    return met.mapInArrow(decide, f"{fields}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lang_kept` is the prediction where it is not rejected, else `und`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fitted = fit(docs.where(crc_of_id() % 3 != 1))
    found = identify(docs.select("doc_id", "text"), fitted, ["doc_id"])
    held_out = (crc_of_id() % 3 == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected", F.when(F.col("rejected"), F.lit("und")).otherwise(F.col("lang_pred")).alias("lang_kept"))
