"""Personal data: candidate spans, boosted trees and calibrated thresholds, in DataFrame functions only.

Base spans are fixed rules (email, ip, card, phone), leftmost and non-overlapping
a kind, a failing match dropped without a retry. High-recall generators propose
further, overlapping candidates; each becomes a handful of yes/no features of its
format and context. The trees learn which candidates lie in base spans with what
the rules test (an at sign, a leading plus, a checksum, the range of an octet)
masked, so they must tell by what stands around it: a card with a mistyped digit or
a phone number without its plus is then taken like those it looks and stands like,
and a number among order numbers is not. A candidate that meets its rule, but
lies in no base span (in a longer run of digits, say), is seen unmasked. How often
each feature pattern occurs, and how often in a base span, is counted over all
documents; boosted depth-two trees are fitted to those counts (a few thousand at
most), and a threshold per kind is calibrated for precision on the other half of
them. The patterns that pass are applied to every candidate by the same expression.
No text is shuffled: counting and selecting are two scans.

Patterns are written so that Java's matcher neither recurses with the length of a
run nor rescans it: separators inside digit runs and label dots are first turned
into private-use characters of the same length, and a match begins where a run
does or where the last match ended.

Defined cases: a null text counts as empty; equal spans of base and method appear
once; offsets are code points, end exclusive; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import crc_of_id
from tallywright.session import table

KINDS = ("email", "ip", "card", "phone")
JOINT, DOT, WAS = "\ue000", "\ue001", "\ue002"
LOCAL = "A-Za-z0-9._%+" + DOT + "-"
LABEL = "A-Za-z0-9-"

#: Of the text with joints marked: what `rules` of the module's contract say, run by run.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]++",
    "ip": rf"(?:(?<![0-9])|\G)[0-9]++[.{DOT}][0-9]++[.{DOT}][0-9]++[.{DOT}][0-9]++",
    "card": rf"[0-9][0-9{JOINT}]++",
    "phone": rf"\+[0-9][\x20().0-9{JOINT}{DOT}-]+[0-9]",
}
#: Wide nets, each bounded in length.
LOOSE = {
    "email": rf"[^\s@<>\"(),;:]{{1,64}}(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>\"(),;:]{{1,120}}",
    "ip": rf"[0-9]{{1,3}}[.{DOT}][0-9]{{1,3}}[.{DOT}][0-9]{{1,3}}[.{DOT}][0-9]{{1,3}}",
    "card": rf"[0-9]{{4}}{JOINT}?[0-9]{{4}}{JOINT}?[0-9]{{4}}{JOINT}?[0-9]{{4}}",
    "phone": rf"\+?[0-9]{{0,2}}[\x20{JOINT}]?\(?[0-9]{{3}}\)?[\x20.{JOINT}{DOT}-]?[0-9]{{3}}[\x20.{JOINT}{DOT}-][0-9]{{4}}",
}
#: Words that announce personal data.
CUES = r"(?i)(?:mail|e-mail|contact|write|call|tel|phone|fax|mobile|card|visa|pay|ip|host|address|from|to|by|at)[\s:=]*$"
FEATURES = 9
ROUNDS, RATE, PRECISION, LEAST = 24, 0.4, 0.9, 5


def with_joints(text: Column) -> Column:
    """As for cards; emails keep their hyphens, so they read a text in which only dots are marked."""
    return F.regexp_replace(F.translate(text, JOINT + DOT, WAS + WAS), r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)


def with_dots(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, JOINT + DOT, WAS + WAS), rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT)


def found(text: Column, pattern: str, kind: int) -> Column:
    """Matches as structs (kind, start, end, hit), offsets by adding up gaps and matches."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,hit:string>>")

    def add(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda s: s["out"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits pass the check: every second from the right doubled, their digits summed."""
    places = F.transform(F.split(F.reverse(d), ""), lambda c, i: c.try_cast("int") * (F.lit(1) + i % 2))
    total = F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    d = digits(hit)
    n = F.length(d)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":
        parts = F.transform(F.split(F.regexp_replace(hit, DOT, "."), r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return F.lit(True)


def passes(kind: str):
    return lambda span: valid(kind, span["hit"])


def coded(text: Column, kind: str, masked: bool):
    return lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), feature_code(text, s, kind, masked).alias("code"))


def meets_rule(kind: str, wanted: bool):
    """Whether a candidate's format alone does (or does not) pass what its base rule tests."""
    test = {
        "email": lambda s: s["hit"].rlike(rf"^[{LOCAL}]+@[{LABEL}]+[.{DOT}]"),
        "phone": lambda s: s["hit"].startswith("+") & valid("phone", s["hit"]),
    }.get(kind, lambda s: valid(kind, s["hit"]))
    return lambda s: F.coalesce(test(s), F.lit(False)) == F.lit(wanted)


def of_kind(i: int):
    return lambda s: s["kind"] == i


def views(text: Column) -> dict[str, Column]:
    """The text each kind is sought in, or null where it can hold none; offsets agree with the text's."""
    numeric = text.rlike("[0-9]")
    dotted, jointed = with_dots(text), with_joints(text)
    return {
        "email": F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), dotted),
        "ip": F.when(numeric & text.rlike(r"[0-9]\.[0-9]"), F.translate(text, JOINT + DOT, WAS + WAS)),
        "card": F.when(numeric & text.rlike(r"[0-9][\x20-]?[0-9]"), jointed),
        "phone": F.when(numeric, F.translate(text, JOINT + DOT, WAS + WAS)),
    }


NO_SPANS = "array<struct<kind:int,start:int,end:int,hit:string>>"


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    lists = []
    for i, (kind, view) in enumerate(views(text).items()):
        hits = F.filter(found(view, BASE[kind], i), passes(kind))
        lists.append(F.coalesce(hits, F.array().cast(NO_SPANS)))
    return F.concat(*lists)


def feature_code(text: Column, span: Column, kind: str, masked: bool) -> Column:
    """The candidate's yes/no features as one small integer; masked, those that its base rule tests are hidden."""
    hit = span["hit"]
    d = digits(hit)
    before, after = F.substring(text, span["start"], F.lit(1)), F.substring(text, span["end"] + 1, F.lit(1))
    ahead = F.substring(text, F.greatest(span["start"] - 19, F.lit(1)), F.least(span["start"], F.lit(20)))
    canonical = {
        "email": hit.rlike(rf"^[{LOCAL}]+(?:@|\x20?[\[(]at[\])]\x20?)[{LABEL}{DOT}.]+[.{DOT}][A-Za-z]{{2,6}}$"),
        "ip": ~hit.rlike(rf"(?:^|[.{DOT}])0[0-9]"),
        "card": F.length(d) == 16,
        "phone": F.length(d).between(10, 12),
    }[kind]
    hidden = [F.lit(True), F.lit(False)] if masked else [F.lit(False), hit.startswith("+")]
    tests = [
        *hidden,
        (span["start"] == 0) | before.rlike(r"^[\s(\[<\"':=,;]$"),
        (after == "") | after.rlike(r"^[\s)\]>\"':,;.!?]$"),
        hit.rlike(rf"[\x20().{JOINT}{DOT}-]"),
        d.rlike("^[3-6]"),
        canonical,
        ahead.rlike(CUES),
        d.rlike(r"^(?:0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$"),
    ]
    return sum((F.coalesce(t, F.lit(False)).cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(KINDS.index(kind) << FEATURES))


def candidates(text: Column, training: bool = False) -> Column:
    """Structs (kind, start, end, code) of everything the generators propose.

    A candidate that meets its rule is seen as it is, others with what the rule tests masked.
    For training every candidate is seen masked, and those that meet their rule a second time.
    """
    lists = []
    for i, (kind, view) in enumerate(views(text).items()):
        nets = F.coalesce(found(view, LOOSE[kind], i), F.array().cast(NO_SPANS))
        lists.append(F.transform(F.filter(nets, meets_rule(kind, True)), coded(text, kind, False)))
        lists.append(F.transform(nets if training else F.filter(nets, meets_rule(kind, False)), coded(text, kind, True)))
    return F.concat(*lists)


def within(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["kind"] == span["kind"]) & (b["start"] <= span["start"]) & (span["end"] <= b["end"]))


# ---- boosted trees over pattern counts ------------------------------------------------------------


def grow(rows: list[tuple[int, float, float]], depth: int = 2):
    """A regression tree on bits: rows are (code, gradient, hessian). A leaf is a float, a node (bit, no, yes)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    gain, bit = 0.0, None
    for b in range(FEATURES) if depth else ():
        gy, hy = sum(r[1] for r in rows if r[0] >> b & 1), sum(r[2] for r in rows if r[0] >> b & 1)
        better = gy * gy / (hy + 1) + (g - gy) ** 2 / (h - hy + 1) - g * g / (h + 1)
        if better > gain + 1e-9:
            gain, bit = better, b
    if bit is None:
        return RATE * g / (h + 1)
    return bit, grow([r for r in rows if not r[0] >> bit & 1], depth - 1), grow([r for r in rows if r[0] >> bit & 1], depth - 1)


def leaf(tree, code: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if code >> tree[0] & 1 else tree[1]
    return tree


def boost(counts: dict[int, tuple[float, float]]) -> tuple[float, list]:
    """Trees for log-odds from pattern -> (candidates, of them with a base span)."""
    n, y = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    start = math.log((y + 0.5) / (n - y + 0.5))
    trees: list = []
    for _ in range(ROUNDS):
        rows = []
        for code, (m, k) in counts.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, start + sum(leaf(t, code) for t in trees)))))
            rows.append((code, k - m * p, m * p * (1 - p)))
        trees.append(grow(rows))
    return start, trees


def accepted_codes(counts: list[tuple[int, int, int, int]]) -> list[int]:
    """Feature codes to redact, from (code, half, candidates, with base span): fit on half 0, calibrate on half 1."""
    out = []
    for kind in range(len(KINDS)):
        own = [(c & ((1 << FEATURES) - 1), half, n, k) for c, half, n, k in counts if c >> FEATURES == kind]
        fit = {}
        for code, half, n, k in own:
            if half == 0:
                fit[code] = (float(n), float(k))
        if not fit:
            continue
        start, trees = boost(fit)
        scores = {code: start + sum(leaf(t, code) for t in trees) for code, *_ in own}
        held = sorted(((scores[c], n, k) for c, half, n, k in own if half == 1), reverse=True)
        threshold, n_all, k_all = None, 0, 0
        for i, (s, n, k) in enumerate(held):
            n_all, k_all = n_all + n, k_all + k
            last_of_score = i + 1 == len(held) or held[i + 1][0] < s
            if last_of_score and n_all >= LEAST and k_all / n_all >= PRECISION:
                threshold = s
        if threshold is not None:
            out += [kind << FEATURES | c for c, s in scores.items() if s >= threshold]
    return sorted(set(out))


def fit(docs: DataFrame) -> list[int]:
    """Counts every candidate's pattern over all documents; the result has at most 2 * 4 * 2 ** FEATURES rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select((crc_of_id() % 2).cast("int").alias("half"), text.alias("text")).where(F.col("text").rlike("[0-9]|@|[(\\[]at[)\\]]"))
    rows = rows.select("half", base_spans(F.col("text")).alias("base"), candidates(F.col("text"), training=True).alias("nets"))
    one = F.explode(F.transform("nets", lambda s: F.struct(s["code"].alias("code"), within(s, F.col("base")).cast("int").alias("hit"))))
    flat = rows.select("half", one.alias("one")).select("half", "one.code", "one.hit")
    return accepted_codes([tuple(r) for r in flat.groupBy("code", "half").agg(F.count(F.lit(1)), F.sum("hit")).collect()])


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, codes: list[int], keep: list[str]) -> DataFrame:
    """`keep` columns with base (spans of the rules) and spans (those and what the trees add)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("base", base_spans(text))
    if not codes:
        return rows.withColumn("spans", F.col("base"))
    chosen = F.array(*[F.lit(c) for c in codes])
    added = F.filter(candidates(text), lambda s: F.array_contains(chosen, s["code"]) & ~within(s, F.col("base")))
    plain = F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("hit")))
    return rows.withColumn("spans", F.concat("base", plain))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detect(docs, fit(docs), ["doc_id"])
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def cut(state, s):
        fresh = s["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(state["out"]).alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced; n_chars follows the new text. Columns as they came."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = detect(docs, fit(docs.select("doc_id", "text")), columns)
    clean = F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    rows = rows.withColumn("clean", clean)
    return rows.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(changed, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
