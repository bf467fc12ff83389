"""Registered queries of the library's own operators, with the SQL each is held against.

The driver's tables hold no advisories, so each operator gets a taxonomy, lexicon
or key that fits them: languages are strata, document sources report, flagged
words are outcomes. SQL keeps to what both engines read alike (ASCII classes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import advisories as A
from tallywright.functions import fixed, inference, names
from tallywright.operators import alike, collapse, labelling, leakage, reports, sampling, tables
from tallywright.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A taxonomy of what the documents do hold.
TAXONOMY = {"insult": [r"idiot\w*", r"\bmoron\w*", r"worthless"], "licence": [r"licen[cs]ed?", r"copyright\s+\d+"], "contact": [r"\w+@\w+\.\w+", r"\+1 \(\d{3}\)"]}
CUES, BREAKS = ["the", "and"], [r"[;.]"]
FLAG, OUTCOME = r"(^|[ .,])(an|thea|ouen)([ .,]|$)", r"(idiot|moron|worthless|clown|trash)"


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a study: flag, outcome, label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").rlike(FLAG).alias("flag"), F.col("text").rlike(OUTCOME).alias("outcome"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


MARKED = f"""m AS (SELECT d.doc_id, d.lang, d.source, regexp_matches(d.text, '{FLAG}') AS flag, regexp_matches(d.text, '{OUTCOME}') AS outcome, l.quality, l.toxic
  FROM documents d JOIN labels l USING (doc_id))"""
TABLES = """t AS (SELECT lang, count(*) FILTER (WHERE flag AND outcome) AS a, count(*) FILTER (WHERE flag AND NOT outcome) AS b,
  count(*) FILTER (WHERE NOT flag AND outcome) AS c, count(*) FILTER (WHERE NOT flag AND NOT outcome) AS d FROM m GROUP BY lang)"""


@register("stratified_cmh", f"""WITH {MARKED}, {TABLES}, u AS (SELECT a::DOUBLE a, b::DOUBLE b, c::DOUBLE c, d::DOUBLE d, (a + b + c + d)::DOUBLE n FROM t),
s AS (SELECT count(*) AS n_strata, sum(CASE WHEN n >= 2 THEN a * d / n END) AS r, sum(CASE WHEN n >= 2 THEN b * c / n END) AS s,
  sum(CASE WHEN n >= 2 THEN a - (a + b) * (a + c) / n END) AS e, sum(CASE WHEN n >= 2 THEN (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)) END) AS v FROM u)
SELECT n_strata, round(r / nullif(s, 0), 9) AS common_odds_ratio, round(e * e / nullif(v, 0), 9) AS chi2_statistic FROM s""")
def stratified_cmh(spark, sf_dir):
    t = tables.contingency(marked_documents(spark, sf_dir), F.col("flag"), F.col("outcome"), "lang")
    return tables.mantel_haenszel_sums(t).select("n_strata", F.round("common_odds_ratio", 9).alias("common_odds_ratio"), F.round("chi2_statistic", 9).alias("chi2_statistic"))


@register("contingency_by_stratum", f"""WITH {MARKED}, {TABLES} SELECT lang, a, b, c, d, a + b + c + d AS n,
  round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.0 END, 9) AS rate_flagged, round(CASE WHEN c + d > 0 THEN c / (c + d) ELSE 0.0 END, 9) AS rate_unflagged FROM t""")
def contingency_by_stratum(spark, sf_dir):
    t = tables.with_rates(tables.contingency(marked_documents(spark, sf_dir), F.col("flag"), F.col("outcome"), "lang"))
    return t.withColumns({c: F.round(c, 9) for c in ("rate_flagged", "rate_unflagged")})


@register("fisher_by_stratum", f"""WITH {MARKED}, {TABLES}, k AS (SELECT *, unnest(range(greatest(0, (a + c) - (c + d)), least(a + b, a + c) + 1)) AS x FROM t),
f AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS k0 FROM k),
p AS (SELECT *, k0 - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp, k0 - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own FROM f)
SELECT lang, round(any_value(a * d / nullif(b * c, 0)::DOUBLE), 9) AS odds_ratio, round(least(1.0, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END)), 7) AS p_value FROM p GROUP BY lang""")
def fisher_by_stratum(spark, sf_dir):
    t = tables.contingency(marked_documents(spark, sf_dir), F.col("flag"), F.col("outcome"), "lang")
    return tables.fisher(t, "lang").select("lang", F.round("odds_ratio", 9).alias("odds_ratio"), F.round("p_value", 7).alias("p_value"))


@register("rates_by_indicator", f"""WITH {MARKED}, i AS (SELECT 'is_good' AS indicator, quality = 1 AS value, flag, outcome FROM m UNION ALL SELECT 'is_english', lang = 'en', flag, outcome FROM m),
g AS (SELECT * FROM (VALUES ('is_good'), ('is_english')) a(indicator), (VALUES (true), (false)) b(value))
SELECT g.indicator, g.value, count(i.flag) AS n, count(*) FILTER (WHERE flag) AS n_flagged, count(*) FILTER (WHERE outcome) AS n_outcome,
  round(count(*) FILTER (WHERE flag) / nullif(count(i.flag), 0), 9) AS flag_rate, round(count(*) FILTER (WHERE outcome) / nullif(count(i.flag), 0), 9) AS outcome_rate
FROM g LEFT JOIN i ON i.indicator = g.indicator AND i.value = g.value GROUP BY g.indicator, g.value""")
def rates_by_indicator(spark, sf_dir):
    rows = marked_documents(spark, sf_dir).withColumns({"is_good": F.col("quality") == 1, "is_english": F.col("lang") == "en"})
    out = tables.rates_by_indicator(rows, ["is_good", "is_english"], "flag", "outcome")
    return out.withColumns({c: F.round(c, 9) for c in ("flag_rate", "outcome_rate")})


@register("wilson_by_source", f"""WITH {MARKED}, s AS (SELECT source, count(*) FILTER (WHERE outcome) AS k, count(*) AS n FROM m GROUP BY source), z AS (SELECT *, k / n AS p, {inference.Z95!r}::DOUBLE AS z FROM s)
SELECT source, k, n, round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS lo,
  round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS hi FROM z""")
def wilson_by_source(spark, sf_dir):
    s = marked_documents(spark, sf_dir).groupBy("source").agg(F.count_if("outcome").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = tables.wilson(F.col("k"), F.col("n"))
    return s.select("source", "k", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@register("annotator_agreement", f"""WITH {MARKED}, p AS (SELECT CASE toxic WHEN 1 THEN 'PRESENT' ELSE 'ABSENT' END AS x, CASE WHEN outcome THEN 'PRESENT' ELSE 'ABSENT' END AS y FROM m WHERE toxic IS NOT NULL),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS n_same FROM p), e AS (SELECT sum(a.k * b.k) AS s FROM (SELECT x, count(*) k FROM p GROUP BY x) a JOIN (SELECT y, count(*) k FROM p GROUP BY y) b ON a.x = b.y)
SELECT n, n_same, round(n_same / n, 9) AS agreement, round((n_same / n - s / (n * n)) / (1 - s / (n * n)), 9) AS kappa FROM c, e""")
def annotator_agreement(spark, sf_dir):
    named = lambda c: F.when(c, "PRESENT").otherwise("ABSENT")
    rows = marked_documents(spark, sf_dir).where("toxic is not null").select(named(F.col("toxic") == 1).alias("x"), named(F.col("outcome")).alias("y"))
    return tables.agreement(rows, "x", "y").select("n", "n_same", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@register("precision_and_misses", f"""WITH {MARKED} SELECT count(*) FILTER (WHERE outcome AND toxic = 1) AS k, count(*) FILTER (WHERE outcome AND toxic IS NOT NULL) AS n,
  count(*) FILTER (WHERE NOT outcome AND toxic = 1) AS missed, count(*) FILTER (WHERE NOT outcome AND toxic IS NOT NULL) AS n_negative FROM m""")
def precision_and_misses(spark, sf_dir):
    m = marked_documents(spark, sf_dir)
    found = tables.proportions(m.where("outcome").select(F.when(F.col("toxic") == 1, "REAL").when(F.col("toxic") == 0, "FALSE").alias("v")), "v", "REAL", "FALSE").select("k", "n")
    missed = tables.proportions(m.where("not outcome").select(F.when(F.col("toxic") == 1, "PRESENT").when(F.col("toxic") == 0, "ABSENT").alias("v")), "v", "PRESENT", "ABSENT").select(F.col("k").alias("missed"), F.col("n").alias("n_negative"))
    return found.crossJoin(missed)


_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0), 'n': length(h[i])}})) AS p, text "
    f"FROM (SELECT doc_id, text, regexp_extract_all(text, '(?i){p}') AS h, string_split_regex(text, '(?i){p}') AS g FROM documents)"
    for c, ps in TAXONOMY.items() for p in ps
)


@register("label_spans", f"""WITH h AS ({_HITS}), s AS (SELECT doc_id, category, p.s::INTEGER AS s, (p.s + p.n)::INTEGER AS e, text FROM h)
SELECT doc_id, category, s AS start_at, e AS end_at FROM s WHERE NOT CASE
  WHEN s > 40 THEN regexp_matches(substr(text, s - 40, 41), '(?is)\\A.(?:[^;.]*[;.])*[^;.]*?\\b(?:the|and)\\b[^;.]*\\z')
  ELSE regexp_matches(substr(text, 1, s), '(?is)\\A(?:[^;.]*[;.])*[^;.]*?\\b(?:the|and)\\b[^;.]*\\z') END""")
def label_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = labelling.matches(F.col("text"), TAXONOMY, True, labelling.ASCII, cues=CUES, breaks=BREAKS)
    return d.select("doc_id", F.explode(m).alias("m")).select("doc_id", "m.category", F.col("m.start").alias("start_at"), F.col("m.end").alias("end_at"))


_ANY = {c: "regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in ps) + "')" for c, ps in TAXONOMY.items()}


@register("label_flags", f"SELECT doc_id, {', '.join(f'{v} AS {c}' for c, v in _ANY.items())} FROM documents")
def label_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[v.alias(c) for c, v in labelling.flags(F.col("text"), TAXONOMY, labelling.ASCII).items()])


@register("label_summary", "WITH f AS (SELECT " + ", ".join(f"{v} AS {c}" for c, v in _ANY.items()) + " FROM documents), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category FROM f WHERE {c}" for c in _ANY) + f" UNION ALL SELECT '*' FROM f WHERE {' OR '.join(_ANY)}) SELECT category, count(*) AS n, (SELECT count(*) FROM documents) AS n_records, round(count(*) / (SELECT count(*) FROM documents), 9) AS rate FROM u GROUP BY category")
def label_summary(spark, sf_dir):
    d = labelling.labelled(table(spark, sf_dir, "documents").select("text"), "text", TAXONOMY, negation=False, mode=labelling.ASCII)
    return labelling.summary(d).withColumn("rate", F.round("rate", 9))


@register("negation_drops_by_cue", f"""WITH h AS ({_HITS}), s AS (SELECT p.s::INTEGER AS s, text FROM h), d AS (SELECT s, text FROM s WHERE CASE
  WHEN s > 40 THEN regexp_matches(substr(text, s - 40, 41), '(?is)\\A.(?:[^;.]*[;.])*[^;.]*?\\b(?:the|and)\\b[^;.]*\\z')
  ELSE regexp_matches(substr(text, 1, s), '(?is)\\A(?:[^;.]*[;.])*[^;.]*?\\b(?:the|and)\\b[^;.]*\\z') END)
SELECT regexp_extract_all(lower(substr(text, greatest(s - 39, 1), least(s, 40))), '\\b(?:the|and)\\b')[-1] AS cue, count(*) AS n FROM d GROUP BY cue""")
def negation_drops_by_cue(spark, sf_dir):
    return labelling.negation_drops(table(spark, sf_dir, "documents"), "text", TAXONOMY, labelling.ASCII, cues=CUES, breaks=BREAKS)


EARLIER_CUES = [*CUES, "of", "that"]


@register("negation_by_rule", f"""WITH h AS ({_HITS}), s AS (SELECT p.s::INTEGER AS s, text FROM h), d AS (SELECT s, text FROM s WHERE CASE
  WHEN s > 40 THEN regexp_matches(substr(text, s - 40, 41), '(?is)\\A.(?:[^;.]*[;.])*[^;.]*?\\b(?:the|and)\\b[^;.]*\\z')
  ELSE regexp_matches(substr(text, 1, s), '(?is)\\A(?:[^;.]*[;.])*[^;.]*?\\b(?:the|and)\\b[^;.]*\\z') END),
w AS (SELECT regexp_extract_all(lower(substr(text, greatest(s - 39, 1), least(s, 40))), '\\b(?:the|and|of|that)\\b')[1] AS cue FROM s WHERE s > 0)
SELECT 'now' AS rule, regexp_extract_all(lower(substr(text, greatest(s - 39, 1), least(s, 40))), '\\b(?:the|and)\\b')[-1] AS cue, count(*) AS n FROM d GROUP BY cue
UNION ALL SELECT 'before', cue, count(*) FROM w WHERE cue IS NOT NULL GROUP BY cue""")
def negation_by_rule(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return labelling.negation_drops_by_rule(d, "text", TAXONOMY, labelling.ASCII, CUES, EARLIER_CUES, breaks=BREAKS)


#: The default taxonomies' patterns and those that the documents are known to hold, searched by their literals.
EVERY = {**TAXONOMY, **fixed.MECHANISMS, **fixed.INSTRUCTIONS}


def _spans_sql(taxonomy: dict[str, list[str]]) -> str:
    """Places of all matches, by what stands between them."""
    one = lambda c, p: f"""SELECT doc_id, '{c}' AS category, '{p.replace("'", "''")}' AS pattern, regexp_extract_all(text, '(?i)(?:{p.replace("'", "''")})') AS h, string_split_regex(text, '(?i)(?:{p.replace("'", "''")})') AS g FROM documents"""
    return " UNION ALL ".join(one(c, p) for c, ps in taxonomy.items() for p in ps)


@register("literal_spans", f"""WITH f AS ({_spans_sql(EVERY)}), h AS (SELECT doc_id, category, pattern, unnest(list_transform(range(1, len(h) + 1), lambda i:
  {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0), 'n': length(h[i])}})) AS p FROM f WHERE len(h) > 0)
SELECT doc_id, category, pattern, p.s::INTEGER AS start_at, (p.s + p.n)::INTEGER AS end_at FROM h""")
def literal_spans(spark, sf_dir):
    d = labelling.labelled_by_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", EVERY, negation=False)
    return d.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.category", "m.pattern", F.col("m.start").alias("start_at"), F.col("m.end").alias("end_at"))


LEXICON = {"suffixes": ["widget", "bolt", "pin"], "prefixes": ["small", "large"], "trends": ["hot", "rapid"]}
_PARTS = "list_filter(string_split(replace(replace(replace(replace(lower(p_name), '@', ''), '/', '-'), ' ', '-'), '_', '-'), '-'), lambda x: x <> '')"
_MET = lambda k: f"len(list_filter({LEXICON[k]!r}, lambda t: list_contains(parts, t)))"


@register("name_grammar", f"""WITH p AS (SELECT p_partkey, {_PARTS} AS parts FROM part), n AS (SELECT p_partkey, {_MET('suffixes')} + {_MET('prefixes')} AS compound, {_MET('trends')} AS trend FROM p)
SELECT p_partkey, compound + trend > 0 AS is_flagged, CASE WHEN compound > 0 AND trend > 0 THEN 'both' WHEN trend > 0 THEN 'trend' WHEN compound > 0 THEN 'compound' ELSE 'none' END AS pattern_type FROM n""")
def name_grammar(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", names.grammar(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), **LEXICON).alias("g"))
    return p.select("p_partkey", "g.is_flagged", "g.pattern_type")


_AFFIXES = ["widget", "small", "hot", "bolt"]
_STEM = "low"
for _a in _AFFIXES:
    for _m in "-_.":
        _STEM = f"replace(replace({_STEM}, '{_m}{_a}', ''), '{_a}{_m}', '')"


@register("name_families", f"""WITH p AS (SELECT replace(lower(p_name), ' ', '-') AS low FROM part), s AS (SELECT low, trim({_STEM}, '-_.') AS stem FROM p)
SELECT CASE WHEN length(stem) < 4 THEN low ELSE stem END AS family, count(*) AS n FROM s GROUP BY family""")
def name_families(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(names.family(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), affixes=_AFFIXES).alias("family"))
    return p.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@register("edit_distances", "SELECT p_partkey, levenshtein(lower(p_name), lower(p_type))::INTEGER AS distance FROM part")
def edit_distances(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.edit_distance(F.lower("p_name"), F.lower("p_type")).alias("distance"))


_NEAR = f"""WITH b AS (SELECT DISTINCT n_name AS name, unnest(range(0, length(n_name) + 1)) AS i FROM nation), l AS (SELECT b.*, c FROM b, unnest(string_split('{names.ALPHABET}', '')) u(c)),
e AS (SELECT name, substr(name, 1, i) || c || substr(name, i + 2) AS candidate FROM l WHERE i < length(name)
  UNION SELECT name, substr(name, 1, i) || c || substr(name, i + 1) FROM l UNION SELECT name, substr(name, 1, i) || substr(name, i + 2) FROM b WHERE i < length(name)
  UNION SELECT name, substr(name, 1, i) || substr(name, i + 2, 1) || substr(name, i + 1, 1) || substr(name, i + 3) FROM b WHERE i < length(name) - 1)"""
_NEAR_WHERE = "FROM e WHERE levenshtein(name, candidate) BETWEEN 1 AND 2 AND length(candidate) BETWEEN 2 AND 60 AND candidate NOT IN (SELECT n_name FROM nation)"


@register("near_miss_names", f"{_NEAR} SELECT name, count(*) AS n_candidates {_NEAR_WHERE} GROUP BY name")
def near_miss_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return names.near_misses(n, "n_name", n, "n_name").groupBy("name").agg(F.count(F.lit(1)).alias("n_candidates"))


@register("near_miss_draws", f"{_NEAR}, t AS (SELECT name, candidate, row_number() OVER (PARTITION BY name ORDER BY md5('7:' || name || ':' || candidate), candidate) AS k {_NEAR_WHERE}) SELECT name, candidate FROM t WHERE k <= 3")
def near_miss_draws(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return names.drawn_near_misses(n, "n_name", n, "n_name", 3, seed=7)


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as advisory records; `_seq` is the id. A package has up to three records, a few have one in fifty."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    text = F.concat(F.lit("## Source: "), "source", F.lit(" ("), F.md5(k.cast("string")), F.lit(")\n"), F.when(k % 11 == 0, F.concat(F.lit("Campaign: C"), (k % 5).cast("string"), F.lit("\n"))).otherwise(""), F.col("text"))
    return d.select(
        k.alias("_seq"), F.concat(F.lit("A"), k.cast("string")).alias("advisory_id"), F.when(k % 3 == 0, "osv").otherwise("ghsa").alias("source"), F.concat(F.lit("p"), F.when(k % 50 == 0, k % 3).otherwise(F.floor(k / 3)).cast("string")).alias("package_name"), F.col("lang").alias("ecosystem"),
        F.concat_ws(" ", "lang", "source").alias("summary"), text.alias("description"), F.when(k % 7 != 0, F.format_string("2026-%02d-%02d", (k % 12 + 1), (k % 28 + 1))).alias("published_at"),
        F.col("text").rlike(FLAG).alias("grammar_flag"), F.col("text").rlike(OUTCOME).alias("outcome"), A.reporters(text).alias("reporters"),
    )


RECORDS = f"""r AS (SELECT doc_id AS seq, 'A' || doc_id AS advisory_id, CASE WHEN doc_id % 3 = 0 THEN 'osv' ELSE 'ghsa' END AS source, 'p' || CASE WHEN doc_id % 50 = 0 THEN doc_id % 3 ELSE doc_id // 3 END AS package_name, lang AS ecosystem,
  '## Source: ' || source || ' (' || md5(doc_id::VARCHAR) || ')' || chr(10) || CASE WHEN doc_id % 11 = 0 THEN 'Campaign: C' || (doc_id % 5) || chr(10) ELSE '' END || text AS description, source AS reporter,
  CASE WHEN doc_id % 7 <> 0 THEN printf('2026-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) END AS published_at, regexp_matches(text, '{FLAG}') AS grammar_flag, regexp_matches(text, '{OUTCOME}') AS outcome FROM documents)"""


@register("reporters", f"WITH {RECORDS} SELECT reporter, ecosystem, count(*) AS n FROM r GROUP BY reporter, ecosystem")
def reporters(spark, sf_dir):
    return advisories(spark, sf_dir).select(F.explode("reporters").alias("reporter"), "ecosystem").groupBy("reporter", "ecosystem").agg(F.count(F.lit(1)).alias("n"))


@register("dedup_exact", "WITH e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value <= 50), event_id) AS k, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seq FROM events) SELECT user_id, event_type, event_id, value, first_seq FROM e WHERE k = 1")
def dedup_exact(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("_seq"), F.when(F.col("value") > 50, "ghsa").otherwise("osv").alias("origin"))
    return collapse.dedup_exact(e, ["user_id", "event_type"], "origin").select("user_id", "event_type", "event_id", "value", F.col("_seq").alias("first_seq"))


@register("canonical_records", f"WITH {RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package_name ORDER BY source <> 'osv', published_at IS NULL, coalesce(published_at, ''), seq) AS k FROM r) SELECT ecosystem, package_name, advisory_id, source, outcome FROM k WHERE k = 1")
def canonical_records(spark, sf_dir):
    slim = advisories(spark, sf_dir).select("ecosystem", "package_name", "advisory_id", "source", "outcome", "published_at", "_seq")
    return collapse.canonical(slim, ["ecosystem", "package_name"], "osv").drop("published_at", "_seq")


@register("source_disagreement", f"""WITH {RECORDS}, g AS (SELECT ecosystem, package_name, outcome, row_number() OVER (PARTITION BY ecosystem, package_name ORDER BY published_at IS NULL, coalesce(published_at, ''), seq) AS k FROM r WHERE source = 'ghsa'),
o AS (SELECT DISTINCT ecosystem, package_name FROM r WHERE source = 'osv' AND outcome) SELECT g.ecosystem, g.package_name FROM g JOIN o USING (ecosystem, package_name) WHERE k = 1 AND NOT g.outcome""")
def source_disagreement(spark, sf_dir):
    return collapse.source_disagreement(advisories(spark, sf_dir), ["ecosystem", "package_name"], "outcome")


_PACKAGES = """p AS (SELECT ecosystem, package_name, min(seq) AS seq, count(*) AS n_records, bool_or(grammar_flag) AS grammar_flag, bool_or(outcome) AS outcome, arg_min(description, seq) AS text FROM r GROUP BY ecosystem, package_name),
k AS (SELECT *, regexp_extract(text, '(?m)^[ \\t]*Campaign:[ \\t]*(\\S+)', 1) AS tag, regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '(?m)^[ \\t]*## Source:.*(?:\\r?\\n|$)', '', 'g') AS bare FROM p),
c AS (SELECT ecosystem, CASE WHEN tag <> '' THEN '__campaign__:' || tag ELSE substr(trim(bare, ' ' || chr(10) || chr(9)), 1, 200) END AS signature, min(seq) AS first_seq, count(*) AS member_count, bool_or(grammar_flag) AS grammar_flag, bool_or(outcome) AS outcome,
  string_agg(package_name, ';' ORDER BY seq) AS members FROM k GROUP BY ALL)"""


@register("campaigns", f"WITH {RECORDS}, {_PACKAGES} SELECT ecosystem, CASE WHEN signature LIKE '\\_\\_campaign%' ESCAPE '\\' THEN 'campaign_tag' ELSE 'text_prefix' END AS signature_type, first_seq, member_count, members, grammar_flag, outcome FROM c")
def campaigns(spark, sf_dir):
    c = collapse.collapse(advisories(spark, sf_dir))
    return c.select("ecosystem", "signature_type", F.col("_seq").alias("first_seq"), "member_count", F.array_join("members", ";").alias("members"), "grammar_flag", "outcome")


MERGES = [{"id": "one", "ecosystem": "en", "packages": ["p1", "p2", "p5"], "reason": "same names"}, {"id": "two", "ecosystem": "en", "packages": ["p5", "p6"], "reason": "chained"}]


def _merged_sql() -> str:
    """Each merge as one more step over the campaigns before it."""
    steps, last = ["c0 AS (SELECT ecosystem, signature, first_seq, member_count, string_split(members, ';') AS members, outcome FROM c)"], "c0"
    for i, m in enumerate(MERGES, 1):
        group = f"CASE WHEN ecosystem = '{m['ecosystem']}' AND list_has_any(members, {m['packages']!r}) THEN '__merge__:{m['id']}' ELSE signature END"
        steps.append(f"c{i} AS (SELECT ecosystem, arg_min(signature, first_seq) AS signature, min(first_seq) AS first_seq, sum(member_count)::BIGINT AS member_count, flatten(list(members ORDER BY first_seq)) AS members, bool_or(outcome) AS outcome FROM {last} GROUP BY ecosystem, {group})")
        last = f"c{i}"
    return f"WITH {RECORDS}, {_PACKAGES}, {', '.join(steps)} SELECT ecosystem, first_seq, member_count, array_to_string(members, ';') AS members, outcome FROM {last}"


@register("merged_campaigns", _merged_sql())
def merged_campaigns(spark, sf_dir):
    return collapse.apply_merges(collapse.collapse(advisories(spark, sf_dir)), MERGES).select("ecosystem", F.col("_seq").alias("first_seq"), "member_count", F.array_join("members", ";").alias("members"), "outcome")


@register("campaign_sizes", f"WITH {RECORDS}, {_PACKAGES} SELECT ecosystem, member_count, count(*) AS n_groups FROM c GROUP BY ALL")
def campaign_sizes(spark, sf_dir):
    return tables.size_distribution(collapse.collapse(advisories(spark, sf_dir)), "member_count", "ecosystem")


@register("campaign_table", f"""WITH {RECORDS}, {_PACKAGES}, w AS (SELECT ecosystem, package_name, CASE WHEN tag <> '' THEN '__campaign__:' || tag ELSE substr(trim(bare, ' ' || chr(10) || chr(9)), 1, 200) END AS signature FROM k),
n AS (SELECT w.ecosystem, w.signature, count(DISTINCT r.reporter)::INTEGER AS n_reporters FROM w JOIN r ON r.ecosystem = w.ecosystem AND r.package_name = w.package_name GROUP BY ALL)
SELECT 'C' || CASE WHEN row_number() OVER (ORDER BY first_seq) < 1000 THEN printf('%03d', row_number() OVER (ORDER BY first_seq)) ELSE (row_number() OVER (ORDER BY first_seq))::VARCHAR END AS campaign_id, c.ecosystem,
  CASE WHEN c.signature LIKE '\\_\\_campaign%' ESCAPE '\\' THEN 'campaign_tag' ELSE 'text_prefix' END AS signature_type, member_count AS n_members, members, grammar_flag::INTEGER AS grammar_flag, outcome::INTEGER AS dv, n_reporters, 0 AS has_kam193, 0 AS has_amazon_inspector, 0 AS has_boilerplate
FROM c JOIN n ON n.ecosystem = c.ecosystem AND n.signature = c.signature""")
def campaign_table(spark, sf_dir):
    return collapse.campaign_table(collapse.collapse(advisories(spark, sf_dir)))


@register("coarser_signatures", f"""WITH {RECORDS}, {_PACKAGES}, f AS (SELECT ecosystem || '|' || package_name AS member, ecosystem || '|' || CASE WHEN tag <> '' THEN '__campaign__:' || tag ELSE substr(trim(bare, ' ' || chr(10) || chr(9)), 1, 200) END AS fine, ecosystem || '|' || substr(trim(bare, ' ' || chr(10) || chr(9)), 1, 60) AS coarse FROM k)
SELECT coarse AS coarse_group, count(DISTINCT fine) AS n_fine FROM f GROUP BY coarse HAVING count(DISTINCT fine) >= 2""")
def coarser_signatures(spark, sf_dir):
    p = collapse.by_package(advisories(spark, sf_dir))
    member = F.concat_ws("|", "ecosystem", "package_name").alias("member")
    fine = p.select(member, F.concat_ws("|", "ecosystem", A.signature(F.col("text"), F.col("package_name"))).alias("grp"))
    coarse = p.select(member, F.concat_ws("|", "ecosystem", A.signature(F.col("text"), F.col("package_name"), length=60, use_tag=False, generic_apart=False)).alias("grp"))
    return collapse.merges_of(fine, coarse, "member", "grp")


@register("prefix_pairs", """WITH h AS (SELECT lang, substr(text, 1, 60) AS prefix, substr(text, 1, 200) AS head, min(doc_id) AS seq, count(*) AS n FROM documents WHERE length(text) >= 60 GROUP BY ALL)
SELECT a.lang AS ecosystem, a.seq AS first_seq, b.seq AS second_seq, a.n * b.n AS n_pairs FROM h a JOIN h b ON a.lang = b.lang AND a.prefix = b.prefix AND a.seq < b.seq""")
def prefix_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("ecosystem"), "text", F.col("doc_id").alias("_seq"))
    return collapse.prefix_pairs(d, "text", equal=60).drop("diverge_at")


@register("prefix_heads", """WITH t AS (SELECT lang, substr(text, 1, 60) AS prefix, substr(text, 1, 200) AS head, min(doc_id) AS seq, count(*) AS n FROM documents WHERE length(text) >= 60 GROUP BY ALL),
g AS (SELECT *, min(seq) OVER p AS group_seq, count(*) OVER p AS n_heads, sum(n) OVER p AS n_texts, lag(head) OVER o AS before, lead(head) OVER o AS after, lag(seq) OVER o AS before_seq
  FROM t WINDOW p AS (PARTITION BY lang, prefix), o AS (PARTITION BY lang, prefix ORDER BY head)),
d AS (SELECT *, len(list_filter(range(1, 201), lambda i: i <= length(before) AND substr(before, 1, i) = substr(head, 1, i))) AS b, len(list_filter(range(1, 201), lambda i: i <= length(after) AND i <= length(head) AND substr(after, 1, i) = substr(head, 1, i))) AS a FROM g WHERE n_heads > 1)
SELECT lang, group_seq, seq, n, n_heads, (n * (n_texts - n))::BIGINT AS n_pairs, before_seq, CASE WHEN before_seq IS NOT NULL THEN least(b, length(head)) END::INT AS before_at,
  greatest(CASE WHEN before IS NOT NULL THEN least(b, length(head)) END, CASE WHEN after IS NOT NULL THEN a END)::INT AS diverge_at FROM d""")
def prefix_heads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "text", F.col("doc_id").alias("_seq"))
    return alike.prefix_heads(d, "text", "lang", equal=60)


@register("least_alike_members", """WITH m AS (SELECT conv_id, text, min(turn) AS seq FROM conversations WHERE role = 'user' GROUP BY conv_id, text), t AS (SELECT conv_id, seq, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS tokens FROM m),
p AS (SELECT a.conv_id, a.seq AS first_seq, b.seq AS second_seq, CASE WHEN len(list_distinct(list_concat(a.tokens, b.tokens))) = 0 THEN 1.0 ELSE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) END AS similarity FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.seq < b.seq)
SELECT conv_id, round(min(similarity), 9) AS similarity, count(*) FILTER (WHERE similarity < 0.5) AS n_low FROM p GROUP BY conv_id HAVING min(similarity) < 0.5""")
def least_alike_members(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id", "text").agg(F.min("turn").alias("_seq"))
    plain = m.select("conv_id", "_seq", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), " ").alias("words"))
    return alike.least_alike(plain, "conv_id", "words").select("conv_id", F.round("similarity", 9).alias("similarity"), "n_low")


_SIZES = "s AS (SELECT lang AS stratum, count(*) AS size FROM documents GROUP BY lang), q AS (SELECT *, 60 * size / sum(size) OVER () AS quota FROM s), w AS (SELECT *, floor(quota) AS whole, quota - floor(quota) AS rest FROM q)"


@register("sample_allocation", f"WITH {_SIZES} SELECT stratum, size, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 60 - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS allotted FROM w")
def sample_allocation(spark, sf_dir):
    return sampling.allocate(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 60)


@register("stratified_sample", f"""WITH {_SIZES}, n AS (SELECT stratum, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 60 - sum(whole) OVER () THEN 1 ELSE 0 END AS allotted FROM w),
t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5('20260927:' || doc_id), 1, 15))::BIGINT, doc_id) AS k FROM documents) SELECT doc_id, lang FROM t JOIN n ON n.stratum = t.lang WHERE k <= allotted""")
def stratified_sample(spark, sf_dir):
    return sampling.draw(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 60)


@register("leakage_shared_ids", "WITH s AS (SELECT md5(text) AS k, doc_id % 5 = 0 AS held FROM documents) SELECT 'duplicate_leakage' AS check_name, CASE WHEN count(*) > 0 THEN 'severe' ELSE 'none' END AS severity, count(*) AS n_violations FROM (SELECT k FROM s GROUP BY k HAVING bool_or(held) AND bool_or(NOT held))")
def leakage_shared_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), (F.col("doc_id") % 5 == 0).alias("held"))
    return leakage.shared_ids(d.where("not held"), d.where("held"), "k", details=False)


@register("leakage_families", f"WITH p AS (SELECT replace(lower(p_name), ' ', '-') AS low, p_partkey % 5 = 0 AS held FROM part), s AS (SELECT held, low, trim({_STEM}, '-_.') AS stem FROM p), f AS (SELECT held, CASE WHEN length(stem) < 4 THEN low ELSE stem END AS k FROM s) SELECT 'name_family_leakage' AS check_name, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'none' END AS severity, count(*) AS n_violations FROM (SELECT k FROM f GROUP BY k HAVING bool_or(held) AND bool_or(NOT held))")
def leakage_families(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("n"), (F.col("p_partkey") % 5 == 0).alias("held"))
    return leakage.shared_families(p.where("not held"), p.where("held"), "n", details=False, affixes=_AFFIXES)


@register("leakage_late_features", "SELECT 'temporal_leakage' AS check_name, CASE WHEN count(*) > 0 THEN 'severe' ELSE 'none' END AS severity, count(*) AS n_violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate")
def leakage_late_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return leakage.late_features(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "l_orderkey", "o_orderdate", ["l_shipdate"], details=False)


@register("leakage_label_correlation", f"WITH {MARKED}, c AS (SELECT abs(corr(toxic::DOUBLE, outcome::INT::DOUBLE)) AS r1, abs(corr(quality::DOUBLE, outcome::INT::DOUBLE)) AS r2, abs(corr((toxic * 2 + 1)::DOUBLE, toxic::DOUBLE)) AS r3 FROM m) SELECT 'label_leakage_correlation' AS check_name, CASE WHEN r3 >= 0.9 THEN 'warning' ELSE 'none' END AS severity, ((r3 >= 0.9)::INT + 0)::BIGINT AS n_violations FROM c")
def leakage_label_correlation(spark, sf_dir):
    m = marked_documents(spark, sf_dir).withColumn("shifted", F.col("toxic") * 2 + 1)
    return leakage.label_correlation(m, ["quality", "shifted"], "toxic").drop("details")


@register("leakage_late_documents", "SELECT 'documentation_version_leakage' AS check_name, CASE WHEN count(*) > 0 THEN 'severe' ELSE 'none' END AS severity, count(*) AS n_violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def leakage_late_documents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return leakage.late_documents(li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), "l_orderkey", "o_orderdate", "l_shipdate", details=False)


@register("records_by_month", f"WITH {RECORDS} SELECT substr(coalesce(published_at, ''), 1, 7) AS month, source, count(*) AS n FROM r GROUP BY ALL")
def records_by_month(spark, sf_dir):
    return reports.per_month(advisories(spark, sf_dir), "published_at", "source").withColumn("month", F.coalesce("month", F.lit("")))


@register("records_by_day", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-01' THEN -1 ELSE date_diff('day', TIMESTAMP '2024-01-01', ts) END::INTEGER AS day, count(*) AS n FROM events GROUP BY day")
def records_by_day(spark, sf_dir):
    return reports.per_day(table(spark, sf_dir, "events"), "ts", "2024-01-01")


@register("top_tokens", f"WITH p AS (SELECT {_PARTS} AS parts FROM part), t AS (SELECT unnest(parts) AS token FROM p) SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 15")
def top_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.explode(names.parts(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))).alias("token"))
    return reports.top(p.groupBy("token").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), 15, "token")


@register("reporter_combinations", f"WITH {RECORDS}, s AS (SELECT ecosystem, package_name, string_agg(DISTINCT reporter, '+' ORDER BY reporter) AS reporters FROM r GROUP BY ALL) SELECT reporters, count(*) AS n FROM s GROUP BY reporters")
def reporter_combinations(spark, sf_dir):
    return reports.packages_per_reporter_set(advisories(spark, sf_dir))


@register("rank_sum", f"WITH {MARKED}, v AS (SELECT flag, toxic + quality AS x FROM m WHERE toxic IS NOT NULL), c AS (SELECT x, count(*) FILTER (WHERE flag) AS k1, count(*) AS k FROM v GROUP BY x), r AS (SELECT *, coalesce(sum(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS rank FROM c) SELECT sum(k1)::BIGINT AS n1, (sum(k) - sum(k1))::BIGINT AS n2, (sum(k1 * rank) - sum(k1) * (sum(k1) + 1) / 2)::DOUBLE AS u FROM r")
def rank_sum(spark, sf_dir):
    m = marked_documents(spark, sf_dir).where("toxic is not null").withColumn("x", F.col("toxic") + F.col("quality"))
    return tables.rank_sum(m, F.col("flag"), "x").select("n1", "n2", F.col("u").cast("double").alias("u"))


@register("corrected_rows", f"WITH {MARKED} SELECT flag, count(*) FILTER (WHERE outcome) AS positives, count(*) FILTER (WHERE NOT outcome) AS negatives, round(count(*) FILTER (WHERE outcome) * 0.9 + count(*) FILTER (WHERE NOT outcome) * 0.1, 9)::DOUBLE AS true_positives FROM m GROUP BY flag")
def corrected_rows(spark, sf_dir):
    a, b, c, d = tables.collected(tables.contingency(marked_documents(spark, sf_dir), F.col("flag"), F.col("outcome")))[()]
    (yes, _), (no, _) = inference.corrected_table([(a, b), (c, d)], 0.9, 0.1)
    return spark.createDataFrame([(True, a, b, round(yes, 9)), (False, c, d, round(no, 9))], "flag boolean, positives long, negatives long, true_positives double").where("positives + negatives > 0")


@register("unfinished_items", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unfinished_items(spark, sf_dir):
    from tallywright.sources import sinks

    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("completed").alias("status"))
    return sinks.not_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@register("categories_per_unit", "WITH f AS (SELECT lang, source, " + ", ".join(f"bool_or({v}) AS {c}" for c, v in _ANY.items()) + " FROM documents GROUP BY lang, source), u AS (" + " UNION ALL ".join(f"SELECT lang, '{c}' AS category FROM f WHERE {c}" for c in _ANY) + ") SELECT lang, category, count(*) AS n_units FROM u GROUP BY ALL")
def categories_per_unit(spark, sf_dir):
    marks = labelling.flags(F.col("text"), TAXONOMY, labelling.ASCII)
    found = F.array_compact(F.array(*[F.when(v, F.lit(c)) for c, v in marks.items()]))
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("ecosystem"), F.col("source").alias("package_name"), found.alias("categories"), "doc_id")
    units = d.groupBy("ecosystem", "package_name").agg(F.min("doc_id").alias("_seq"), F.bool_or(F.size("categories") > 0).alias("outcome"))
    units = units.select("ecosystem", F.col("package_name").alias("signature"), "_seq", F.array("package_name").alias("members"), F.lit(False).alias("grammar_flag"), "outcome")
    return reports.campaigns_per_category(units, d).select(F.col("ecosystem").alias("lang"), "category", F.col("n").alias("n_units"))


@register("token_reporters", f"WITH {RECORDS}, p AS (SELECT ecosystem, package_name, count(DISTINCT reporter) AS k FROM r GROUP BY ALL) SELECT ecosystem, CASE WHEN k >= 2 THEN '2+' ELSE k::VARCHAR END AS stratum, count(*) AS n FROM p GROUP BY ALL")
def token_reporters(spark, sf_dir):
    p = collapse.by_package(advisories(spark, sf_dir)).select("ecosystem", A.reporter_stratum(A.n_reporters(F.col("reporters"))).alias("stratum"))
    return p.groupBy("ecosystem", "stratum").agg(F.count(F.lit(1)).alias("n"))


def _one_row(spark: SparkSession, values: dict) -> DataFrame:
    flat = [(k, float(v)) for k, v in values.items()]
    return spark.createDataFrame(flat, "name string, value double")


#: A logit by recursion over covariate patterns: one coordinate's Newton step at a time, 400 times round.
@register("logit_and_vif", f"""WITH RECURSIVE {MARKED},
r AS (SELECT flag::INT AS x, quality, lang, toxic FROM m WHERE toxic IS NOT NULL AND quality IS NOT NULL),
levels AS (SELECT list_sort(list(DISTINCT lang)) AS l FROM r),
p AS (SELECT list_concat([1.0, x, quality]::DOUBLE[], list_transform(l[2:], lambda v: (v = lang)::DOUBLE)) AS v, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS y FROM r, levels GROUP BY ALL),
k AS (SELECT list({{'v': v, 'n': n, 'y': y}}) AS p, max(len(v)) AS k FROM p),
fit AS (
  SELECT 0 AS step, list_transform(range(0, k), lambda i: 0.0::DOUBLE) AS b FROM k
  UNION ALL
  SELECT step + 1, list_transform(range(1, k + 1), lambda i: b[i] + CASE WHEN i = step % k + 1 THEN
      list_sum(list_transform(p, lambda q: q.v[i] * (q.y - q.n / (1 + exp(-list_dot_product(b, q.v)))))) /
      list_sum(list_transform(p, lambda q: q.v[i] * q.v[i] * q.n / (1 + exp(-list_dot_product(b, q.v))) / (1 + exp(list_dot_product(b, q.v))))) ELSE 0 END)
  FROM fit, k WHERE step < 400 * k),
last AS (SELECT b FROM fit ORDER BY step DESC LIMIT 1),
ll AS (SELECT list_sum(list_transform(p, lambda q: -q.y * ln(1 + exp(-list_dot_product(b, q.v))) - (q.n - q.y) * ln(1 + exp(list_dot_product(b, q.v))))) AS ll FROM last, k),
base AS (SELECT sum(toxic) * ln(avg(toxic)) + (count(*) - sum(toxic)) * ln(1 - avg(toxic)) AS null_ll, 1 / (1 - corr(x, quality) ** 2) AS vif FROM r),
named AS (SELECT list_concat(['odds_ratio:intercept', 'odds_ratio:x', 'odds_ratio:quality'], list_transform(l[2:], lambda v: 'odds_ratio:lang=' || v)) AS names FROM levels)
SELECT unnest(list_concat(names, ['pseudo_r2', 'vif:x', 'vif:quality'])) AS name, round(unnest(list_concat(list_transform(b, lambda x: exp(x)), [1 - ll / null_ll, vif, vif])), 8) AS value FROM last, ll, base, named""")
def logit_and_vif(spark, sf_dir):
    m = marked_documents(spark, sf_dir).where("toxic is not null").withColumn("x", F.col("flag").cast("int"))
    fit = tables.logit(m, "toxic", ["x", "quality"], "lang")
    vif = tables.variance_inflation(m, ["x", "quality"])
    found = {**{f"odds_ratio:{k}": v["odds_ratio"] for k, v in fit["terms"].items()}, "pseudo_r2": fit["pseudo_r2"], **{f"vif:{k}": v for k, v in vif.items()}}
    return _one_row(spark, {k: round(v, 8) for k, v in found.items()})


_TABLE = f"{MARKED}, t AS (SELECT count(*) FILTER (WHERE flag AND outcome) AS a, count(*) FILTER (WHERE flag AND NOT outcome) AS b, count(*) FILTER (WHERE NOT flag AND outcome) AS c, count(*) FILTER (WHERE NOT flag AND NOT outcome) AS d FROM m)"


@register("power_grid", f"""WITH {_TABLE}, r AS (SELECT unnest([0.5, 0.67, 1.5, 2.0, 3.0])::DOUBLE AS ratio), x AS (
  SELECT ratio, sqrt((a + b + c + d) * (c / (c + d)) * (d / (c + d)) * ((a + b) / (a + b + c + d)) * ((c + d) / (a + b + c + d))) * abs(ln(ratio)) - 1.9599639845400545 AS x FROM t, r)
SELECT 'power:' || ratio AS name, round(0.5 + sign(x) * exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs(x)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))), 12) AS value FROM x""")
def power_grid(spark, sf_dir):
    t = tables.contingency(marked_documents(spark, sf_dir), F.col("flag"), F.col("outcome"))
    return tables.power_grid(t).where("power is not null").select(F.concat(F.lit("power:"), F.col("ratio").cast("string")).alias("name"), F.round("power", 12).alias("value"))


def _uniform_sql(stream: str, number: str) -> str:
    return f"((('0x' || substr(md5('20261006:' || k || ':{stream}:' || {number}), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0)"


def _normal_sql(stream: str) -> str:
    return f"(sqrt(-2 * ln({_uniform_sql(stream, '(-1)')})) * cos(2 * pi() * {_uniform_sql(stream, '(-2)')}))"


def _gamma_sql(stream: str, n: int) -> str:
    return f"({_normal_sql(stream)} ** 2 / 2 + list_sum(list_transform(range(1, {n + 1}), lambda j: -ln({_uniform_sql(stream, 'j')}))))"


@register("uncertain_correction", f"""WITH {_TABLE}, g AS (SELECT k, {_gamma_sql('ppv+', 55)} AS p1, {_gamma_sql('ppv-', 5)} AS p2, {_gamma_sql('miss+', 17)} AS m1, {_gamma_sql('miss-', 23)} AS m2, {_normal_sql('error')} AS z FROM range(20000) r(k)),
w AS (SELECT z, a * p1 / (p1 + p2) + b * m1 / (m1 + m2) AS w, c * p1 / (p1 + p2) + d * m1 / (m1 + m2) AS y, a, b, c, d FROM g, t), x AS (SELECT z, w, y, a + b - w AS x, c + d - y AS v FROM w),
o AS (SELECT exp(ln(w * v / (x * y)) + z * sqrt(1 / w + 1 / x + 1 / y + 1 / v)) AS o FROM x WHERE least(w, x, y, v) > 0)
SELECT unnest(['median_or', 'lo', 'hi']) AS name, round(unnest([quantile_cont(o, 0.5), quantile_cont(o, 0.025), quantile_cont(o, 0.975)]), 9) AS value FROM o""")
def uncertain_correction(spark, sf_dir):
    t = tables.contingency(marked_documents(spark, sf_dir), F.col("flag"), F.col("outcome"))
    found = tables.drawn_interval(tables.corrected_draws(t, (55, 60), (17, 40)))
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(c, 9).alias("value")) for c in ("median_or", "lo", "hi")])).alias("x")).select("x.name", "x.value")


@register("squatted_names", """WITH n AS (SELECT DISTINCT c_name AS name, c_mktsegment = 'BUILDING' AS known FROM customer),
k AS (SELECT DISTINCT name, known, unnest(list_append(list_transform(range(1, length(name) + 1), lambda i: substr(name, 1, i - 1) || substr(name, i + 1)), name)) AS key FROM n)
SELECT DISTINCT a.name, b.name AS near FROM k a JOIN k b USING (key) WHERE NOT a.known AND b.known AND damerau_levenshtein(a.name, b.name) = 1""")
def squatted_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return names.squats(c.where("c_mktsegment <> 'BUILDING'"), "c_name", c.where("c_mktsegment = 'BUILDING'"), "c_name")


