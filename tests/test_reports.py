import json

import pytest
from pyspark.sql import functions as F

from tallywright.operators import collapse, reports
from tallywright.plans import study

from .test_collapse import ROWS, records


def test_campaign_reports(spark):
    r = records(spark, ROWS)
    c = collapse.collapse(r)
    gone = spark.createDataFrame([("pypi", "two")], "ecosystem string, package_name string")
    assert [x["members"] for x in reports.without_members(c, gone).collect()] == [["five", "six"]]
    assert {x["package_name"] for x in reports.displayed(c, r).collect()} == {"one", "six"}
    assert [x["flag"] for x in reports.member_flags(gone, c).collect()] == [True]
    assert tuple(reports.units_per_stratum(r, c).first()) == ("pypi", 7, 6, 4)
    cats = r.withColumn("categories", F.when(F.col("outcome"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    assert {x["category"]: x["n"] for x in reports.campaigns_per_category(c, cats).collect()} == {"a": 4, "b": 2}
    assert {x["reporters"]: x["n"] for x in reports.packages_per_reporter_set(r).collect()} == {"ghsa": 4, "ghsa+osv": 1, "osv": 1}
    assert [tuple(x) for x in reports.source_agreement(r).collect()] == [(True, False, 1)]
    assert {x["day"]: x["n"] for x in reports.per_day(r.withColumn("published_at", F.concat("published_at", F.lit("-03"))), "published_at", "2026-02-01").collect()} == {-1: 1, 2: 1}
    assert reports.top(c, F.desc("member_count"), 1, "_seq").first()["members"] == ["one", "two"]


def test_sheets(spark):
    schema = "row int, package string, verdict string, note string, adjudicated string, adjudication_note string"
    one = spark.createDataFrame([(1, "a", "REAL", "", "FALSE", "why"), (2, "b", "REAL", "", None, None), (3, "c", "FALSE", "sends hostname", None, None), (4, "d", "ABSENT", "", "ABSENT", "host fingerprint only")], schema)
    two = spark.createDataFrame([(1, "a", "REAL", "", None, None), (2, "b", "REAL", "", None, None), (3, "c", "REAL", "", None, None), (4, "d", "ABSENT", "", None, None)], schema)
    rows = reports.resolved(one, two)
    assert [(r["final"], r["resolution"]) for r in rows.orderBy("row").collect()] == [("FALSE", "adjudicated"), ("REAL", "consensus"), (None, "missing"), ("ABSENT", "adjudicated")]
    assert [r["row"] for r in reports.disagreements(rows).collect()] == [3]
    cats = rows.withColumn("categories", F.when(F.col("row") == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))))
    assert {r["category"]: (r["k"], r["n"], r["single_k"], r["single_n"]) for r in reports.precision_by_category(cats).collect()} == {"x": (1, 2, 1, 1), "y": (0, 1, 0, 0)}
    assert [(r["row"], r["kind"]) for r in reports.host_notes(rows).collect()] == [(4, "host fingerprint")]
    assert tuple(reports.misses_by_stratum(rows.withColumn("s", F.lit("e")), "s").first()) == ("e", 0, 1, 0, 4)
    decided = spark.createDataFrame([(4, "d", ["x"], True)], "row int, package string, categories array<string>, borderline boolean")
    assert sorted(tuple(r) for r in reports.confirmed_misses(decided, rows.where("row = 4"), ["x", "y"]).collect()) == [("x", 1, 0), ("y", 0, 0)]
    with pytest.raises(Exception, match="decisions"):
        reports.confirmed_misses(decided, rows.where("row = 3"), ["x"]).collect()


def test_units_and_spans(spark):
    u = reports.classified_units(spark.createDataFrame([("n", ["a-cli", "b-turbo", "c-cli"]), ("n", ["numpy"])], "eco string, names array<string>"))
    assert [(r["flagged"], r["pattern_type"], r["tokens"]) for r in u.collect()] == [(True, "both", ["cli", "turbo"]), (False, "none", [])]
    s = reports.unit_summary(u, "eco").first()
    assert (s["n"], s["flag_count"], s["both"], s["flag_rate"]) == (2, 1, 1, 0.5)
    r = spark.createDataFrame([("e", "p", "ghsa", "A", "s", "Reasons (based on the campaign): a backdoor"), ("e", "p", "ghsa", "A", "s", "Reasons (based on the campaign): a backdoor")], "ecosystem string, package_name string, source string, advisory_id string, summary string, description string")
    got = reports.row_spans(r, {"x": ["backdoor"]}).collect()
    assert [(g["span"], g["in_tag_list"], g["start"]) for g in got] == [("backdoor", True, 37)]


def test_study(spark, tmp_path):
    rows = []
    for i in range(60):
        text = f"{'a backdoor' if i % 3 else 'nothing much'} in package number {i} of {i * 7}\n## Source: {'amazon-inspector' if i % 4 else 'kam193'} ({'a' * 20})"
        rows.append({"advisory_id": f"A{i}", "source": "ghsa" if i % 5 else "osv", "package_name": f"p{i}{'-cli' if i % 2 else ''}", "ecosystem": "npm" if i % 7 < 3 else "pypi", "summary": "", "description": text, "published_at": "2026"})
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    from tallywright.sources import advisories as S

    out, table = study.run(S.jsonl(spark, str(tmp_path / "r.jsonl"), study.SCHEMA), merges=[{"id": "m", "ecosystem": "npm", "packages": ["p0", "p1-cli"], "reason": "r"}])
    assert out["n_records"] == out["n_campaigns"] == 60 and out["pooled"]["table"] == (20, 10, 20, 10) and out["sensitivity"]["with_merges"]["delta_campaigns"] == -1
    assert table.count() == 60 and out["sensitivity"]["exclude_no_text"]["delta_campaigns"] == 0 and len(out["signature_grid"]) == 6


def test_campaigns_are_made_once_for_what_remains(spark):
    """Members and what stays are read from campaigns that are computed once, not once for each."""
    made = spark.sparkContext.accumulator(0)

    def noted(x):
        made.add(1)
        return x

    rows = [("en", f"s{i}", i, False, i % 2 == 0, [f"p{i}", f"q{i}"]) for i in range(10)]
    frame = spark.createDataFrame(rows, "ecosystem string, signature string, _seq long, grammar_flag boolean, outcome boolean, members array<string>")
    made_here = frame.withColumn("signature", F.udf(noted, "string").asNondeterministic()("signature"))
    left = reports.without_members(made_here, spark.createDataFrame([("en", "q4"), ("de", "p6")], "ecosystem string, package_name string"))
    assert sorted(r["_seq"] for r in left.collect()) == [0, 2, 6, 8]
    assert made.value <= 10
