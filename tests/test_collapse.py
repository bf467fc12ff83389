import json

import pytest
from pyspark.sql import functions as F

from tallywright.operators import alike, collapse
from tallywright.sources import advisories as S
from tallywright.sources import sinks
from tallywright.streaming import ingest

RECORD = "_seq long, advisory_id string, source string, package_name string, ecosystem string, summary string, description string, published_at string, grammar_flag boolean, outcome boolean, reporters array<string>"


def records(spark, rows):
    full = [(i, f"A{i}", s, p, "pypi", "", d, at, g, o, [s]) for i, (p, s, d, at, g, o) in enumerate(rows)]
    return spark.createDataFrame(full, RECORD)


def test_exact_dedup_prefers_a_source_in_the_first_place(spark):
    df = spark.createDataFrame([(0, "k", "osv", "x"), (1, "j", "osv", "y"), (2, "k", "ghsa", "z"), (3, "k", "ghsa", "late")], "_seq long, key string, source string, v string")
    got = [tuple(r) for r in collapse.dedup_exact(df, ["key"]).orderBy("_seq").select("key", "_seq", "v").collect()]
    assert got == [("k", 0, "z"), ("j", 1, "y")]


def test_canonical(spark):
    df = records(spark, [("p", "ghsa", "late", "2026-02", False, False), ("p", "ghsa", "early", "2026-01", False, False), ("p", "ghsa", "none", None, False, False), ("p", "osv", "o", None, False, True), ("q", "osv", "only", None, False, True)])
    get = lambda prefer: {r["package_name"]: r["description"] for r in collapse.canonical(df, ["ecosystem", "package_name"], prefer).collect()}
    assert get("ghsa") == {"p": "early", "q": "only"} and get("osv") == {"p": "o", "q": "only"}
    assert [r["package_name"] for r in collapse.source_disagreement(df, ["ecosystem", "package_name"], "outcome").collect()] == ["p"]
    with pytest.raises(ValueError):
        collapse.canonical(df, ["package_name"], "any")
    with pytest.raises(Exception, match="known source"):
        collapse.canonical(df.withColumn("source", F.lit("x")), ["package_name"], "osv").collect()


ROWS = [
    ("one", "ghsa", "one steals keys from disks", "2026-01", False, True), ("one", "osv", "other words", "2026-02", True, False), ("two", "ghsa", "two steals keys from disks", None, False, False),
    ("three", "ghsa", "should be considered fully compromised", None, False, False), ("four", "ghsa", "should be considered fully compromised", None, False, False), ("five", "ghsa", "Campaign: x1\nsome text", None, False, False), ("six", "osv", "more\nCampaign: x1", None, False, True),
]


def test_two_stages_and_table(spark):
    c = collapse.collapse(records(spark, ROWS)).orderBy("_seq").collect()
    assert [(r["members"], r["grammar_flag"], r["outcome"], r["signature_type"]) for r in c] == [(["one", "two"], True, True, "text_prefix"), (["three"], False, False, "own_package"), (["four"], False, False, "own_package"), (["five", "six"], False, True, "campaign_tag")]
    assert c[0]["reporters"] == ["ghsa", "osv"]
    table = collapse.campaign_table(collapse.collapse(records(spark, ROWS))).orderBy("campaign_id").collect()
    assert [(r["campaign_id"], r["members"], r["dv"]) for r in table] == [("C001", "one;two", 1), ("C002", "three", 0), ("C003", "four", 0), ("C004", "five;six", 1)]


def test_whose_text_decides(spark):
    get = lambda **k: {r["package_name"]: (r["grammar_flag"], r["outcome"], r["group_advisory_id"]) for r in collapse.by_package(records(spark, ROWS), **k).collect()}
    assert get()["one"] == (True, True, "A0") and get(text_source="osv")["one"] == (True, False, "A0") and get(text_source="ghsa", group_on="osv")["one"] == (False, True, "A1")
    with pytest.raises(ValueError):
        get(text_source="nvd")


def test_merges_chain(spark):
    merges = [{"id": "m", "ecosystem": "pypi", "packages": ["one", "three", "gone"], "reason": "r"}, {"id": "n", "ecosystem": "pypi", "packages": ["three", "four"], "reason": "r"}]
    got = collapse.apply_merges(collapse.collapse(records(spark, ROWS)), merges).orderBy("_seq").collect()
    assert [r["members"] for r in got] == [["one", "two", "three", "four"], ["five", "six"]]
    with pytest.raises(ValueError):
        collapse.apply_merges(collapse.collapse(records(spark, ROWS)), [{"id": "m"}])


def test_audits(spark):
    df = spark.createDataFrame([(0, "e", "a" * 120 + "x"), (1, "e", "a" * 120 + "y"), (2, "e", "a" * 120 + "y"), (3, "f", "a" * 120 + "z"), (4, "e", "short")], "_seq long, ecosystem string, text string")
    assert [tuple(r) for r in collapse.prefix_pairs(df, "text").collect()] == [("e", 0, 1, 2, 120)]
    m = spark.createDataFrame([(0, "g", "a b c"), (1, "g", "a b d"), (2, "g", "x y z"), (3, "h", "same"), (4, "h", "same")], "_seq long, g string, t string")
    assert [tuple(r) for r in alike.least_alike(m, "g", "t").collect()] == [("g", 0.0, 0, 2, 2)]


def rows_of(df):
    return [r.asDict(True) for r in df.collect()]


def test_connectors(spark):
    page = [
        {"ghsa_id": "G1", "summary": "s", "description": "d", "published_at": "2026", "severity": "high", "references": ["u1", " ", {"url": "u2"}], "vulnerabilities": [{"package": {"name": "a", "ecosystem": "pip"}}, {"package": {"name": "", "ecosystem": "npm"}}, {"package": {"name": "b", "ecosystem": "npm"}}]},
        {"ghsa_id": "G2", "summary": None, "description": "d", "references": [], "vulnerabilities": []},
    ]
    got = rows_of(S.ghsa_records(spark.createDataFrame([(json.dumps(page),)], "value string")))
    assert [(r["advisory_id"], r["package_name"], r["ecosystem"], r["reference_urls"]) for r in got] == [("G1", "a", "pypi", ["u1", "u2"]), ("G1", "b", "npm", ["u1", "u2"])] and sorted(got[0]) == sorted(S.RECORD)
    osv = {"vulns": [{"id": "M1", "details": "t", "published": "p", "severity": [{"type": "x", "score": "9.8"}], "references": [{"url": "u"}]}, {"id": "M2"}]}
    got = rows_of(S.osv_records(spark.createDataFrame([("a", "npm", json.dumps(osv))], "package_name string, ecosystem string, value string")))
    assert [(r["advisory_id"], r["severity"], r["description"], r["reference_urls"]) for r in got] == [("M1", "9.8", "t", ["u"]), ("M2", "", "", [])]
    pypi = {"info": {"version": "2", "summary": "s", "description": "x" * 30_000, "author": "me", "project_urls": {"Home": "https://github.com/x"}}, "releases": {"1": [{"upload_time_iso_8601": "2026-02"}, {"upload_time_iso_8601": "2026-01"}], "2": []}}
    npm = {"dist-tags": {"latest": "1.1"}, "description": "d", "readme": "r", "time": {"created": "2020"}, "repository": {"url": "git+https://github.com/y"}, "versions": {"1.0": {}, "1.1": {}}}
    got = rows_of(S.registry_records(spark.createDataFrame([("a", "pypi", json.dumps(pypi)), ("b", "npm", json.dumps(npm)), ("c", "npm", None)], "name string, ecosystem string, value string")))
    assert [(r["version"], r["release_count"], r["first_published_at"], r["has_github"], r["exists_in_registry"], len(r["readme_text"])) for r in got] == [("2", 2, "2026-01", True, True, 20_000), ("1.1", 2, "2020", True, True, 1), (None, 0, None, False, False, 0)]
    with pytest.raises(Exception, match="unknown ecosystem"):
        S.registry_records(spark.createDataFrame([("a", "cargo", "{}")], "name string, ecosystem string, value string")).collect()
    js = spark.createDataFrame([("export const top = ['a', \"b\", 'c-d']",)], "value string")
    assert [r["name"] for r in S.quoted_names(js, most=2).collect()] == ["a", "b"]
    assert [r["name"] for r in S.union_names({"x": S.quoted_names(js), "y": None, "z": S.quoted_names(js)}, 2).collect()] == ["a", "b"]


def test_paging_and_retry():
    waits, calls = [], []

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            return 403, None, {}
        return (200, json.dumps([{"i": url}]), {"Link": '<https://next>; rel="next"'}) if url != "https://next" else (200, "[]", {})

    assert [json.loads(p) for p in S.fetch_pages(get, "https://first", 9, sleep=waits.append)] == [[{"i": "https://first"}]] and waits == [2.0]
    assert S.with_retry(lambda u: (500, None, {}), "u") is None
    assert len(list(S.fetch_pages(lambda u: (200, '[{"a": 1}]', {"Link": '<u>; rel="next"'}), "u", 5, most=1))) == 1


def test_text_sources(spark, tmp_path):
    p = tmp_path / "names.txt"
    p.write_text("pypi\ta\t3\n\nnpm\tb\t1\n")
    assert [tuple(r) for r in S.name_list(spark, str(p)).collect()] == [("pypi", "a", 3), ("npm", "b", 1)]
    p.write_text("pypi\ta\n")
    with pytest.raises(Exception, match="three fields"):
        S.name_list(spark, str(p)).collect()
    p.write_text("| 1 | `pkg` | PyPI |\nother\n")
    assert [tuple(r) for r in S.report_rows(spark, str(p)).collect()] == [("pypi", "pkg")]
    sheet = "intro\n## 1. `a`\n\n````\nVerdict: FALSE\n## x\n````\nVerdict: real \nNote: n\nAdjudicated: FALSE\nAdjudication note: why\n\n## 2. `b`\nVerdict:\nNote:\n"
    got = [tuple(r) for r in S.sheet_rows(spark.createDataFrame([(sheet,)], "value string"), ["REAL", "FALSE"]).collect()]
    assert got == [(1, "a", "REAL", "n", "FALSE", "why"), (2, "b", None, "", None, None)]
    with pytest.raises(Exception, match="unknown label"):
        S.sheet_rows(spark.createDataFrame([("## 1. `a`\nVerdict: MAYBE",)], "value string"), ["REAL"]).collect()
    with pytest.raises(ValueError):
        S.merge_list('{"merges": [{"id": "x"}]}')


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "item_id int, v string")
    sinks.snapshot(df, f"{tmp_path}/snap")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.snapshot(df, f"{tmp_path}/snap")
    seen = []

    def step(rows):
        seen.append(sorted(r["item_id"] for r in rows.collect()))
        return rows

    sinks.run_with_ledger(df, step, f"{tmp_path}/out", f"{tmp_path}/ledger")
    (tmp_path / "ledger" / "broken.json").write_text('{"item_id": 3, "sta')
    sinks.run_with_ledger(df.union(spark.createDataFrame([(3, "c")], df.schema)), step, f"{tmp_path}/out", f"{tmp_path}/ledger")
    assert seen == [[1, 2], [3]] and spark.read.json(f"{tmp_path}/out").count() == 3
    sinks.csv_table(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    sinks.atomic_write(tmp_path / "d" / "f", b"x")
    assert (tmp_path / "d" / "f").read_bytes() == b"x"
    assert sinks.config_hash({"a": 1, "b": 2}) == sinks.config_hash({"b": 2, "a": 1}) != sinks.config_hash({"a": 2})
    assert sinks.manifest("n", "s", "v", b"x", 1, "l", "p", k=1)["extra"] == {"k": 1}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": "a", "text": "a backdoor", "at": "2026-01-01T00:00:00"}, {"id": "a", "text": "a backdoor", "at": "2026-01-01T00:00:01"}, {"id": "b", "text": "fine", "at": "2026-01-01T00:00:02"}]
    (tmp_path / "in" / "one.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.records(spark, f"{tmp_path}/in", "id string, text string, at timestamp")
    ingest.append(ingest.labelled(stream, "text", "at", ["id"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted((r["id"], r["flag"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", True), ("b", False)]


def test_merges_compute_campaigns_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("en", f"s{i}", "text_prefix", i, 1, [f"p{i}"], ["r"], False, i == 2, False) for i in range(6)]
    schema = "ecosystem string, signature string, signature_type string, _seq long, member_count long, members array<string>, reporters array<string>, grammar_flag boolean, outcome boolean, no_text boolean"
    entries = [{"id": "a", "ecosystem": "en", "packages": ["p1", "p2"], "reason": "x"}, {"id": "b", "ecosystem": "en", "packages": ["p2", "p4"], "reason": "x"}]
    got = collapse.apply_merges(spark.createDataFrame(rows, schema).mapInArrow(noted, schema), entries)
    assert {r["_seq"]: (r["members"], r["member_count"], r["outcome"]) for r in got.collect()} == {0: (["p0"], 1, False), 1: (["p1", "p2", "p4"], 3, True), 3: (["p3"], 1, False), 5: (["p5"], 1, False)}
    assert seen.value == len(rows)
