import json

import pytest
from pyspark.sql import functions as F

from tallywright.functions import decisions, fixed
from tallywright.operators import collapse, reports, sheets
from tallywright.plans import commands, documents, study
from tallywright.sources import advisories as S
from tallywright.sources import collect, sinks


def rows(n=60):
    out = []
    for i in range(n):
        text = f"{'a backdoor' if i % 3 else 'nothing much'} in package number {i} of {i * 7}\n## Source: {'amazon-inspector' if i % 4 else 'kam193'} ({'a' * 20})"
        out.append({"advisory_id": f"A{i}", "source": "ghsa" if i % 5 else "osv", "package_name": f"p{i}{'-cli' if i % 2 else ''}", "ecosystem": "npm" if i % 7 < 3 else "pypi", "summary": "", "description": text, "published_at": f"2026-0{i % 6 + 1}-11T00:00:00Z"})
    return out


@pytest.fixture
def records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows())))
    return study.prepared(S.jsonl(spark, str(tmp_path / "r.jsonl"), study.SCHEMA))


def test_line_order_over_files_and_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.jsonl").write_text("\n\n".join(json.dumps({"advisory_id": f"{k}-{i}", "summary": "x" * 300}) for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r["advisory_id"] for r in S.jsonl(spark, str(tmp_path), study.SCHEMA).orderBy("_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{k}-{i}" for k in range(3) for i in range(400)]


def answers(url, body):
    """A service that knows one package in two, and is busy the first time for none."""
    if "osv" in url:
        name = json.loads(body)["package"]["name"]
        return (200, json.dumps({"vulns": [{"id": f"O-{name}", "summary": "s", "details": "d", "published": "2026-01-01"}]}), {}) if name.endswith(("0", "2", "4")) else (200, "{}", {})
    name = url.split("/")[-2 if url.endswith("json") else -1]
    return (200, json.dumps({"info": {"version": "1", "summary": name}, "releases": {}}), {}) if name != "gone" else (404, None, {})


def test_requests_and_collectors(spark, tmp_path):
    targets = spark.createDataFrame([(f"p{i}", "pypi") for i in range(6)], "package_name string, ecosystem string")
    got = collect.osv_answers(targets, answers, "now", sleep=lambda s: None).collect()
    assert sorted(r["advisory_id"] for r in got) == ["O-p0", "O-p2", "O-p4"] and got[0]["fetched_at"] == "now"
    wanted = spark.createDataFrame([("a-cli", "pypi"), ("gone", "pypi")], "name string, ecosystem string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    collect.collect_packages(wanted, out, ledger, answers, sleep=lambda s: None)
    collect.collect_packages(wanted.unionByName(spark.createDataFrame([("more", "pypi")], "name string, ecosystem string")), out, ledger, answers, sleep=lambda s: None)
    rows_ = {r["name"]: r for r in spark.read.json(out).collect()}
    assert set(rows_) == {"a-cli", "gone", "more"} and spark.read.json(out).count() == 3
    assert rows_["a-cli"]["grammar_match"]["is_flagged"] and not rows_["gone"]["exists_in_registry"]
    collect.collect_incidents(targets, str(tmp_path / "inc"), str(tmp_path / "led2"), answers, sleep=lambda s: None)
    collect.collect_incidents(targets, str(tmp_path / "inc"), str(tmp_path / "led2"), answers, sleep=lambda s: None)
    assert spark.read.json(str(tmp_path / "inc")).count() == 3
    with pytest.raises(ValueError):
        collect.registry_question("x", "cargo")


def test_a_crash_between_rows_and_ledger_repeats_nothing(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    items.where("item_id <> 'c'").withColumn("v", F.lit(1)).write.json(out)  # rows came, their ledger lines did not
    sinks.run_with_ledger(items, lambda todo: todo.withColumn("v", F.lit(1)), out, ledger)
    assert sorted(r["item_id"] for r in spark.read.json(out).collect()) == ["a", "b", "c"]
    assert spark.read.json(ledger).count() == 3


def test_name_lists_and_manifests(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return ["two", "one"]

    path = str(tmp_path / "lists")
    assert collect.name_lists(spark, path).count() == 0
    shown = lambda df: [(r["list"], r["name"], str(r["fetched_on"])) for r in df.orderBy("list", "rank").collect()]
    first = [("top", "two", "2026-01-01"), ("top", "one", "2026-01-01")]
    assert shown(collect.refreshed(spark, path, {"top": fetch}, on="2026-01-01", source="s")) == first
    assert shown(collect.refreshed(spark, path, {"top": fetch, "more": lambda: ["x"]}, on="2026-02-01")) == [("more", "x", "2026-02-01"), *first] and len(calls) == 1
    again = collect.refreshed(spark, path, {"top": fetch}, on="2026-03-01", since="2026-01-15")
    assert shown(again) == [("more", "x", "2026-02-01"), ("top", "two", "2026-03-01"), ("top", "one", "2026-03-01")] and len(calls) == 2
    with pytest.raises(RuntimeError):
        collect.refreshed(spark, path, {"more": list}, on="2026-04-01", since="2026-04-01")
    assert collect.name_lists(spark, path).where("list = 'more'").count() == 1
    about = sinks.manifest("top", "s", "v", b"two", 2, "not specified", "real_world_observed", sinks.commit_of(tmp_path))
    assert about["record_count"] == 2 and sinks.commit_of(tmp_path) == "no-git-repo"
    e = sinks.experiment("x", about, {"a": 1}, 7, "m", "1", folder=tmp_path)
    assert e["dataset_hash"] == about["sha256"] and "pyspark" in e["package_versions"] and e["git_commit"] == "no-git-repo"


def test_places(tmp_path):
    p = collect.here(tmp_path, {})
    assert p["raw"] == tmp_path / "data" / "raw" and all(x.is_dir() for x in p.values()) and p["results"] == tmp_path / "results"
    split = collect.places(tmp_path / "w", tmp_path / "in")
    assert split["raw"] == split["external"] == tmp_path / "in" and split["interim"] == tmp_path / "w" / "data" / "interim"


def test_sheets_are_read_back(spark, records, tmp_path):
    campaigns = collapse.collapse(records)
    before = spark.createDataFrame([("pypi", "p4")], "ecosystem string, package_name string")
    positive, negative, meta = sheets.annotation_rows(campaigns, records, before, 12, 6)
    assert meta["precision"]["frame"] == 39 and sum(meta["precision"]["allocation"].values()) == 12 and meta["n_dv_positive"] == 40
    record = sheets.sample_record(meta, precision=positive, recall=negative)
    assert [r["row"] for r in record["precision_rows"]] == list(range(1, 13)) and all(r["n_matches"] == 1 and r["categories"] == ["remote_backdoor_access"] for r in record["precision_rows"])
    for name, frame, verdict in (("precision", positive, "REAL"), ("recall", negative, "ABSENT")):
        text = documents.sheet(f"A {name} sheet", ["About it."], frame)
        for k in (1, 2):
            (tmp_path / f"{name}{k}.md").write_text(text.replace("Verdict:", f"Verdict: {verdict}"))
        got = S.sheet_rows(spark.createDataFrame([(text,)], "value string")).orderBy("row").collect()
        assert [(r["row"], r["package"]) for r in got] == [(r["row"], r["package_name"]) for r in record[f"{name}_rows"]]
    paths = [[str(tmp_path / f"{n}{k}.md") for k in (1, 2)] for n in ("precision", "recall")]
    out = commands.agreement(spark, *paths, record)
    assert out["by_annotator"]["annotator1"]["precision"]["k"] == 12 and out["agreement"]["recall_sheet"]["percent_agreement"] == 1
    report = commands.labeller_report(spark, *paths, record, records)
    assert report["labeler_precision"]["overall"]["k"] == 12 and report["labeler_miss_rate"]["overall"]["k"] == 0 and report["disagreements"] == [] and len(report["resolution_flags"]) == 18
    json.dumps([out, report, record], default=str)


def test_sheets_on_disk(spark, records, tmp_path):
    record = commands.annotation(records, spark.createDataFrame([], "ecosystem string, package_name string"), str(tmp_path / "out"), 6, 4)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["precision_annotator1.md", "precision_annotator2.md", "recall_annotator1.md", "recall_annotator2.md", "sample.json"]
    got = commands._sheet(spark, str(tmp_path / "out" / "recall_annotator2.md"), commands.RECALL_LABELS).orderBy("row").collect()
    assert [(r["row"], r["package"]) for r in got] == [(r["row"], r["package_name"]) for r in record["recall_rows"]] and len(got) == 4
    assert json.loads((tmp_path / "out" / "sample.json").read_text())["precision"]["frame"] == 40


def test_spot_check(spark, records):
    campaigns = collapse.collapse(records)
    listed = spark.createDataFrame([(0, "pypi", "p4"), (1, "npm", "p1-cli")], "position int, ecosystem string, package_name string")
    got = sheets.spot_check_rows(campaigns, records, listed, {"npm": 3, "pypi": 4}).orderBy("row").collect()
    assert [(r["part"], r["package_name"]) for r in got[:2]] == [("a", "p4"), ("a", "p1-cli")]
    assert [r["ecosystem"] for r in got[2:]] == ["npm"] * 3 + ["pypi"] * 4 and not {"p4", "p1-cli"} & {r["package_name"] for r in got[2:]}
    assert all("⟦" in m["snippet"] for r in got for m in r["matches"])


def test_audit(spark, tmp_path):
    long = "The very same opening of an advisory, told at some length so that it fills more than one hundred and twenty characters: "
    texts = [long + "first ending of it, which goes on", long + "second ending, unlike it"] + ["Campaign: C1\n" + t for t in ("alpha beta gamma", "delta epsilon zeta", "alpha beta gamma delta")]
    lines = [{"advisory_id": f"A{i}", "source": "ghsa", "package_name": f"q{i}", "ecosystem": "npm", "summary": "", "description": t, "published_at": "2026-01-01"} for i, t in enumerate(texts)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    found = documents.audit_tables(study.prepared(S.jsonl(spark, str(tmp_path / "a.jsonl"), study.SCHEMA)))
    assert (found["n_records"], found["n_packages"], found["n_campaigns"]) == (5, 5, 3)
    (under,) = found["under"]
    assert (under["first"]["campaign_id"], under["second"]["campaign_id"], under["diverge_at"]) == ("C001", "C002", len(long)) and under["first_excerpt"].startswith("first ending")
    (over,) = found["over"]
    assert (over["n_members"], over["first_name"], over["second_name"], over["n_low"]) == (3, "q2", "q3", 2)
    text = documents.audit(found, "a")
    assert "| 1 | C003 |" in text and "campaign_tag 1" in text


def test_grammar_of_lists(spark, records, tmp_path):
    (tmp_path / "names.tsv").write_text("pypi\tflask-turbo\t9\n\nnpm\tplain\t4\npypi\tother-cli\t1\npypi\tquiet\t7\nnpm\tcalm\t2\n")
    out = commands.grammar(spark, S.name_list(spark, str(tmp_path / "names.tsv")), {"npm": ["lodash", "eslint-cli"], "pypi": ["numpy"]}, records, {"npm": ["vue"]})
    assert out["sets"]["hallucinated"]["all"]["n"] == 5 and out["sets"]["benign"]["npm"]["flag_count"] == 1 and out["sets"]["benign_more"]["all"]["n"] == 1
    assert out["sets"]["campaigns"]["all"]["n"] == 60 and out["sets"]["campaigns"]["all"]["flag_count"] == 30
    s = out["sets"]["hallucinated"]
    assert (s["pypi"]["flag_count"], s["pypi"]["n"], s["npm"]["flag_count"], s["npm"]["n"]) == (2, 3, 0, 2)
    assert [r["name"] for r in out["examples"]["unflagged"]] == ["quiet", "plain", "calm"]


def test_published_tables(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows())))
    out = commands.published(spark, S.jsonl(spark, str(tmp_path / "r.jsonl"), study.SCHEMA), names_report={"sets": {"hallucinated": {"all": {"flag_count": 7, "n": 139}}}})
    assert [(r["set"], r["flagged"], r["n"]) for r in out["flag_rates"]] == [("hallucinated", 7, 139), ("campaigns", 30, 60)]
    by = {(r["result"], r["kind"], r["name"], r["term"]): r for r in out["estimates"]}
    assert len(by) == len(out["estimates"]) and by["all", "exact", "pooled", "x"]["n"] == 60
    a, b, c, d = 20, 10, 20, 10
    assert by["all", "exact", "pooled", "x"]["ratio"] == pytest.approx(a * d / (b * c))
    assert {("all", "exact", "by_ecosystem/strata/npm", "x"), ("ghsa", "common", "by_ecosystem/cmh", "x"), ("all", "model", "logit/main", "x"), ("all", "model", "logit/c", "has_kam193"), ("corrected", "draws", "miss_17_40", "x")} <= set(by)
    m = out["misclassification"]["miss_17_40"]
    assert m["simple"]["table"][0] == pytest.approx([20 * 55 / 60 + 10 * 17 / 40, 30 - 20 * 55 / 60 - 10 * 17 / 40])
    assert sum(r["kind"] == "draws" for r in out["forest"]["flag"]) == 2 and all(r["term"] == "x" for r in out["forest"]["flag"])
    assert {r["term"] for r in out["forest"]["reporters"]} >= {"has_amazon_inspector"} and all(r["lo"] is not None for rows_ in out["forest"].values() for r in rows_)
    json.dumps(out, default=str)


def test_figure_tables(spark, records):
    out = documents.figure_tables(records, "2026-01-01", {"other": (1, 4)})
    assert sum(r["records"] for r in out["by_ecosystem"]) == 60 and sum(r["n_groups"] for r in out["sizes"]) == 60
    rates = {r["split"]: (r["k"], r["n"]) for r in out["outcome_rates"]}
    assert rates["flagged"] == (20, 30) and rates["inspector"][1] + rates["no inspector"][1] == 60 and rates["reporters 1"][1] == 60 and "reporters 2+" not in rates
    assert [(r["set"], r["rate"]) for r in out["flag_rates"]] == [("other", 0.25), ("campaigns", 0.5)]
    curve = [r["power"] for r in out["power"] if r["ratio"] == 2.0]
    assert len(out["power"]) == 3 * 40 and curve == sorted(curve) and 0 < curve[0] < curve[-1] < 1
    assert sum(r["n"] for r in out["days"]) == 60 and sum(r["n"] for r in out["reporter_sets"]) == 60 and {r["category"] for r in out["mechanisms"]} == {"remote_backdoor_access"}
    json.dumps(out)


def test_lists_and_spot_check_commands(spark, tmp_path):
    def get(url, body):
        if "top-pypi" in url:
            return 200, json.dumps({"rows": [{"project": "a"}, {"project": "b"}]}), {}
        if "high-impact" in url:
            return 200, "export const top = ['x', \"y\"]", {}
        return (200, json.dumps({"objects": [{"package": {"name": url.split("text=")[1].split("&")[0]}}]}), {}) if "react" in url or "cli" in url else (500, None, {})

    lists = commands.fetched_lists(get)
    assert (lists["pypi"](), lists["npm"](), lists["npm_search"]()) == (["a", "b"], ["x", "y"], ["cli", "client", "react"])
    lines = [{"advisory_id": f"{s}{i}", "source": s, "package_name": f"p{i}", "ecosystem": "npm", "summary": "", "description": "has a backdoor" if s == "osv" or i % 2 else "calm", "published_at": "2026-01-01"} for i in range(6) for s in ("ghsa", "osv")]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows_ = study.prepared(S.jsonl(spark, str(tmp_path / "r.jsonl"), study.SCHEMA))
    report = spark.createDataFrame([("npm", "p0"), ("npm", "p2"), ("npm", "p4")], "ecosystem string, package_name string")
    got = commands.spot_check(rows_, report, {"npm": 0}).where("part = 'a'")
    assert sorted(r["package_name"] for r in got.collect()) == ["p0", "p2", "p4"]
    with pytest.raises(Exception, match="only listed or only computed"):
        commands.spot_check(rows_, report.where("package_name <> 'p2'"), {"npm": 0}).collect()


def test_diagnostics(spark, records):
    out = commands.diagnostics(records, ["remote_backdoor_access"])
    assert sum(r["n"] for r in out["months"]) == 60 and out["sizes"] == [{"member_count": 1, "n_groups": 60}]
    assert out["without"]["none"][0] == (20, 10, 20, 10) and out["without"]["remote_backdoor_access"][0] == (0, 30, 0, 30)
    assert {(r["reporter"], r["a"] + r["b"] + r["c"] + r["d"]) for r in out["by_reporter"]} == {("kam193", 15), ("amazon-inspector", 45)}


def test_gate_report():
    text = documents.gate_report(decisions.PilotCounts(20, 50, 3), {"least_incidents": 30, "least_controls": 40, "least_events": 10}, (0.4, 0.2), 20)
    assert "GO_WITH_REDUCED_SCOPE" in text and "labelled incidents 20 below 30" in text and "## Next" in text


def test_snapshot(spark, tmp_path):
    page = json.dumps([{"ghsa_id": f"G{i}", "summary": "s", "description": "d", "published_at": "2026-02-01", "vulnerabilities": [{"package": {"name": f"p{i}", "ecosystem": "pip"}}]} for i in range(5)])

    def get(url, body):
        return (200, page if "ecosystem=pip" in url else "[]", {}) if "api.github" in url else answers(url, body)

    about = commands.snapshot(spark, get, str(tmp_path / "snap"), fetched_at="now", sleep=lambda s: None)
    assert about["record_count"] == 8 and about["extra"]["source_counts"] == {"ghsa": 5, "osv": 3} and about["extra"]["unique_packages"] == 5
    assert S.jsonl(spark, str(tmp_path / "snap"), study.SCHEMA).count() == 8


def test_old_and_new_negation(spark):
    from tallywright.operators import labelling

    d = spark.createDataFrame([("There is no evidence of a backdoor.",), ("It does not work but has a backdoor.",)], "v string")
    assert {(r["rule"], r["cue"]): r["n"] for r in labelling.negation_drops_by_rule(d, "v").collect()} == {("before", "no evidence of"): 1, ("before", "does not"): 1, ("now", "no evidence of"): 1}
    assert fixed.NEGATION_CUES and reports
