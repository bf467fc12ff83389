import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tallywright.sources import advisories as S
from tallywright.sources import collect, services, sinks


class Stub:
    """A service with a listing of advisories by cursor, and answers by package; it can drop connections."""

    def __init__(self):
        self.pages = {"pip": [[self.row(f"P{p}-{i}", f"p{i}") for i in range(3)] for p in range(5)], "npm": [[self.row("N0", "n")], [self.row("N1", "n"), self.row("N2", "n")]]}
        self.drops, self.asked = Counter(), Counter()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def answer(self, status, value=None, **headers):
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(b"" if value is None else json.dumps(value).encode())

            def dropped(self):
                if stub.drops[self.path] > 0:
                    stub.drops[self.path] -= 1
                    self.connection.close()
                    return True
                stub.asked[self.path] += 1
                return False

            def do_GET(self):
                if self.dropped():
                    return
                url = urlparse(self.path)
                if url.path == "/advisories":
                    q = {k: v[0] for k, v in parse_qs(url.query).items()}
                    pages, at = stub.pages.get(q["ecosystem"], []), int(q.get("after", 0))
                    link = {"Link": f'<{stub.url}/advisories?ecosystem={q["ecosystem"]}&after={at + 1}>; rel="next"'} if at + 1 < len(pages) else {}
                    self.answer(200, pages[at] if at < len(pages) else [], **link)
                elif url.path.endswith("gone"):
                    self.answer(404)
                else:
                    self.answer(200, {"info": {"version": url.path}})

            def do_POST(self):
                if self.dropped():
                    return
                name = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["package"]["name"]
                self.answer(200, {"vulns": [{"id": f"O-{name}"}]} if name != "clean" else {})

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @staticmethod
    def row(advisory, *names):
        return {"ghsa_id": advisory, "summary": "s", "vulnerabilities": [{"package": {"name": n, "ecosystem": "pip"}} for n in names]}


@pytest.fixture
def stub(spark):
    services.register(spark)
    made = Stub()
    yield made
    made.server.shutdown()


def listing(reader, stub, **options):
    reader = reader.format("advisory_listing").option("url", stub.url + "/advisories?ecosystem={ecosystem}&per_page={per_page}").option("wait", "0.01")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def ids(df):
    return sorted(a["ghsa_id"] for r in df.collect() for a in json.loads(r["value"]))


def test_listing_is_a_partition_an_ecosystem(spark, stub):
    pages = listing(spark.read, stub)
    assert pages.rdd.getNumPartitions() == 2 and pages.count() == 7
    assert ids(pages) == sorted(a["ghsa_id"] for p in stub.pages.values() for page in p for a in page)
    assert S.ghsa_records(pages).where("ecosystem = 'pypi'").count() == 18  # as the rows say
    assert listing(spark.read, stub, maxPages="1").count() == 2 and listing(spark.read, stub, ecosystems="cargo").count() == 0


def test_the_cap_counts_advisory_and_package(spark, stub):
    stub.pages = {"pip": [[Stub.row("A", "x"), Stub.row("B", "x")], [Stub.row("C", "x")], [Stub.row("D", "x")]], "npm": [[Stub.row("E", "a", "b", "a", "c")], [Stub.row("F", "d")]]}
    assert ids(listing(spark.read, stub, most="3")) == ["A", "B", "C", "E"]  # two advisories on one package are two, one on three packages three
    assert ids(listing(spark.read, stub, most="2")) == ["A", "B", "E"]
    get, at = collect.http(), stub.url
    keyed = collect.advisory_pages(spark, lambda u, b: get(u.replace("https://api.github.com", at), b), most=3, wait=0.01)
    assert ids(keyed) == ["A", "B", "C", "E"]


def test_broken_connections_back_off_and_then_raise(spark, stub):
    second = "/advisories?ecosystem=pip&after=1"
    stub.drops[second] = 2
    assert len(ids(listing(spark.read, stub))) == 18 and stub.asked[second] == 1
    stub.drops[second] = 99
    with pytest.raises(Exception, match="no answer in 3 tries"):
        listing(spark.read, stub, tries="3").collect()
    waits = []
    with pytest.raises(ConnectionError):
        S.with_retry(lambda u: (0, None, {}), "u", tries=3, sleep=waits.append)
    assert waits == [2.0, 4.0]


def run(spark, stub, out, checkpoint, **options):
    q = listing(spark.readStream, stub, **options).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_restarts_from_its_offset_without_repeats(spark, stub, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    read = lambda: ids(spark.read.schema("ecosystem string, page string, value string").json(out))
    run(spark, stub, out, checkpoint, pagesPerBatch="2")
    first = read()
    assert first == sorted(["N0", "N1", "N2", *(f"P{p}-{i}" for p in range(2) for i in range(3))])
    stub.asked.clear()
    run(spark, stub, out, checkpoint, pagesPerBatch="2")
    assert read() == sorted([*first, *(f"P{p}-{i}" for p in (2, 3) for i in range(3))])
    assert stub.asked["/advisories?ecosystem=pip&per_page=50"] == 0  # it goes on inside the listing
    for _ in range(2):
        run(spark, stub, out, checkpoint, pagesPerBatch="2")
    whole = sorted(a["ghsa_id"] for p in stub.pages.values() for page in p for a in page)
    assert read() == whole
    stub.pages["npm"][1].append(Stub.row("N3", "n"))  # the listing grows in its last page, then by another
    stub.pages["pip"].append([Stub.row("P9", "p")])
    for _ in range(2):
        run(spark, stub, out, checkpoint, pagesPerBatch="2")
    assert read() == sorted([*whole, "N3", "P9"])


def test_answers_by_ranges_of_targets(spark, stub, tmp_path):
    (tmp_path / "targets").mkdir()
    names = [f"name{'x' * (i % 23)}{i}" for i in range(97)] + ["clean"]
    (tmp_path / "targets" / "a.tsv").write_text("".join(f"pypi\t{n}\n" for n in names[:50]))
    (tmp_path / "targets" / "b.tsv").write_text("\n".join(f"npm\t{n}" for n in names[50:]))
    (tmp_path / "targets" / "_SUCCESS").write_text("no\tpe")
    ask = lambda service, size: spark.read.format("package_answers").option("service", service).option("baseUrl", stub.url).option("rangeBytes", size).option("wait", "0.01").load(str(tmp_path / "targets"))
    for size in (7, 64, 1 << 20):
        got = ask("osv", size)
        assert sorted(r["name"] for r in got.collect()) == sorted(names), size
    assert got.rdd.getNumPartitions() == 2
    found = S.osv_records(got.withColumnRenamed("name", "package_name"))
    assert sorted(r["advisory_id"] for r in found.collect()) == sorted(f"O-{n}" for n in names if n != "clean")
    (tmp_path / "targets" / "a.tsv").write_text("pypi\tgone\nnpm\t@scope/one")
    rows = {r["name"]: r for r in ask("registry", 64).collect() if r["name"] in ("gone", "@scope/one")}
    assert (rows["gone"]["status"], rows["gone"]["value"]) == (200, '{"info": {"version": "/pypi/gone/json"}}') and "@scope" in rows["@scope/one"]["value"]
    (tmp_path / "targets" / "a.tsv").write_text("npm\tgone")
    assert [r["value"] for r in ask("registry", 64).where("status = 404").collect()] == [None]
    with pytest.raises(Exception, match="service"):
        ask("other", 64).collect()


def lines(spark, path, column):
    return sorted(r[column] for r in spark.read.json(path).collect()) if sinks.exists(spark, path) and any(sinks.foreign_files(path) or [1]) else []


def test_rows_and_ledger_appear_together(spark, tmp_path):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(c,) for c in "abcdef"], "item_id string")
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")

    def broken(todo):  # one task writes, another dies before the commit
        return todo.repartition(3).withColumn("v", F.when(F.col("item_id") == "e", F.raise_error(F.lit("died"))).otherwise(F.lit(1)))

    with pytest.raises(Exception, match="died"):
        sinks.run_with_ledger(items, broken, out, ledger)
    assert not list((tmp_path / "out").glob("*.json")) and not (tmp_path / "ledger").exists()
    half = items.where("item_id < 'd'")
    sinks.run_with_ledger(half, lambda todo: todo.where("item_id <> 'b'").withColumn("v", F.lit(1)), out, ledger)  # b has no rows
    assert lines(spark, out, "item_id") == ["a", "c"] and lines(spark, ledger, "item_id") == ["a", "b", "c"]
    asked = []

    def step(todo):
        asked.extend(sorted(r["item_id"] for r in todo.collect()))
        return todo.withColumn("v", F.lit(2))

    sinks.run_with_ledger(items, step, out, ledger)
    assert asked == ["d", "e", "f"] and lines(spark, out, "item_id") == ["a", "c", "d", "e", "f"] and lines(spark, ledger, "item_id") == list("abcdef")
    assert sinks.foreign_files(out) == []  # nothing of its own is read again to know what is done


def test_a_commit_cut_off_is_finished_by_the_next_run(spark, tmp_path):
    import pyarrow as pa

    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    w = sinks.LedgerWriter(out, ledger)
    batch = pa.RecordBatch.from_pydict({"rows": ['{"item_id":"a"}', None], "lines": [None, '{"item_id":"a","status":"completed"}']})
    messages = [w.write(iter([batch])), w.write(iter([batch])), None]
    assert not list((tmp_path / "out").glob("*.json"))
    stop = sinks.settle
    try:
        sinks.settle = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
        with pytest.raises(KeyboardInterrupt):
            w.commit(messages)
    finally:
        sinks.settle = stop
    moved = next((tmp_path / "out" / "_pending").glob("*/*rows.json"))
    moved.rename(tmp_path / "out" / moved.name)  # one of the moves had been made
    assert sinks.settle(out, ledger) == 1 and sinks.settle(out, ledger) == 0
    assert len(list((tmp_path / "out").glob("*.json"))) == 2 and len(list((tmp_path / "ledger").glob("*.json"))) == 2
    other = sinks.LedgerWriter(out, ledger)
    other.write(iter([batch]))
    other.abort([])
    other.abort([])
    assert sinks.settle(out, ledger) == 0 and not list((tmp_path / "out" / "_pending").glob("*/*"))
    assert time.time() > 0
