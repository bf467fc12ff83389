"""Connectors: advisory and registry JSON to rows. Pages land as files or strings; parsing is Spark's.

Fetching is separate from parsing: `fetch_pages` walks a paged endpoint on the
driver with the caller's `get`, and writes what it got as JSON lines, so that the
rest is reproducible without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GHSA = "array<struct<ghsa_id:string,summary:string,description:string,published_at:string,withdrawn_at:string,severity:string,references:string,vulnerabilities:array<struct<package:struct<name:string,ecosystem:string>>>>>"
OSV = "struct<vulns:array<struct<id:string,summary:string,details:string,published:string,withdrawn:string,severity:array<struct<type:string,score:string>>,references:array<struct<url:string>>>>>"
PYPI = "struct<info:struct<version:string,summary:string,description:string,author:string,project_urls:map<string,string>>,releases:map<string,array<struct<upload_time_iso_8601:string>>>>"
NPM = "struct<`dist-tags`:struct<latest:string>,description:string,readme:string,author:string,time:map<string,string>,repository:struct<url:string>,versions:map<string,string>>"
RECORD = ["advisory_id", "source", "package_name", "ecosystem", "summary", "description", "published_at", "withdrawn_at", "severity", "reference_urls", "fetched_at"]
README_CHARACTERS = 20_000


#: Statuses after which a request is made again: a broken connection (0) and refusals for being too frequent.
AGAIN = (0, 403, 429)


def tried(get: Callable[[str], tuple[int, str | None, dict]], url: str, tries: int = 4, wait: float = 2.0, sleep=time.sleep) -> tuple[int, str | None, dict]:
    """The first answer whose status is not in AGAIN, backing off between requests; none in `tries` raises."""
    for k in range(tries):
        status, body, headers = get(url)
        if status not in AGAIN:
            return status, body, headers
        if k + 1 < tries:
            sleep(wait * 2**k)
    raise ConnectionError(f"no answer in {tries} tries (last status {status}): {url}")


def with_retry(get, url: str, tries: int = 4, wait: float = 2.0, sleep=time.sleep):
    """(body, headers) of an answer with status 200, None for one with another; see `tried`."""
    status, body, headers = tried(get, url, tries, wait, sleep)
    return (body, headers) if status == 200 else None


def next_page(headers: dict) -> str | None:
    """The address a Link header calls next."""
    links = [p.split(";") for p in (headers.get("Link") or headers.get("link") or "").split(",") if 'rel="next"' in p]
    return links[0][0].strip().strip("<>") if links else None


def fetch_pages(get, first: str, max_pages: int, most: int | None = None, keys=lambda row: [json.dumps(row, sort_keys=True)], **retry):
    """Pages of a cursor-linked endpoint, until one is empty or not there, has no successor, or `most` distinct keys are in; `keys` gives a row's."""
    url, seen = first, set()
    for _ in range(max_pages):
        got = with_retry(get, url, **retry)
        if got is None:
            return
        rows = json.loads(got[0])
        if not rows:
            return
        yield got[0]
        if most is not None:
            seen.update(k for r in rows for k in keys(r))
            if len(seen) >= most:
                return
        url = next_page(got[1])
        if url is None:
            return


def _urls(references: Column) -> Column:
    """Of a JSON array of strings or of {url}; blanks dropped."""
    texts = F.from_json(references, "array<string>")
    url = F.transform(texts, lambda r: F.when(r.startswith("{"), F.get_json_object(r, "$.url")).otherwise(r))
    return F.filter(F.coalesce(url, F.array().cast("array<string>")), lambda u: F.coalesce(F.trim(u), F.lit("")) != "")


def ghsa_records(pages: DataFrame, column: str = "value", fetched_at: str = "") -> DataFrame:
    """One row per advisory and affected package; rows without a package name are dropped."""
    each = pages.select(F.explode(F.from_json(column, GHSA)).alias("a")).select("a", F.explode_outer("a.vulnerabilities").alias("v"))
    name, eco = F.col("v.package.name"), F.lower("v.package.ecosystem")
    rows = each.where(F.coalesce(name, F.lit("")) != "")
    return rows.select(
        F.col("a.ghsa_id").alias("advisory_id"), F.lit("ghsa").alias("source"), name.alias("package_name"), F.when(eco == "pip", "pypi").otherwise(eco).alias("ecosystem"),
        F.coalesce("a.summary", F.lit("")).alias("summary"), F.coalesce("a.description", F.lit("")).alias("description"), F.col("a.published_at").alias("published_at"), F.col("a.withdrawn_at").alias("withdrawn_at"),
        F.coalesce("a.severity", F.lit("")).alias("severity"), _urls(F.col("a.references")).alias("reference_urls"), F.lit(fetched_at).alias("fetched_at"),
    )


def osv_records(responses: DataFrame, column: str = "value", fetched_at: str = "") -> DataFrame:
    """`responses` has package_name, ecosystem and the response; severity is the first score, or nothing."""
    rows = responses.select("package_name", "ecosystem", F.explode(F.from_json(column, OSV)["vulns"]).alias("v"))
    return rows.select(
        F.col("v.id").alias("advisory_id"), F.lit("osv").alias("source"), "package_name", "ecosystem", F.coalesce("v.summary", F.lit("")).alias("summary"), F.coalesce("v.details", F.lit("")).alias("description"),
        F.col("v.published").alias("published_at"), F.col("v.withdrawn").alias("withdrawn_at"), F.coalesce(F.try_element_at("v.severity", F.lit(1))["score"], F.lit("")).alias("severity"),
        F.filter(F.coalesce(F.transform("v.references", lambda r: r["url"]), F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != "").alias("reference_urls"), F.lit(fetched_at).alias("fetched_at"),
    )


def truncated(text: Column, most: int = README_CHARACTERS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def registry_records(responses: DataFrame, column: str = "value", fetched_at: str = "") -> DataFrame:
    """name, ecosystem and what its registry says; a null response is a package that is not there. Other ecosystems raise."""
    py, js = F.from_json(column, PYPI), F.from_json(column, NPM)
    times = F.flatten(F.transform(F.map_values(py["releases"]), lambda files: F.transform(files, lambda f: f["upload_time_iso_8601"])))
    is_py = F.when(F.col("ecosystem") == "pypi", True).when(F.col("ecosystem") == "npm", False).otherwise(F.raise_error(F.concat(F.lit("unknown ecosystem: "), F.coalesce("ecosystem", F.lit("null")))))
    pick = lambda a, b: F.when(is_py, a).otherwise(b)
    github = lambda u: F.contains(u, F.lit("github.com"))
    return responses.select(
        "name", "ecosystem", pick(py["info"]["version"], js["dist-tags"]["latest"]).alias("version"), pick(py["info"]["summary"], js["description"]).alias("summary"),
        truncated(pick(py["info"]["description"], js["readme"])).alias("readme_text"), pick(py["info"]["author"], js["author"]).alias("author"),
        F.coalesce(pick(F.size(F.map_keys(py["releases"])), F.size(F.map_keys(js["versions"]))), F.lit(0)).alias("release_count"),
        pick(F.array_min(times), js["time"]["created"]).alias("first_published_at"),
        F.coalesce(pick(F.exists(F.map_values(py["info"]["project_urls"]), github), github(js["repository"]["url"])), F.lit(False)).alias("has_github"),
        F.col(column).isNotNull().alias("exists_in_registry"), F.lit(fetched_at).alias("fetched_at"),
    )


def quoted_names(module: DataFrame, column: str = "value", most: int | None = None) -> DataFrame:
    """rank, name of the strings in a script's array literal, in order."""
    inner = F.regexp_extract(column, r"(?s)\[(.*)\]", 1)
    names = F.regexp_extract_all(inner, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    rows = module.select(F.posexplode(F.transform(names, lambda n: F.substring(n, F.lit(2), F.length(n) - 2))).alias("rank", "name"))
    return rows.where(F.col("rank") < most) if most is not None else rows


def union_names(terms: dict[str, DataFrame], most: int) -> DataFrame:
    """Distinct names over the search terms that answered, in name order."""
    frames = [df.select("name") for df in terms.values() if df is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct().orderBy("name").limit(most)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with a fixed schema; blank lines are skipped; `_seq` follows file names and, in a file, its lines.

    Spark reads a file in blocks that need not come in order; blocks are numbered by file
    and start (a row a block), and rows counted within theirs.
    """
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    blocks = rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"))
    number = F.row_number().over(Window.orderBy("_file", "_block")) - 1
    blocks = blocks.select(F.col("_file").alias("_of_file"), F.col("_block").alias("_of_block"), (F.shiftleft(number.cast("long"), 33) - F.col("_first")).alias("_shift"))
    met = rows.join(F.broadcast(blocks), (F.col("_file") == F.col("_of_file")) & (F.col("_block") == F.col("_of_block")))
    return met.withColumn("_seq", F.col("_row") + F.col("_shift")).drop("_file", "_block", "_row", "_of_file", "_of_block", "_shift")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name, count of a tab-separated list; a line with other than three fields raises with its text."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    fields = F.split("value", "\t")
    checked = F.when(F.size(fields) == 3, fields).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))))
    return rows.select(checked.alias("f")).select(F.col("f")[0].alias("ecosystem"), F.col("f")[1].alias("name"), F.col("f")[2].cast("long").alias("count"))


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ecosystem, name) of a numbered report table."""
    line = r"^\| \d+ \| `([^`]+)` \| (\w+) \|"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.lower(F.regexp_extract("value", line, 2)).alias("ecosystem"), F.regexp_extract("value", line, 1).alias("name"))


def sheet_rows(sheets: DataFrame, labels: list[str] | None = None, column: str = "value") -> DataFrame:
    """row, package, verdict, note, adjudicated, adjudication_note of annotation sheets read whole.

    Fenced quotations go before any line is looked for; a verdict outside `labels` raises.
    """
    head = r"(?m)^## (\d+)\. `([^`]+)`[ \t]*$"
    heads = F.regexp_extract_all(column, F.lit(head), F.lit(0))
    bodies = F.slice(F.split(column, head, -1), F.lit(2), F.size(heads))
    rows = sheets.select(F.explode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("r"))
    body = F.regexp_replace("r.body", r"(?ms)^(`{3,})[^\n]*\n.*?^\1[ \t]*$", "")

    def line(name):
        return F.nullif(F.regexp_extract(body, rf"(?dm)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))

    def known(value):
        wrong = value.isNotNull() & ~value.isin(*labels) if labels else F.lit(False)
        return F.when(wrong, F.raise_error(F.concat(F.lit("unknown label: "), value))).otherwise(value)

    return rows.select(
        F.regexp_extract("r.head", head, 1).cast("int").alias("row"), F.regexp_extract("r.head", head, 2).alias("package"), known(F.upper(line("Verdict"))).alias("verdict"),
        F.coalesce(line("Note"), F.lit("")).alias("note"), known(F.upper(line("Adjudicated"))).alias("adjudicated"), line("Adjudication note").alias("adjudication_note"),
    )


def merge_list(text: str) -> list[dict]:
    """Hand-made merges; each entry names an id, an ecosystem, packages and a reason."""
    merges = json.loads(text)["merges"]
    for m in merges:
        if not all(m.get(k) for k in ("id", "ecosystem", "packages", "reason")):
            raise ValueError(f"a merge needs id, ecosystem, packages and reason: {m}")
    return merges
