"""Services as Spark data sources: paged advisory listings, in batch and as a stream, and an answer for each package.

    register(spark)
    spark.read.format("advisory_listing").option("ecosystems", "pip,npm").load()       # ecosystem, page, value
    spark.readStream.format("advisory_listing").option("pagesPerBatch", 10).load()
    spark.read.format("package_answers").option("service", "osv").load("targets/")     # name, ecosystem, status, value

`value` is the service's JSON, for the parsers of `advisories`. A listing is walked
by one task an ecosystem, since each page names the next; what a task holds is one
page. A stream's offset is, for each ecosystem, the address of a page and the
number of its rows that are read, so a restart goes on inside the listing and rows
that are added later come as they appear. To find how far a batch goes the driver
looks at the pages ahead one at a time and keeps their addresses alone.

Targets are lines `ecosystem<TAB>name` in a file or folder on storage that all
executors reach; they are dealt by byte ranges.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallywright.sources import advisories as S
from tallywright.sources import collect
from tallywright.sources.sinks import filesystem


@dataclass
class Segment(InputPartition):
    """A listing from one place to another; without an end, to its last page."""

    ecosystem: str
    url: str
    skip: int = 0
    end: dict | None = None


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


class Client:
    """Requests with the options of a source; the token is read from the variable named, where the request is made."""

    def __init__(self, options):
        self.timeout, self.tries, self.wait = float(options.get("timeout", 30)), int(options.get("tries", 4)), float(options.get("wait", 2))
        self.token = options.get("tokenVariable", "GITHUB_TOKEN")

    def ask(self, url: str, body: str | None = None, authorised: bool = False):
        """(status, text, headers) of the answer that ends the tries; raises where there is none."""
        token = os.environ.get(self.token) if authorised else None
        get = collect.http({"Authorization": f"Bearer {token}"} if token else None, self.timeout)
        return S.tried(lambda u: get(u, body), url, self.tries, self.wait)

    def page(self, url: str) -> tuple[list, str | None]:
        """Rows of a page and the address of the next; no rows where the service has no such page."""
        status, text, headers = self.ask(url, authorised=True)
        return (json.loads(text), S.next_page(headers)) if status == 200 else ([], None)


def pairs(rows: list[dict]) -> set[tuple[str, str]]:
    """(advisory, package) of a page's rows; what a cap counts."""
    return {(r.get("ghsa_id") or "", name) for r in rows for v in r.get("vulnerabilities") or [] if (name := (v.get("package") or {}).get("name"))}


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.client, self.options = Client(options), options
        self.max_pages, most = int(options.get("maxPages", 100)), options.get("most")
        self.most = int(most) if most else None

    def partitions(self) -> list[Segment]:
        return [Segment(e, u) for e, u in first_pages(self.options).items()]

    def read(self, segment: Segment) -> Iterator[tuple]:
        url, seen = segment.url, set()
        for _ in range(self.max_pages):
            rows, following = self.client.page(url)
            if not rows:
                return
            yield segment.ecosystem, url, json.dumps(rows)
            if self.most is not None:  # holds no more than the cap and a page
                seen |= pairs(rows)
                if len(seen) >= self.most:
                    return
            if following is None:
                return
            url = following


class ListingStream(DataSourceStreamReader):
    def __init__(self, options):
        self.client, self.options, self.pages = Client(options), options, int(options.get("pagesPerBatch", 10))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {e: {"url": u, "skip": 0} for e, u in first_pages(self.options).items()}

    def latestOffset(self) -> dict:
        self.at = {e: self._ahead(place) for e, place in (self.at or self.initialOffset()).items()}
        return self.at

    def _ahead(self, place: dict) -> dict:
        for _ in range(self.pages):
            rows, following = self.client.page(place["url"])
            if following is None:
                return {"url": place["url"], "skip": max(len(rows), place["skip"])}
            place = {"url": following, "skip": 0}
        return place

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        if self.at is None:  # after a restart Spark plans the last batch first: go on from its end
            self.at = end
        return [Segment(e, place["url"], place["skip"], end[e]) for e, place in start.items() if e in end and place != end[e]]

    def read(self, segment: Segment) -> Iterator[tuple]:
        url, skip, end = segment.url, segment.skip, segment.end
        while url is not None:
            rows, following = self.client.page(url)
            last = url == end["url"]
            some = rows[skip : end["skip"]] if last else rows[skip:]
            if some:
                yield segment.ecosystem, url, json.dumps(some)
            if last:
                return
            url, skip = following, 0
        raise RuntimeError(f"the listing of {segment.ecosystem} no longer leads to {end['url']}")


def first_pages(options) -> dict[str, str]:
    template, wanted = options.get("url", collect.ADVISORIES), options.get("ecosystems", ",".join(collect.ADVISORY_ECOSYSTEMS))
    return {e.strip(): template.format(ecosystem=e.strip(), per_page=int(options.get("perPage", 50))) for e in wanted.split(",") if e.strip()}


class AdvisoryListing(DataSource):
    """Options: ecosystems, url (with {ecosystem} and {per_page}), perPage, maxPages and most (batch), pagesPerBatch (stream), tokenVariable, timeout, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return "advisory_listing"

    def schema(self) -> str:
        return "ecosystem string, page string, value string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options)


class AnswersReader(DataSourceReader):
    def __init__(self, options):
        self.client, self.service, self.path = Client(options), options.get("service", "osv"), options.get("path")
        self.bytes, self.base = int(options.get("rangeBytes", 1 << 16)), options.get("baseUrl")
        if self.service not in ("osv", "registry") or not self.path:
            raise ValueError("package_answers takes a path of targets and a service, osv or registry")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(at + self.bytes, f.size)) for f in files for at in range(0, f.size, self.bytes)]

    def lines(self, part: Range) -> Iterator[str]:
        store, _ = filesystem(self.path)
        with store.open_input_file(part.path) as raw, io.BufferedReader(raw) as file:
            at = max(part.start - 1, 0)
            file.seek(at)
            if part.start:  # the line that holds the byte before belongs to the range before, unless it ends there
                at += len(file.readline())
            while at < part.end and (line := file.readline()):
                at += len(line)
                if line.strip():
                    yield line.decode().rstrip("\r\n")

    def read(self, part: Range) -> Iterator[tuple]:
        question = collect.osv_question if self.service == "osv" else collect.registry_question
        for line in self.lines(part):
            ecosystem, _, name = line.partition("\t")
            if not name:
                raise ValueError(f"a target is ecosystem, tab, name: {line!r}")
            url, body = question(name, ecosystem)
            if self.base:  # a mirror
                url = self.base.rstrip("/") + "/" + url.split("/", 3)[3]
            status, text, _ = self.client.ask(url, body)
            yield name, ecosystem, status, text if status == 200 else None


class PackageAnswers(DataSource):
    """Options: service (osv or registry), rangeBytes, baseUrl (of a mirror), timeout, tries, wait; the path holds the targets."""

    @classmethod
    def name(cls) -> str:
        return "package_answers"

    def schema(self) -> str:
        return "name string, ecosystem string, status int, value string"

    def reader(self, schema) -> AnswersReader:
        return AnswersReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (AdvisoryListing, PackageAnswers):
        spark.dataSource.register(source)
