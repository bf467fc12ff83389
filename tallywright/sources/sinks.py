"""Sinks: snapshots, tables, ledgers and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import tempfile
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def snapshot(df: DataFrame, path: str) -> None:
    """JSON lines; an existing snapshot is never overwritten."""
    df.write.mode("errorifexists").json(path)


def csv_table(df: DataFrame, path: str) -> None:
    """One headed CSV file: for tables that people read."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def not_done(items: DataFrame, ledger: DataFrame, key: str = "item_id") -> DataFrame:
    """Items the ledger has not completed; lines it could not parse count for nothing."""
    done = ledger.where(F.col(key).isNotNull() & (F.col("status") == "completed")).select(F.col(key).alias("done")).distinct()
    return items.join(done, F.col(key) == F.col("done"), "left_anti")


def exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def filesystem(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's files of rows and of ledger lines; None where it had none."""

    rows: str | None
    lines: str | None


class LedgerWriter(DataSourceArrowWriter):
    """Rows and ledger lines that appear together, or not at all.

    Tasks write below `_pending`, which readers skip. The commit writes down which
    files are to move (`intent`), moves them, and takes the note away; `settle` ends
    a commit that was cut off in between. A task that dies before the commit leaves
    files that nothing names.
    """

    def __init__(self, out: str, ledger: str):
        self.out, self.ledger, self.job = out, ledger, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, out = filesystem(self.out)
        folder, task = f"{out}/_pending/{self.job}", uuid.uuid4().hex
        store.create_dir(folder, recursive=True)
        names = {}
        open_files = {}
        try:
            for batch in iterator:
                for kind in ("rows", "lines"):
                    lines = batch.column(kind).drop_null().to_pylist()
                    if lines:
                        if kind not in open_files:
                            names[kind] = f"commit-{self.job}-{task}.{kind}.json"
                            open_files[kind] = store.open_output_stream(f"{folder}/{names[kind]}")
                        open_files[kind].write("".join(x + "\n" for x in lines).encode())
        finally:
            for file in open_files.values():
                file.close()
        return Written(names.get("rows"), names.get("lines"))

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        store, out = filesystem(self.out)
        note = {"rows": [m.rows for m in done if m.rows], "lines": [m.lines for m in done if m.lines]}
        folder = f"{out}/_pending/{self.job}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/intent.part") as file:
            file.write(json.dumps(note).encode())
        store.move(f"{folder}/intent.part", f"{folder}/intent.json")
        settle(self.out, self.ledger)

    def abort(self, messages) -> None:
        store, out = filesystem(self.out)
        folder = f"{out}/_pending/{self.job}"
        if store.get_file_info(folder).type != store.get_file_info(f"{folder}/none").type:
            store.delete_dir(folder)


def settle(out: str, ledger: str) -> int:
    """Finish commits of `LedgerWriter` that have said what they move; the number of them."""
    from pyarrow import fs

    (store, root), (_, lines_root) = filesystem(out), filesystem(ledger)
    ended = 0
    for folder in store.get_file_info(fs.FileSelector(f"{root}/_pending", allow_not_found=True)):
        intent = f"{folder.path}/intent.json"
        if not store.get_file_info(intent).is_file:
            continue
        with store.open_input_stream(intent) as file:
            note = json.loads(file.read())
        for kind, place in (("rows", root), ("lines", lines_root)):
            store.create_dir(place, recursive=True)
            for name in note[kind]:
                if store.get_file_info(f"{folder.path}/{name}").is_file:  # else it was moved before
                    store.move(f"{folder.path}/{name}", f"{place}/{name}")
        store.delete_dir(folder.path)
        ended += 1
    return ended


class Ledgered(DataSource):
    """`format("ledgered")`: appends column `rows` (JSON texts) to the path and column `lines` to option `ledger`, in one commit."""

    @classmethod
    def name(cls) -> str:
        return "ledgered"

    def writer(self, schema, overwrite: bool) -> LedgerWriter:
        if overwrite or {"rows", "lines"} - set(schema.names):
            raise ValueError("ledgered appends columns rows and lines")
        return LedgerWriter(self.options["path"], self.options["ledger"])


def run_with_ledger(items: DataFrame, step, out: str, ledger: str, key: str = "item_id") -> None:
    """Run `step` over what the ledger lacks; its rows and the items' ledger lines are committed together.

    The ledger alone is read to know what is done. Files in `out` that no commit of
    this writer put there may hold rows without ledger lines: where they carry
    `key`, those items are taken as done and only their lines follow.
    """
    spark = items.sparkSession
    spark.dataSource.register(Ledgered)
    settle(out, ledger)
    kind = items.schema[key].dataType.simpleString()
    seen = spark.read.schema(f"{key} {kind}, status string").json(ledger) if exists(spark, ledger) else spark.createDataFrame([], f"{key} {kind}, status string")
    todo = not_done(items, seen, key)
    missing = todo
    foreign = foreign_files(out)
    if foreign:
        there = spark.read.schema(f"{key} {kind}").json(foreign).select(F.col(key).alias("there")).where("there is not null").distinct()
        missing = todo.join(there, F.col(key) == F.col("there"), "left_anti")
    rows = step(missing)
    none = F.lit(None).cast("string")
    texts = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("rows"), none.alias("lines"))
    lines = todo.select(none.alias("rows"), F.to_json(F.struct(F.col(key), F.lit("completed").alias("status"))).alias("lines"))
    texts.unionByName(lines).write.format("ledgered").mode("append").option("ledger", ledger).save(out)


def foreign_files(out: str) -> list[str]:
    """Data files in `out` that `LedgerWriter` did not put there."""
    from pyarrow import fs

    store, root = filesystem(out)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    scheme = out[: out.index(":") + 1] + "//" if "://" in out else ""
    return [scheme + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".", "commit-"))]


def atomic_write(path: str | Path, data: bytes) -> None:
    """A reader sees the old file or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def sha256_of(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, sha256 of binaryFile rows."""
    return df.select(path, F.sha2(F.col(content), 256).alias("sha256"))


def config_hash(config: dict) -> str:
    """The same for any order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def manifest(name: str, source: str, version: str, data: bytes, records: int, licence: str, process: str, commit: str = "no-git-repo", **extra) -> dict:
    return {"dataset_name": name, "source": source, "source_version": version, "sha256": hashlib.sha256(data).hexdigest(), "record_count": records, "license": licence, "data_generating_process": process, "git_commit": commit, "extra": extra}


def commit_of(folder: str | Path) -> str:
    """The commit checked out in `folder`, or a word that says there is none."""
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return "no-git-repo"
    return found.stdout.strip() if found.returncode == 0 else "no-git-repo"


def versions(packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    out = {}
    for name in packages:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "not installed"
    return out


def experiment(name: str, dataset: dict, config: dict, seed: int, model: str, model_version: str, device: str = "cpu", folder: str | Path = ".", **extra) -> dict:
    """What is needed to run an experiment again; `dataset` is a `manifest`."""
    return {
        "experiment_id": name, "dataset_version": dataset["source_version"], "dataset_hash": dataset["sha256"], "config_hash": config_hash(config), "git_commit": commit_of(folder), "random_seed": seed,
        "model_name": model, "model_version": model_version, "python_version": platform.python_version(), "package_versions": versions(), "device": device,
        "timestamp": datetime.now(timezone.utc).isoformat(), **extra,
    }
