"""Helpers shared by the corpus operators: shared-folder writes, batching over Arrow, fixed word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only where the session names none and runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tally-shared-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def kept(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors. `dropped` takes it away again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files that nothing refers to go now, not when the driver's heap fills
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `kept` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, total_bytes: int = 0, target: int = 48 << 20) -> int:
    """Shuffle width: the session's, or more where a partition would pass `target` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // target))


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def text_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of `text` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


#: Bytes in an Arrow batch, and rows in one of texts. Spark's defaults are meant for narrow rows; a batch is held on both sides.
BATCH_BYTES, BATCH_TEXTS = 8 << 20, 1000


def bounded_batches(spark: SparkSession, texts: bool = False) -> None:
    """Let this session hand rows to Python in batches of a few MB; smaller settings stay."""
    most = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_TEXTS} if texts else {})
    for key, bound in most.items():
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(key, str(bound))


def map_text(df: DataFrame, fn: Callable, schema, text: str = "text", limit: int = 4 << 20) -> DataFrame:
    """mapInArrow over `df` in batches bounded by text bytes; `fn` takes and returns a RecordBatch."""
    bounded_batches(df.sparkSession, texts=True)

    def run(batches):
        import pyarrow.compute  # noqa: F401  registers pa.compute on the worker

        for batch in text_batches(batches, text, limit):
            yield fn(batch)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return df.mapInArrow(run, schema)


def map_text_stream(df: DataFrame, fn: Callable, schema, text: str = "text", limit: int = 4 << 20) -> DataFrame:
    """As `map_text`, for an `fn` that takes a task's batches and yields what it likes."""
    bounded_batches(df.sparkSession, texts=True)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        yield from fn(text_batches(batches, text, limit))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
