"""Records as a stream of JSON files: deduplicated by key within a watermark, labelled, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import fixed
from tallywright.operators import labelling


def records(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def labelled(stream: DataFrame, text: str, at: str, keys: list[str], late: str = "7 days", taxonomy=fixed.MECHANISMS) -> DataFrame:
    """The first of each key by `at` (a timestamp) within the watermark, with its labels."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return labelling.labelled(once, text, taxonomy)


def rates(stream: DataFrame, at: str, flag: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Records and flagged ones per window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged"))


def append(stream: DataFrame, out: str, checkpoint: str):
    """Everything there is, then stop; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
