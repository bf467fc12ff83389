"""A training corpus from raw documents: five stages, each written and reread as the next one's documents.

Toxic documents go, one document of every near-duplicate group stays, personal
data is replaced, sources are mixed to their targets (a document taken twice is
two rows), and what is left is encoded. All but the last stage return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import minhash, mixing, pieces, pii, toxicity
from tallywright.llm.common import kept
from tallywright.session import table

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash_dedup", minhash.stage),
    ("pii", pii.stage),
    ("mix_sources", mixing.stage),
    ("pieces", pieces.stage),
]

#: A trained score decides the first stage, so SQL cannot give these rows; the tests replay the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
