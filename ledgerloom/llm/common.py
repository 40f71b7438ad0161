"""What the operators of this subpackage share: reading, Arrow maps, lineage cuts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lineage import cut, shared_dir  # noqa: F401  for the operators
from ledgerloom.tables import table  # noqa: F401

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a Python worker gets at once; a bound on memory, not on what is read.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty), and no other column unless named."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; LEDGERLOOM_VOCAB_DIR names another folder."""
    folder = os.environ.get("LEDGERLOOM_VOCAB_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def repeated(df: DataFrame, n: str, block: int = 4096) -> DataFrame:
    """Each row as often as column n says, which goes. No array is longer than n / block or block."""
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))).alias("__b"))
    last = F.least(F.lit(block), F.col(n) - F.col("__b") * block)
    return blocks.select(*(c for c in df.columns if c != n), F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("__i")).drop("__i")
