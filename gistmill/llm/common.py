"""Shared plumbing of the corpus operators: stored tables and bounded batches of texts.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.plans.tables import delete, new_path, scan, scope, shared_dir, size_of, small_batches, stored

__all__ = ["delete", "documents", "id_and_text", "new_path", "runs", "scope", "shared_dir", "size_of", "small_batches", "stored", "texts", "threshold"]


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of every text, the empty string for null."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for value in part.cast(pa.binary()):
            yield value.as_py() or b""


def runs(sizes: list[int], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into ranges of about ``limit`` bytes of text each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def threshold(total: int, wanted: int) -> int:
    """The bound on a hash of 63 bits below which about twice ``wanted`` of ``total`` rows lie; never zero for a wanted row."""
    return min((1 << 63) - 1, (2 * wanted << 63) // max(1, total))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under names of its own."""
    return df.select(F.col(f"`{id_col}`").alias("gm_id"), F.col(f"`{text_col}`").cast("string").alias("gm_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for operators that work on each text in Python."""
    return scan(spark, f"{sf_dir}/documents.parquet")
