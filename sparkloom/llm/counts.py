"""Token counts of whole texts, in Arrow functions that return lengths only.

Cases: null text counts as the empty text (0 bytes, 0 tokens, not over the limit); texts of any length are cut at safe
places, never truncated; repeated rows give repeated results; a null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .library import loaded
from .pieces import by_bytes

def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    src = src.select(F.col(id_col), F.octet_length("__text").cast("long").alias("n_bytes"), "__text")
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for whole in batches:
            for b in by_bytes(whole, 2):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces.counts(b.column(2)), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
