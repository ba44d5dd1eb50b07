"""Packing by power-of-two decomposition: no sequence holds tokens of two documents.

A document of n tokens is cut into as many pieces of `length` tokens as it fills and, for the rest, into one piece for
each bit of its length, longest first. Each piece is a sequence of its own, without padding; sequences of equal length
belong to one bucket, from which training draws batches of equal shape. So padding is zero.

Pieces are made for whole slices of rows at once.

Cases: null text counts as the empty text and so makes one piece that holds only the end id; texts of any length are
encoded whole; equal rows are packed each on its own, and so are rows with a null id; an empty table gives no pieces; columns of the input other than
the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .library import loaded
from .pieces import binaries, by_bytes

#: Groups of documents that are numbered on their own; their totals, so many rows, are what is broadcast.
SLOTS = 4096


def decomposed(n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of n tokens each, in order: the document, number, start and length of every piece."""
    full, rest = n // length, n % length
    bits = np.arange(length.bit_length() - 2, -1, -1)
    row, column = np.nonzero(rest[:, None] >> bits & 1)
    count = full + np.bincount(row, minlength=len(n))
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.full(len(doc), length)
    size[piece >= full[doc]] = 1 << bits[column]
    end = np.cumsum(size)
    return doc, piece, end - size - np.repeat(np.cumsum(n) - n, count), size


def pieces(df: DataFrame, path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, salt, piece, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens, for every piece."""
    if length & (length - 1) or length < 1:
        raise ValueError("the length of a sequence must be a power of two")
    bounded_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = loaded(path), 0
        for whole in batches:
            for b in by_bytes(whole, 1):
                flat, n = encode.ids(b.column(1))
                n = n + 1
                ids = np.full(n.sum(), end_id, np.uint32)
                held = np.ones(len(ids), bool)
                held[np.cumsum(n) - 1] = False
                ids[held] = flat
                doc, piece, start, size = decomposed(n, length)
                columns = [b.column(0).take(pa.array(doc)), pa.array(row + doc), pa.array(piece), pa.array(start), pa.array(size), binaries(ids, size), pa.array(n[doc])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "salt", "piece", "start", "length", "ids", "doc_tokens"])
                row += b.num_rows

    return src.mapInArrow(run, "doc_id long, salt long, piece long, start long, length long, ids binary, doc_tokens long")


def numbered(found: DataFrame) -> DataFrame:
    """Adds sequence_id, gapless from 0, and offset to pieces.

    Pieces are dealt to a fixed number of slots by document and row; each slot is numbered on its own from where the
    totals of those before it end. The pieces are checkpointed first: what has been numbered can't change when an
    executor is lost.
    """
    found = cut(found.withColumn("__slot", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(SLOTS)).cast("int")))
    totals = found.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = totals.select("__slot", (F.sum("__n").over(Window.orderBy("__slot")) - F.col("__n")).alias("__from"))
    in_slot = Window.partitionBy("__slot").orderBy("doc_id", "salt", "start", "__part")
    return (
        found.withColumn("__part", F.spark_partition_id())
        .withColumn("__k", F.row_number().over(in_slot) - 1)
        .join(F.broadcast(before), "__slot")
        .withColumn("sequence_id", (F.col("__from") + F.col("__k")).cast("long"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("__slot", "__part", "__k", "__from", "salt", "piece")
    )


def packed(df: DataFrame, path: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """op5: where every piece of every document lies, with the CRC-32 of its ids."""
    found = pieces(df, path, end_id, length)
    found = found.select("doc_id", "salt", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return numbered(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.log2("length").cast("int").alias("bucket"))
