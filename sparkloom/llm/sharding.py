"""Sharding by fixed virtual slots and a versioned slot-to-shard map, with DataFrame functions only.

A record is hashed into one of SLOTS virtual slots by its id and text. The bytes of each slot are summed, which is all
that ever leaves the data: SLOTS rows, whatever the input. Slots are then dealt to shards, the heaviest first, each to
the shard with the fewest bytes so far. The map from slot to shard is stored with a version; rebalancing for more
shards edits it: slots move to the new shards alone.

Equal rows go through the numbering as one row with a count, so neither a document that fills a third of the table nor a
slot full of it meets in one task row by row.

Cases: null text has size 16 and the CRC-32 of no bytes; a null id hashes like any other value; equal rows go to one
slot and are numbered there in turn; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

SLOTS = 4096
#: Equal rows that are written out again from one row with a count.
RUN = 65_536
#: What a record counts besides the bytes of its text.
ROW_BYTES = 16


def records(df: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return (
        df.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("__raw"))
        .select("doc_id", (F.octet_length("__raw") + ROW_BYTES).cast("long").alias("size"), F.crc32("__raw").alias("text_crc32"))
        .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))
    )


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, n for every slot, also those without records."""
    found = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "n"])


def _deal(slots: Column, loads: Column) -> Column:
    """Gives each slot in turn to the lightest shard: struct(loads, shards)."""

    def put(acc: Column, slot: Column) -> Column:
        k = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i + 1 == k, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["shards"], F.array(k - 1)).alias("shards"),
        )

    return F.aggregate(slots, F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("shards")), put)


def slot_map(weights: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """version, virtual_slot, shard, bytes, n: the heaviest slot first, to the shard with the fewest bytes so far.

    One row of SLOTS entries holds the whole state, so this is a single small task at any size of the input.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("bytes", F.col("virtual_slot").alias("slot"), "n")), asc=False).alias("s"))
    dealt = one.select("s", _deal(F.col("s"), F.expr(f"array_repeat(cast(0 as bigint), {shards})")).alias("d"))
    return dealt.select(F.explode(F.arrays_zip("s", F.col("d.shards").alias("k"))).alias("x")).select(
        F.lit(version).alias("version"), F.col("x.s.slot").alias("virtual_slot"), F.col("x.k").alias("shard"), F.col("x.s.bytes").alias("bytes"), F.col("x.s.n").alias("n")
    )


def grow(current: DataFrame, shards: int, more: int = 1) -> DataFrame:
    """The next version of a map for `more` new shards.

    Each old shard gives its lightest slots that hold anything, up to its part of the bytes that the new shards need, so
    that loads end close to even; empty slots stay and nothing moves between old shards.
    """
    part = more / (shards + more)
    light = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    w = current.withColumn("__sum", F.sum("bytes").over(light)).withColumn("__all", F.sum("bytes").over(Window.partitionBy("shard")))
    w = w.withColumn("__go", (F.col("bytes") > 0) & (F.col("__sum") <= F.col("__all") * part))
    turn = F.row_number().over(Window.partitionBy("__go").orderBy(F.col("bytes").desc(), "virtual_slot")) - 1
    new = F.lit(shards) + F.pmod(turn, F.lit(more))
    return w.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("__go"), new).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n")


def store_map(current: DataFrame, path: str) -> None:
    """Adds a version to the stored map."""
    current.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest if none is named."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "n")


def place(recs: DataFrame, current: DataFrame) -> DataFrame:
    """Adds shard and slot, the record's place in its shard (gapless from 0), to records.

    Places run through the slots of a shard in order; each slot is numbered on its own, equal records by their count.
    """
    run = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")
    start = current.select("virtual_slot", "shard", run.alias("__from"))
    own = ["virtual_slot", "doc_id", "size", "text_crc32"]
    counted = recs.groupBy(*own).agg(F.count(F.lit(1)).alias("__times"))
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__first", F.coalesce(F.sum("__times").over(before), F.lit(0))).join(F.broadcast(start), "virtual_slot")
    several = F.col("__times") > RUN
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(RUN).cast("long"))))
    runs = runs.where(~several).unionByName(runs.where(several).repartition(*own, "__run"))
    last = F.least(F.col("__run") + RUN, F.col("__times")) - 1
    out = runs.withColumn("__k", F.explode(F.sequence("__run", last))).withColumn("slot", (F.col("__from") + F.col("__first") + F.col("__k")).cast("long"))
    return out.select(*recs.columns, "shard", "slot")


def sharded(df: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """op4: every document's shard and place, by the law of near equal bytes.

    The slot map goes to path (a new folder beside the checkpoints unless named) as version 1, with version 2 for one
    more shard; documents are placed by version 1 as it is read from there, and next_shard is what version 2 says.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    recs = records(df, slots)
    store_map(slot_map(slot_bytes(recs, slots), shards), path)
    store_map(grow(load_map(spark, path, 1), shards), path)
    moved = load_map(spark, path, 2).select("virtual_slot", F.col("shard").alias("next_shard"))
    placed = place(recs, load_map(spark, path, 1)).join(F.broadcast(moved), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")
