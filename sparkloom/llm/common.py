"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cutting lineage: spark.checkpoint.dir where the cluster names one; a local one only for a local master,
    as in tests, since the machines of a cluster wouldn't see each other's."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
    return sc.getCheckpointDir()


#: Bytes of an Arrow batch to Python, unless the session sets its own bound.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the bound that Spark has by default (64 MB), which counts twice or more in a task: texts fill it."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors don't cost a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table beside the checkpoints and read again, with the table's path: unlike a checkpoint, a reader
    takes only the columns it needs. The caller lets it go with `forget`."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that `stored` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, taken: list[str]) -> str:
    """name, behind as many underscores as no column of taken has (Spark's names don't tell case)."""
    name, taken = f"__{name}", {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Edges of a partition of the component search.
EDGES = 50_000


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to: it does so only when the driver's JVM happens
    to collect garbage, and until then every finished phase takes up disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def connected_components(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    max_rounds: int = 60,
    on_round: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Alternates large-star and small-star contractions (Kiveris et al., "Connected components in MapReduce and
    beyond", 2014): a logarithmic number of rounds, each two shuffles over at most as many edges as the last, with
    a partially aggregated minimum per node and a sort-merge join that adaptive execution may split when one node
    holds many edges. Each round is checkpointed. No edge, label or component reaches the driver; only a count and a
    checksum do.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    # every edge points from its larger node to its smaller one
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, parts = None, max(1, e.rdd.getNumPartitions())
    for i in range(max_rounds):
        # a round has as many tasks as its edges are worth; their number never grows
        e = cut(_star(_star(e, large=True), large=False).coalesce(parts))
        stamp = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        parts = max(1, min(parts, -(-stamp[0] // EDGES)))
        if on_round:
            on_round(i, stamp[0])
        if tuple(stamp) == seen:
            break
        seen = tuple(stamp)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    sweep(edges.sparkSession)
    # settled: every edge is (node, root)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One contraction. large: link every larger neighbour to the least of the neighbourhood; else every smaller one."""
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
        out = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = e.join(least, e.u == least.k)
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def with_text(df: DataFrame, keep: list[str] | None, text: str = "text") -> tuple[DataFrame, list[T.StructField], int]:
    """The columns to keep (doc_id as long unless named) and, unless it is one of them, the text, all under names that
    can't clash or be misread; the fields of the columns kept; and where the text stands (nulls not filled)."""
    bounded_batches(df.sparkSession)
    fields = [T.StructField("doc_id", T.LongType())] if keep is None else [next(f for f in df.schema.fields if f.name == c) for c in keep]
    columns = [F.col(f"`{f.name}`").cast(f.dataType) for f in fields]
    own = next((f for f in df.schema.fields if f.name == text), None)
    at = fields.index(own) if own in fields and isinstance(own.dataType, T.StringType) else len(fields)
    if at == len(fields):
        columns.append(F.col(f"`{text}`").cast("string"))
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), fields, at
