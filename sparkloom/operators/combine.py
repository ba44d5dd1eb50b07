"""Joins with declared cardinality, and concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import need, one_of
from ..plans.errors import ParameterError

CARDINALITY = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


def _unique(df: DataFrame, key: str, side: str, cardinality: str) -> DataFrame:
    """The rows, or an error at run time if a key occurs twice. Missing keys count as one key."""
    counts = df.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    worst = counts.agg(F.max("__n").alias("__worst"))
    said = F.when(F.col("__worst") > 1, F.raise_error(F.lit(f"{cardinality}: the {side} side repeats a key"))).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(worst.select(said.alias("__ok")))).where("__ok").drop("__ok")  # one row


def combine(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", cardinality: str = "many_to_one", suffix: str = "_right") -> DataFrame:
    """left, inner, outer, right or lookup join on one key, missing keys matching; concat appends.

    Columns of both sides with one name: the right one gets the suffix. Keys of one name become one column.
    """
    one_of(how, ("left", "inner", "outer", "right", "lookup", "concat"), "method")
    if how == "concat":
        return concat(left, right)
    if how == "lookup":
        how, cardinality = "left", "many_to_one"
    one_of(cardinality, CARDINALITY, "cardinality")
    need(left, left_key)
    need(right, right_key)
    if cardinality.startswith("one"):
        left = _unique(left, left_key, "left", cardinality)
    if cardinality.endswith("one"):
        right = _unique(right, right_key, "right", cardinality)
    same = left_key == right_key
    names = {c: c + suffix if c in left.columns and not (same and c == right_key) else c for c in right.columns}
    r = right.select(*[F.col(f"`{c}`").alias(f"__r_{i}") for i, c in enumerate(right.columns)])
    rk = F.col(f"__r_{right.columns.index(right_key)}")
    joined = left.join(r, F.col(f"`{left_key}`").eqNullSafe(rk), {"outer": "full"}.get(how, how))
    out: list[Column] = [F.coalesce(F.col(f"`{c}`"), rk).alias(c) if same and c == left_key else F.col(f"`{c}`") for c in left.columns]
    out += [F.col(f"__r_{i}").alias(names[c]) for i, c in enumerate(right.columns) if not (same and c == right_key)]
    return joined.select(*out)


def joined_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """rows: how many rows an outer join on the keys would have, from counts of keys alone."""
    a = left.groupBy(F.col(f"`{left_key}`").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(F.col(f"`{right_key}`").alias("k2")).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full")
    return j.agg(F.coalesce(F.sum(F.coalesce("a", F.lit(1)) * F.coalesce("b", F.lit(1))), F.lit(0)).cast("long").alias("rows"))


def concat(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of both; columns of either, missing ones null. A column of two types becomes text, numbers double."""
    numeric = (T.NumericType,)
    for c in set(top.columns) & set(bottom.columns):
        a, b = top.schema[c].dataType, bottom.schema[c].dataType
        if a != b:
            kind = "double" if isinstance(a, numeric) and isinstance(b, numeric) else "string"
            top, bottom = top.withColumn(c, F.col(f"`{c}`").cast(kind)), bottom.withColumn(c, F.col(f"`{c}`").cast(kind))
    return top.unionByName(bottom, allowMissingColumns=True)


def samples_with_assets(samples: DataFrame, assets: DataFrame, analysis: DataFrame) -> DataFrame:
    """Samples, their assets, and the analysis of each digest where there is one."""
    return samples.join(assets, "asset_id").join(analysis, "sha256", "left")


def searchable_chunks(embeddings: DataFrame, chunks: DataFrame, assets: DataFrame, model: str, asset_ids: list[str] | None = None) -> DataFrame:
    """Embedded chunks of active assets for one model; at most 500 assets may be named."""
    if asset_ids is not None and len(asset_ids) > 500:
        raise ParameterError("500 assets at most")
    a = assets.where("state = 'active'")
    if asset_ids is not None:
        a = a.where(F.col("asset_id").isin(asset_ids))
    return embeddings.where(F.col("model") == model).join(chunks, "chunk_id").join(a, "asset_id")


def with_reason(candidates: DataFrame, decisions: DataFrame, reason: str) -> DataFrame:
    """Candidates that have a decision with a reason (EXISTS)."""
    return candidates.join(decisions.where(F.col("reason") == reason).select("candidate_id"), "candidate_id", "left_semi")


def unindexed(documents: DataFrame, indexes: DataFrame) -> DataFrame:
    """Active documents without an index: what keeps a bundle from being complete."""
    return documents.where("state = 'active'").join(indexes.select("asset_id"), "asset_id", "left_anti")
