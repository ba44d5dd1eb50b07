"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Cases: an empty table passes through every stage; null texts are rejected by language ID; repeated rows are
one group of copies, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import langid, near, packing, toxicity
from sparkloom.llm.common import cut, ensure_checkpoint_dir, tokenizer_path, unused

#: Documents whose language holds a smaller share of their letters are rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of no main language."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    lang, share = unused("lang", docs.columns), unused("share", docs.columns)
    out = langid.predict(docs, langid.fit(docs), docs.columns, (lang, share))
    return out.where((F.col(lang) != "und") & (F.col(share) >= LEAST_SHARE)).select(own)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents."""
    labels, own = spark.read.parquet(f"{sf_dir}/labels.parquet"), [F.col(f"`{c}`") for c in docs.columns]
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return toxicity.score(docs, chain, keep=docs.columns, prefix=prefix).where(f"not {prefix}toxic").select(own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the one with the smallest id, of each group of near copies: texts linked by sharing at least 80 %
    of their distinct 5-word shingles. Only texts decide: a row with a null id stays unless a row with an id is its near
    copy, and unlike texts with one id all stay."""
    mark, turn, left = (unused(name, docs.columns) for name in ("class", "turn", "left"))
    found = cut(near.components(docs))
    # of each component the class with the smallest id stays, and of each class one row; texts are shuffled once
    ids = docs.select(near.text_class().alias("class"), "doc_id").groupBy("class").agg(F.min("doc_id").alias("id")).join(found, "class")
    ids = cut(ids)
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "class")).alias("first"))
    gone = ids.join(first, "component").where("class <> first.class").select(F.col("class").alias(mark))
    copies = Window.partitionBy(mark).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    # one row of each class first: of a class that many rows have, each task passes one on. (As an outer join, since an
    # anti join would be done below the window, and then all rows would be dealt by class.)
    rows = near.with_class(docs, mark).withColumn(turn, F.row_number().over(copies)).where(F.col(turn) == 1)
    rows = rows.join(cut(gone).withColumn(left, F.lit(True)), mark, "left").where(F.col(left).isNull())
    return rows.select([F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of powers of two tokens."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("language ID", language), ("toxicity", toxic), ("SimHash near-dedup", near_copies), ("packing", pack)]
#: SQL can't say language ID, toxicity, near copies or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
