"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, codes, counts, hnsw, imatch, langid, licenses, packing, sharding, simhash, toxicity, whitening
from .common import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.selectExpr("cast(doc_id as bigint) doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), 40)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), bits=3, shingle=3)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprinted(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """Lloyd's rounds by brute force: every part against every entry, unrolled."""

    def nearest(book: str) -> str:
        """The nearest entry and its distance, ties to the lower index."""
        return f"""(select vec_id, part, m % 64 as entry, m // 64 as dist from (
            select vec_id, part, min(dist * 64 + entry) as m from (
                select e.vec_id, e.part, c.entry, sum((e.x - c.x) * (e.x - c.x))::bigint as dist
                from e join {book} c on c.part = e.part and c.pos = e.pos group by all) group by all))"""

    def moved(book: str, near: str) -> str:
        return f"""(select c.part, c.pos, c.entry, coalesce(n.x, c.x) as x from {book} c left join (
            select e.part, e.pos, a.entry, floor(sum(e.x) / count(*))::bigint as x
            from e join {near} a on a.vec_id = e.vec_id and a.part = e.part group by all) n
            on n.part = c.part and n.pos = c.pos and n.entry = c.entry)"""

    return f"""
        with kept as (
            select vec_id, label, embedding as v, len(embedding) // 16 as w from embeddings
            where embedding is not null and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0),
        numbered as (select vec_id, w, unnest(v) as y, unnest(range(len(v))) as i from kept),
        e as materialized (select vec_id, i // w as part, i % w as pos, floor(256 * y::double)::bigint as x from numbered),
        seed as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < 64),
        c0 as materialized (select part, pos, entry, x from e join seed using (vec_id)),
        a0 as materialized {nearest("c0")},
        c1 as materialized {moved("c0", "a0")},
        a1 as materialized {nearest("c1")},
        c2 as materialized {moved("c1", "a1")},
        a2 as materialized {nearest("c2")},
        book as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as sha from c2),
        coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a2 group by vec_id)
        select c.vec_id, c.code, c.error, sum(c.error) over (partition by k.label)::bigint as label_error, book.sha as codebooks_sha256
        from coded c join kept k using (vec_id), book"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_bpe, op2_token_counts, op3_nearest, op4_sharding, op5_packing, op6_toxicity, op7_simhash, op8_language, op9_licenses, op10_embedding_dedup,
        op11_vector_codes, op12_fingerprints, op13_whitening,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL can say op11 whole; tests/llm holds each of the others against brute force."""
    return {"op11_vector_codes": _codes_sql()}
