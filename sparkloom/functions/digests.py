"""Digests of tables that don't depend on the order of rows.

The SHA-256 digests of the rows are added up as numbers modulo 2^256. Addition is exact and merges in any order, so it is an
ordinary sum with partial aggregates: eight limbs of 32 bits, as decimals. A repeated row counts as often as it occurs,
which a sum without carry (exclusive or) would lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS, BITS = 8, 32


def row_digest(columns: list[str]) -> Column:
    """The digest of a row as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


def limb_sums(digest: Column) -> Column:
    """Aggregate: the sums of each limb of hexadecimal digests, the lowest first."""
    limb = lambda i: F.conv(F.substring(digest, 1 + 8 * (LIMBS - 1 - i), 8), 16, 10).cast("decimal(38,0)")
    return F.array(*[F.coalesce(F.sum(limb(i)), F.lit(0).cast("decimal(38,0)")) for i in range(LIMBS)])


def carried(df: DataFrame, sums: str, name: str) -> DataFrame:
    """The total of limb sums modulo 2^256, as 64 hexadecimal digits in a column of its own."""
    base, d = F.lit(1 << BITS).cast("decimal(20,0)"), df.withColumn("__carry", F.lit(0).cast("decimal(38,0)"))
    for i in range(LIMBS):  # a limb's carry is worked out once for the next one
        d = d.withColumn("__all", (F.col(sums)[i] + F.col("__carry")).cast("decimal(38,0)")).withColumn(f"__limb{i}", F.pmod("__all", base).cast("long"))
        d = d.withColumn("__carry", ((F.col("__all") - F.col(f"__limb{i}")) / base).cast("decimal(38,0)"))
    digits = F.lower(F.concat(*[F.lpad(F.hex(f"__limb{i}"), 8, "0") for i in reversed(range(LIMBS))]))
    return d.withColumn(name, digits).drop("__carry", "__all", *[f"__limb{i}" for i in range(LIMBS)])


def multiset_digest(df: DataFrame, digest: Column, extra: str = "", by: list[str] = ()) -> DataFrame:
    """by, n and digest of the rows of each group (of all rows: one row): SHA-256 of extra, their number and the sum of their
    digests, parted by slashes."""
    keys = [F.col(f"`{b}`") for b in by]
    total = (df.groupBy(*keys) if by else df).agg(F.count(F.lit(1)).alias("n"), limb_sums(digest).alias("__sums"))
    out = carried(total, "__sums", "__total")
    return out.select(*keys, "n", F.sha2(F.concat_ws("/", F.lit(extra), F.col("n").cast("string"), "__total"), 256).alias("digest"))
