"""Blocks of HTML pages, in column expressions.

Comments, scripts, styles and what is for browsers without scripts go first. Then a page is split before each tag that
begins a block; a part that holds its own end tag is a block, and what stands between is its text. So a block that begins
inside another takes its place, and one that is never closed is none.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements whose text is a block, and elements that are dropped with all they hold.
BLOCKS, DROPPED = ("p", "li", "blockquote", "pre", "td", "h[1-6]"), ("script", "style", "noscript")
_NAME = "|".join(BLOCKS)
_TAG = r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>"


def entities(c: Column) -> Column:
    """Text with character references read: decimal, hexadecimal, and the names of HTML 4 that end in a semicolon. A number
    that is no character becomes U+FFFD."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int")).when(name.startswith("#"), F.substring(name, 2, 7).cast("int"))
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(number.isNull(), names[name]).when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")
        return F.coalesce(F.when(name != "", F.concat(char, F.regexp_replace(part, r"^[^;]*;", ""))), F.concat(F.lit("&"), part))

    parts = F.split(c, "&", -1)
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), read), ""))).otherwise(c)


def _untagged(c: Column) -> Column:
    return F.regexp_replace(c, _TAG, " ")


def _read(c: Column) -> Column:
    """Text without tags as it reads: references resolved, runs of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(entities(c), r"(?U)\s+", " "))


def html_blocks(df: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, block, kind, text, heading, title of each block of text: heading is the last one that isn't empty up to the block,
    title that of the page or else its first heading. Pages are told apart by their rows, whatever their ids."""
    page = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"(?s)<!--.*?(?:-->|\z)", " ")
    page = F.regexp_replace(page, rf"(?is)<({'|'.join(DROPPED)})\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    title = r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"
    d = df.select(F.col(f"`{id_col}`").alias("__id"), F.monotonically_increasing_id().alias("__row"), page.alias("__page"))
    parts = F.split(F.regexp_replace("__page", title, " "), rf"(?i)(?=<(?:{_NAME})(?:[\s/][^>]*)?>)", -1)
    # each step is a column of its own, which the next one may use several times
    d = d.select("__id", "__row", _untagged(F.regexp_extract("__page", title, 1)).alias("__title"), F.posexplode(parts).alias("__at", "__part"))
    body = F.regexp_extract("__part", rf"(?is)^<({_NAME})(?:[\s/][^>]*)?>(.*?)</\1\s*>", 2)
    d = d.select("__id", "__row", "__title", "__at", F.lower(F.regexp_extract("__part", r"^<([A-Za-z0-9]+)", 1)).alias("__name"), _untagged(body).alias("__raw"))
    # what surely is empty goes now; what only reads so goes last, since a filter would be done before the text is read
    d = d.where(F.col("__raw").rlike(r"\S")).select("__id", "__row", "__title", "__at", "__name", _read(F.col("__raw")).alias("text"))
    some = F.col("text") != ""
    d = d.withColumn("__head", F.when(some & F.col("__name").rlike("^h[1-6]$"), F.col("text")))
    so_far, whole = Window.partitionBy("__row").orderBy("__at"), Window.partitionBy("__row").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.select(
        F.col("__id").alias(id_col), (F.sum(some.cast("long")).over(so_far) - 1).alias("block"), F.when(F.col("__head").isNotNull(), F.concat(F.lit("heading_"), F.substring("__name", 2, 1))).otherwise(F.col("__name")).alias("kind"),
        "text", F.coalesce(F.last("__head", ignorenulls=True).over(so_far), F.lit("")).alias("heading"), F.coalesce(F.nullif(_read(F.col("__title")), F.lit("")), F.first("__head", ignorenulls=True).over(whole), F.lit("")).alias("title"),
    ).where("text <> ''")
