"""Chunks of documents: windows of tokens over units of blocks, with a name that follows from where they come from."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import one_of
from ..plans.errors import ParameterError

TOKEN = re.compile(r"\w+|[^\w\s]")
HEADING = re.compile(r"#{1,6}\s+(.+?)\s*$")
STRATEGIES = ("token", "paragraph", "heading", "recursive")


class Block(NamedTuple):
    heading: str
    text: str


class Chunk(NamedTuple):
    """block_start, block_end: the first and last block it has a part of; char_start, char_end: in the text of its unit."""

    heading: str
    n_tokens: int
    text: str
    block_start: int
    block_end: int
    char_start: int
    char_end: int


def text_blocks(text: str) -> list[Block]:
    """The headings and paragraphs of Markdown or plain text, with the heading above; lines of a paragraph become one."""
    lines = text.splitlines()
    heads = [HEADING.match(x) for x in lines]
    out, heading, at = [], "", 0
    while at < len(lines):
        end = at + 1
        if heads[at]:
            heading = heads[at][1].strip()
            out.append(Block(heading, heading))
        elif lines[at].strip():
            while end < len(lines) and lines[end].strip() and not heads[end]:
                end += 1
            out.append(Block(heading, " ".join(x.strip() for x in lines[at:end])))
        at = end
    return out


def units(blocks: list[Block], strategy: str, size: int) -> list[int]:
    """Where units begin: token: all blocks are one; paragraph: each is; heading: those below one heading; recursive:
    neighbours as far as they fit into a window together."""
    if strategy == "token":
        return [0] if blocks else []
    if strategy == "paragraph":
        return list(range(len(blocks)))
    if strategy == "heading":
        return [i for i, b in enumerate(blocks) if not i or blocks[i - 1].heading != b.heading]
    # places after so many tokens; a unit goes on to the last block that ends within a window of its beginning
    ends = list(accumulate(len(TOKEN.findall(b.text)) for b in blocks))
    out, at = [], 0
    while at < len(blocks):
        out.append(at)
        at = max(at + 1, bisect_right(ends, (ends[at - 1] if at else 0) + size))
    return out


def windows(marks: list[re.Match], size: int, overlap: int, sentences: bool) -> Iterator[tuple[int, int]]:
    """(first, end) of windows of tokens, each sharing `overlap` of them with the one before. sentences: a window that isn't
    the last ends behind its last sentence end, if one lies in its second half and past the overlap."""
    stops = [i for i, m in enumerate(marks) if m[0] in ".!?"] if sentences else []
    first, n = 0, len(marks)
    while first < n:
        end = min(first + size, n)
        if end < n and (k := bisect_left(stops, end) - 1) >= 0 and stops[k] > first + max(overlap, size // 2):
            end = stops[k] + 1
        yield first, end
        first = end - overlap if end < n else n


def chunk_spans(text: str, strategy: str, size: int, overlap: int) -> list[Chunk]:
    blocks, out = text_blocks(text), []
    for a, b in pairwise([*units(blocks, strategy, size), len(blocks)]):
        body = "\n\n".join(x.text for x in blocks[a:b])
        ends = [e - 2 for e in accumulate(len(x.text) + 2 for x in blocks[a:b])]
        starts = [e - len(x.text) for e, x in zip(ends, blocks[a:b], strict=True)]
        marks = list(TOKEN.finditer(body))
        for first, end in windows(marks, size, overlap, strategy == "recursive"):
            low, high = marks[first].start(), marks[end - 1].end()
            head, tail = a + bisect_right(ends, low), a + bisect_left(starts, high) - 1
            out.append(Chunk(blocks[head].heading, end - first, body[low:high], head, tail, low, high))
    return out


def chunk_text(text: str, strategy: str, size: int, overlap: int) -> list[tuple[str, int, str]]:
    """(heading, tokens, text) of each chunk."""
    return [c[:3] for c in chunk_spans(text, strategy, size, overlap)]


def name_uuid(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a text in a namespace: SHA-1 with four bits for the version and two for the kind."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    kind = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), kind, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_name(asset: Column, source: Column, strategy: str, size: int, overlap: int, number: Column, text: Column) -> Column:
    """What names a chunk, as JSON: asset, digest of its source, parameters, number and digest of the chunk."""
    parameters = f'{{"chunk_size": {size}, "overlap": {overlap}, "strategy": "{strategy}"}}'
    quoted = F.regexp_extract(F.to_json(F.array(asset.cast("string"))), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("["), quoted, F.lit(', "'), source, F.lit(f'", {parameters}, '), number.cast("string"), F.lit(', "'), F.sha2(text, 256), F.lit('"]'))


def chunks(df: DataFrame, id_col: str, text: str = "text", strategy: str = "token", size: int = 256, overlap: int = 32) -> DataFrame:
    """id, chunk, chunk_id, heading, n_tokens, text, block_start, block_end, char_start, char_end, by strategy: token,
    paragraph, heading or recursive. chunk_id is a name-based UUID: the same document and parameters give the same."""
    one_of(strategy, STRATEGIES, "strategy")
    out = _chunked(df, id_col, text, [strategy], size, overlap, True)
    name = chunk_name(F.col(f"`{id_col}`"), F.col("source"), strategy, size, overlap, F.col("chunk"), F.col("text"))
    return out.select(id_col, "chunk", name_uuid(name).alias("chunk_id"), "heading", "n_tokens", "text", "block_start", "block_end", "char_start", "char_end")


def _chunked(df: DataFrame, id_col: str, text: str, strategies: list[str], size: int, overlap: int, texts: bool) -> DataFrame:
    """strategy, id, source (the text's digest), chunk and what chunk_spans gives, its text if asked for; a frame of at most
    a few texts at a time."""
    if not 32 <= size <= 4096 or not 0 <= overlap < size:
        raise ParameterError("32 to 4096 tokens, overlap below that")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`"), F.sha2(body, 256).alias("__source"), body.alias("__text"))
    kind = src.schema[id_col].dataType.simpleString()
    names = ["strategy", id_col, "source", "chunk", "heading", "n_tokens", "text", "block_start", "block_end", "char_start", "char_end"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 256):
                own = p.iloc[at : at + 256]
                rows = [
                    (s, i, source, k, *(c if texts else c._replace(text=None)))
                    for i, source, x in zip(own[id_col], own["__source"], own["__text"], strict=True)
                    for s in strategies
                    for k, c in enumerate(chunk_spans(x, s, size, overlap))
                ]
                yield pd.DataFrame(rows, columns=names)

    return src.mapInPandas(run, f"strategy string, `{id_col}` {kind}, source string, chunk long, heading string, n_tokens long, text string, block_start long, block_end long, char_start long, char_end long")


def compare_strategies(df: DataFrame, id_col: str, text: str = "text", size: int = 256, overlap: int = 32) -> DataFrame:
    """strategy, chunks, mean_tokens, max_tokens: all four in one pass over the texts."""
    each = _chunked(df, id_col, text, list(STRATEGIES), size, overlap, False)
    return each.groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.avg("n_tokens").alias("mean_tokens"), F.max("n_tokens").alias("max_tokens"))
