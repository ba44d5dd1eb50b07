"""Documents: parsing, cleaning, chunking, vectors, retrieval and small learned models."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalar import need, one_of, safe_regex
from ..plans.errors import ParameterError
from ..plans.plugins import EmbeddingProvider
from .chunking import STRATEGIES, chunk_spans, chunk_text, chunks, compare_strategies, text_blocks  # noqa: F401  part of this module's interface
from .markup import html_blocks

#: One token is a run of word characters or a single mark.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 0)


def _normal(c: Column, form: str) -> Column:
    """Unicode normal form; the function is made when used, since it needs a session."""

    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize(form, t) for t in text])

    return F.pandas_udf(run, "string")(c)


def clean(df: DataFrame, column: str, form: str | None = "NFC", find: str | None = None, replacement: str = "", regex: bool = False, collapse: bool = True) -> DataFrame:
    """Unicode normal form, find and replace (literal or a linear-time pattern); with collapse, runs of white space but
    line ends become a space, over two line ends two, and none stays at the ends."""
    need(df, column)
    c = F.col(f"`{column}`")
    if form:
        c = _normal(c, one_of(form, ("NFC", "NFKC", "NFD", "NFKD"), "form"))
    if find:
        c = F.regexp_replace(c, safe_regex(find), replacement.replace("$", "\\$")) if regex else F.replace(c, F.lit(find), F.lit(replacement))
    if collapse:
        c = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\n]+", " "), r"\n{3,}", "\n\n")
        c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return df.withColumn(column, c)


#: Frequent words by which a short text's language is guessed.
FREQUENT = {
    "en": "the and of to in is that it for was with on are as be this".split(),
    "de": "der die und das ist nicht ein zu mit von auf den sich des dem".split(),
    "fr": "le la les et des une est pas que pour dans qui sur avec au".split(),
    "es": "el los las que una por con para es del se no su lo como".split(),
    "it": "il che di una per non con sono gli della nel alla anche come".split(),
    "pt": "que não uma para com os as dos por mais como mas foi ao das".split(),
}


def stopword_language(c: Column, least: int = 3) -> Column:
    """The language with most distinct frequent words in the text, if at least `least`; else und. Ties: the earlier one."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}]+"), 0))
    hits = [F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))) for ws in FREQUENT.values()]
    best = F.greatest(*hits)
    out = F.lit("und")
    for lang, h in reversed(list(zip(FREQUENT, hits, strict=True))):
        out = F.when(h == best, lang).otherwise(out)
    return F.when(best >= least, out).otherwise("und")


def quality(df: DataFrame, text: str = "text", blocks: str = "\n") -> DataFrame:
    """Adds chars, words, tokens, duplicate_blocks and language."""
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    b = F.filter(F.split(c, re.escape(blocks), -1), lambda x: F.trim(x) != "")
    return df.withColumns({"chars": F.length(c).cast("long"), "words": F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")).cast("long"), "tokens": F.size(tokens(c)).cast("long"), "duplicate_blocks": (F.size(b) - F.size(F.array_distinct(b))).cast("long"), "language": stopword_language(c)})


def word_windows(df: DataFrame, id_col: str, text: str = "text", size: int = 420, overlap: int = 64) -> DataFrame:
    """id, chunk, start, n, text: windows of words, each sharing `overlap` words with the one before."""
    if not 32 <= size <= 4096 or not 0 <= overlap < size:
        raise ParameterError("32 to 4096 words, overlap below that")
    words = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"\s+"), lambda x: x != "")
    d = df.select(F.col(f"`{id_col}`"), words.alias("w")).where(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(float(step))).cast("int"))
    d = d.select(id_col, "w", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("chunk", "start"))
    return d.select(id_col, F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.least(F.lit(size), F.size("w") - F.col("start")).cast("long").alias("n"), F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


def markdown_blocks(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """id, block, kind, text, heading, line: paragraphs and ATX headings of Markdown or plain text."""
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    d = df.select(F.col(f"`{id_col}`"), F.posexplode(lines).alias("line", "raw"))
    w = Window.partitionBy(id_col).orderBy("line")
    head = F.regexp_extract("raw", r"^#{1,6}\s+(.*?)\s*#*$", 1)
    d = d.withColumn("is_head", F.col("raw").rlike(r"^#{1,6}\s+\S")).withColumn("blank", F.trim("raw") == "")
    start = F.col("is_head") | F.col("blank") | F.coalesce(F.lag(F.col("is_head") | F.col("blank")).over(w), F.lit(True))
    d = d.withColumn("g", F.sum(start.cast("int")).over(w)).withColumn("heading", F.last(F.when(F.col("is_head"), head), ignorenulls=True).over(w))
    kept = d.where("not blank").groupBy(id_col, "g").agg(F.min("line").alias("line"), F.max("heading").alias("heading"), F.max("is_head").alias("h"), F.sort_array(F.collect_list(F.struct("line", "raw"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.trim(r["raw"])), " ")
    block = F.row_number().over(Window.partitionBy(id_col).orderBy("line")) - 1
    return kept.select(id_col, block.cast("long").alias("block"), F.when(F.col("h"), F.concat(F.lit("heading_"), F.length(F.regexp_extract(F.get("rows", F.lit(0))["raw"], r"^(#{1,6})", 1)))).otherwise("paragraph").alias("kind"), F.when(F.col("h"), F.col("heading")).otherwise(body).alias("text"), F.coalesce("heading", F.lit("")).alias("heading"), (F.col("line") + 1).cast("long").alias("line"))


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of each paragraph of a DOCX file, with the standard library alone."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{ns}p"):
        style = p.find(f"{ns}pPr/{ns}pStyle")
        text = "".join(t.text or "" if t.tag == f"{ns}t" else "\t" if t.tag == f"{ns}tab" else "" for t in p.iter())
        if text.strip():
            out.append((style.get(f"{ns}val", "") if style is not None else "", text.strip()))
    return out


def pdf_pages(content: bytes, most: int = 10_000) -> list[str]:
    """Text of each page of a PDF; needs pypdf on the workers."""
    import io

    from pypdf import PdfReader

    pages = PdfReader(io.BytesIO(content)).pages
    if len(pages) > most:
        raise ValueError(f"more than {most} pages")
    return [p.extract_text() or "" for p in pages]


def file_blocks(binary: DataFrame) -> DataFrame:
    """path, block, kind, text, heading, page, error of DOCX, PDF, HTML, Markdown and text files (binaryFile rows).

    A file that can't be parsed is one row with an error.
    """

    def parse(path: str, content: bytes) -> list[tuple]:
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix == "docx":
            out, heading = [], ""
            for style, text in docx_paragraphs(content):
                if is_head := style.lower().startswith(("heading", "title")):
                    heading = text
                out.append(("heading" if is_head else "paragraph", text, heading, None))
            return out
        if suffix == "pdf":
            return [("paragraph", re.sub(r"\s+", " ", p).strip(), "", n) for n, page in enumerate(pdf_pages(content), 1) for p in re.split(r"\n\s*\n", page) if p.strip()]
        text = content.decode("utf-8-sig")
        out, heading = [], ""
        for p in re.split(r"\n\s*\n|(?<=\n)(?=#{1,6}\s)", text):
            for i, part in enumerate(re.split(r"(?m)^(#{1,6}\s+.*)$", p)):
                if part.strip():
                    if i % 2:
                        heading = part.lstrip("#").strip()
                    out.append((f"heading_{len(part) - len(part.lstrip('#'))}" if i % 2 else "paragraph", heading if i % 2 else " ".join(part.split()), heading, None))
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    rows += [(path, i, *b, None) for i, b in enumerate(parse(path, content))]
                except Exception as e:  # noqa: BLE001  a broken file is a row with an error
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            d = pd.DataFrame(rows, columns=["path", "block", "kind", "text", "heading", "page", "error"])
            yield d.astype({"block": "Int64", "page": "Int64"})

    src, is_html = binary.select("path", "content"), F.lower("path").rlike(r"\.html?$")
    others = src.where(~is_html).mapInPandas(run, "path string, block long, kind string, text string, heading string, page long, error string")
    pages = src.where(is_html).select("path", F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "").alias("html"))
    none = F.lit(None).cast("string")
    found = html_blocks(pages.where("html is not null"), "path").select("path", "block", "kind", "text", "heading", F.lit(None).cast("long").alias("page"), none.alias("error"))
    broken = pages.where("html is null").select("path", F.lit(None).cast("long").alias("block"), none.alias("kind"), none.alias("text"), none.alias("heading"), F.lit(None).cast("long").alias("page"), F.lit("not UTF-8").alias("error"))
    return others.unionByName(found).unionByName(broken)


def _hashed(features: Counter, dims: int) -> np.ndarray:
    """The first 64 bits of a feature's SHA-256 say where it goes, its ninth byte whether it is added."""
    digests = np.frombuffer(b"".join([hashlib.sha256(f.encode()).digest() for f in features]), np.uint8).reshape(-1, 32)
    at = np.ascontiguousarray(digests[:, :8]).view(">u8").ravel() % dims
    x = 1 + np.log(np.fromiter(features.values(), np.float64, len(features)))
    v = np.bincount(at.astype(np.int64), weights=np.where(digests[:, 8] & 1, x, -x), minlength=dims)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else np.zeros(dims)


def hashed_vectors(df: DataFrame, id_col: str, text: str = "text", dims: int = 384) -> DataFrame:
    """id, vector: words and pairs of neighbours hashed to signed dimensions, 1 + ln(count) each, unit length.

    A text's features are counted where it is read, none is shuffled. Texts that share an id are counted as one; only if
    there are such, texts are brought together by id.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    ids = df.select(F.col(f"`{id_col}`"))
    if not ids.groupBy(F.col(f"`{id_col}`")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
        df = df.repartition(F.col(f"`{id_col}`")).sortWithinPartitions(F.col(f"`{id_col}`"))
    most = max(1, (1 << 19) // dims)  # 4 MB of vectors at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, vectors, features = None, [], [], None

        def out() -> pa.RecordBatch:
            flat = pa.array(np.concatenate(vectors))
            return pa.RecordBatch.from_arrays([pa.array(done, kind), pa.ListArray.from_arrays(pa.array(np.arange(len(done) + 1, dtype=np.int32) * dims), flat)], [id_col, "vector"])

        for b in batches:
            kind = b.column(0).type
            for key, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if features is None or key != done[-1]:
                    if features is not None:
                        vectors.append(_hashed(features, dims))
                        if len(done) >= most:
                            yield out()
                            done, vectors = [], []
                    done.append(key)
                    features = Counter()
                own = line.as_py().split()
                features.update(own)
                features.update(map(" ".join, zip(own, own[1:])))  # noqa: B905  one shorter
        if features is not None:
            vectors.append(_hashed(features, dims))
            yield out()

    schema = StructType([ids.schema[0], StructField("vector", ArrayType(DoubleType()))])
    return df.select(F.col(f"`{id_col}`"), F.array_join(words, " ").alias("__w")).mapInArrow(run, schema)


def embedded_by(chunks: DataFrame, provider: EmbeddingProvider, id_col: str, dims: int) -> DataFrame:
    """id, vector: a plugin's vectors of chunks (columns id and text). A chunk without one, or one of another length or with
    a number that isn't finite, is an error at run time."""
    vectors = provider.embed(chunks.select(F.col(f"`{id_col}`"), "text")).select(F.col(f"`{id_col}`").alias("__id"), F.col("vector").cast("array<double>").alias("__v"))
    d = chunks.select(F.col(f"`{id_col}`")).join(vectors, F.col(f"`{id_col}`") == F.col("__id"), "left")
    sound = F.coalesce((F.size("__v") == dims) & ~F.exists("__v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return d.select(id_col, F.when(sound, F.col("__v")).otherwise(F.raise_error(F.lit(f"a chunk has no vector of {dims} finite numbers"))).alias("vector"))


def cosine_top(df: DataFrame, query: list[float], k: int, id_col: str, vector: str, least: float = -1.0) -> DataFrame:
    """id, score: the k (1 to 50) most similar vectors of the query's length, score rounded to 6 digits, ties by id."""
    if not 1 <= k <= 50:
        raise ParameterError("1 to 50 results")
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(f"`{vector}`").cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)) * float(sum(x * x for x in query)) ** 0.5
    d = df.where(F.size(v) == len(query)).select(F.col(f"`{id_col}`"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(dot, size))), 6).alias("score"))
    return d.where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def tfidf_vocabulary(df: DataFrame, text: str = "text", top: int = 512) -> DataFrame:
    """word, df, idf: the words in most documents, ties alphabetical; idf = ln((1 + N) / (1 + df)) + 1."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    counts = df.select(F.explode(F.array_distinct(_words(F.col(f"`{text}`")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(top)
    return counts.crossJoin(F.broadcast(n)).select("word", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def tfidf_vectors(df: DataFrame, vocabulary: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """id, word, weight: (1 + ln tf) * idf, unit length, in sparse long form. The vocabulary is bounded by its top."""
    tf = df.select(F.col(f"`{id_col}`"), F.explode(_words(F.col(f"`{text}`"))).alias("word")).join(F.broadcast(vocabulary.select("word", "idf")), "word").groupBy(id_col, "word", "idf").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.select(id_col, "word", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "word", (F.col("w") / norm).alias("weight"))


def bayes_fit(df: DataFrame, label: str, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """label, word, log_p, prior: multinomial naive Bayes with add-one smoothing over the vocabulary."""
    vocab = vocabulary.select("word")
    d = df.where(F.col(f"`{label}`").isNotNull())
    prior = d.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("k"))
    prior = prior.select("label", F.log(F.col("k") / F.sum("k").over(Window.partitionBy())).alias("prior"))
    c = d.select(F.col(f"`{label}`").alias("label"), F.explode(_words(F.col(f"`{text}`"))).alias("word")).join(F.broadcast(vocab), "word").groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    grid = prior.crossJoin(F.broadcast(vocab))  # labels times at most `top` words
    g = grid.join(c, ["label", "word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("label"))
    size = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return g.select("label", "word", F.log((F.col("n") + 1) / (total + size)).alias("log_p"), "prior")


def bayes_classify(df: DataFrame, model: DataFrame, id_col: str, text: str = "text", least: float = 0.6) -> DataFrame:
    """id, label, p: und unless two known words occur and p reaches `least`."""
    m = model.groupBy("word").agg(F.collect_list(F.struct("label", "log_p")).alias("l"))
    prior = model.select("label", "prior").distinct()
    d = df.select(F.col(f"`{id_col}`"), F.explode(_words(F.col(f"`{text}`"))).alias("word")).join(F.broadcast(m), "word")
    known = d.groupBy(id_col).agg(F.count_distinct("word").alias("known"))
    s = d.select(id_col, F.inline("l")).groupBy(id_col, "label").agg(F.sum("log_p").alias("s")).join(F.broadcast(prior), "label").withColumn("s", F.col("s") + F.col("prior"))
    w = Window.partitionBy(id_col)
    s = s.withColumn("p", F.exp(F.col("s") - F.max("s").over(w)))
    s = s.withColumn("p", F.col("p") / F.sum("p").over(w))
    best = s.groupBy(id_col).agg(F.max_by(F.struct("label", "p"), F.struct("p", F.col("label"))).alias("b"))
    out = df.select(F.col(f"`{id_col}`")).distinct().join(known, id_col, "left").join(best, id_col, "left")
    sure = (F.coalesce("known", F.lit(0)) >= 2) & (F.coalesce(F.col("b.p"), F.lit(0.0)) >= least)
    return out.select(id_col, F.when(sure, F.col("b.label")).otherwise("und").alias("label"), F.coalesce(F.col("b.p"), F.lit(0.0)).alias("p"))
