"""Scalar expressions whose semantics differ from Spark's built-ins of like name."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import ParameterError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def numeric_columns(df: DataFrame, leave: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in set(leave)]


def need(df: DataFrame, *names: str) -> None:
    """Raises unless all columns exist."""
    for n in names:
        if n not in df.columns:
            raise ParameterError(f"unknown column {n!r}")


def one_of(value: str, choices: Iterable[str], what: str) -> str:
    if value not in (c := list(choices)):
        raise ParameterError(f"{what} must be one of {', '.join(c)}")
    return value


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one missing value in the table operators."""
    return df.select(*[F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def floating(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    """Float division: x/0 is signed infinity, 0/0 missing."""
    a, b = floating(a), floating(b)
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf")))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; missing for a zero divisor."""
    a, b = floating(a), floating(b)
    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


def rendered(c: Column, kind: T.DataType) -> Column:
    """A value as the text that tables show: floats with the fewest digits that say them, as `10.0`, `1e+20` or `1e-05`
    (powers below -4 and from 16 on), `inf`, `nan`; booleans as True and False; anything else as it is cast."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    plain, size = c.cast("string"), F.abs(c)
    # most numbers are rendered alike by Spark; the others are laid anew
    usual = (size == 0) | (size >= 1e-3) & (size < 1e7) & (F.length(plain) < 17)
    return F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(usual, plain).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), _laid(size)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _laid(size: Column) -> Column:
    """A positive number with the fewest digits that are it, by the rules of `rendered`."""

    def parts(text: Column) -> Column:
        power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
        whole = F.regexp_extract(text, r"^([0-9]+)", 1)
        return F.struct(F.concat(whole, F.regexp_extract(text, r"\.([0-9]+)", 1)).alias("all"), (F.length(whole) - 1 + power).alias("power"))

    def trimmed(x: Column) -> Column:
        """The digits from the first that isn't 0, and its power of ten."""
        return F.struct(F.regexp_replace(x["all"], "^0+|0+$", "").alias("d"), (x["power"] - F.length(F.regexp_extract(x["all"], "^(0*)", 1))).alias("p"))

    def fewest(x: Column) -> Column:
        """Java may show a few digits too many, and a long has all: with some fewer it may be the same number."""
        n = F.length(x["d"])

        def less(drop: int) -> Column:
            cut = F.bround(x["d"].cast("decimal(38,0)") / F.lit(10**drop).cast("decimal(10,0)"), 0).cast("decimal(38,0)").cast("string")
            return _let(cut, lambda k: F.when((n > drop) & (F.concat(k, F.lit("E"), (x["p"] - n + 1 + drop).cast("string")).cast("double") == size), F.struct(F.regexp_replace(k, "0+$", "").alias("d"), (x["p"] + F.length(k) - (n - drop)).alias("p"))))

        return F.coalesce(*[less(drop) for drop in range(7, 0, -1)], x)

    def shown(x: Column) -> Column:
        d, p, n = x["d"], x["p"], F.length(x["d"])
        whole = F.concat(F.substring(F.rpad(d, 17, "0"), F.lit(1), p + 1), F.lit("."), F.when(n > p + 1, F.substring(d, p + 2, F.lit(17))).otherwise("0"))
        far = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 17))).otherwise(""), F.when(p < 0, "e-").otherwise("e+"), F.when(F.abs(p) < 10, "0").otherwise(""), F.abs(p).cast("string"))
        return F.when((p >= 0) & (p < 16), whole).when((p < 0) & (p >= -4), F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), d)).otherwise(far)

    # whole numbers that a long holds are taken exactly
    exact = F.when((size >= 2.0**53) & (size < 2.0**63), size.cast("long").cast("string")).otherwise(size.cast("string"))
    return _let(_let(_let(_let(exact, parts), trimmed), fewest), shown)


def rendered_column(df: DataFrame, c: str) -> Column:
    return rendered(F.col(f"`{c}`"), df.schema[c].dataType)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c.cast("string"), r"^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$", "")


def split_field(c: Column, delimiter: str, i: int) -> Column:
    """Field i (from 0) of a literal split; missing if there is none."""
    return F.get(F.split(c.cast("string"), re.escape(delimiter), -1), F.lit(i))


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


#: Values of a column up to which one reducer ranks them all; beyond, only those around what is asked for.
RANKED = 2_000_000


def quantile_row(df: DataFrame, columns: dict[str, Column], at: list[float]) -> DataFrame:
    """One row: for each name the exact, linearly interpolated quantiles of a column, null if it has no value.

    Ranking all values would hold every distinct one in a reducer, which is done up to RANKED of them. Beyond, a sketch
    brackets each quantile first; then the values below a bracket are counted, and only those inside are ranked. The
    driver sees brackets and counts.
    """
    names = list(columns)
    d = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    accuracy = 10_000
    edges = [min(1.0, max(0.0, p + s * 2.0 / accuracy)) for p in at for s in (-1, 1)]
    x = [F.col(f"x{i}") for i in range(len(names))]
    # a bracket holds the next value too only if the sketch's error is more than one value
    many = [n > max(RANKED, accuracy) for n in d.agg(*[F.count(c) for c in x]).first()]
    ranked = [F.percentile(c, F.array(*[F.lit(float(p)) for p in at])).alias(name) for name, c, m in zip(names, x, many, strict=True) if not m]
    if not any(many):
        return d.agg(*ranked)
    sketch = d.agg(*[(F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges, accuracy).alias("e")) if m else F.lit(None)).alias(f"s{i}") for i, (c, m) in enumerate(zip(x, many, strict=True))]).first()
    inside = [[c.between(s["e"][2 * k], s["e"][2 * k + 1]) for k in range(len(at))] if m else [] for c, s, m in zip(x, sketch, many, strict=True)]
    counts = d.agg(*[F.struct(F.count_if(c < s["e"][2 * k]).alias("below"), F.count_if(inside[i][k]).alias("m")).alias(f"b{i}_{k}") for i, (c, s) in enumerate(zip(x, sketch, strict=True)) if many[i] for k in range(len(at))]).first()
    wanted, places = ranked, {}
    for i in range(len(names)):
        for k, p in enumerate(at if many[i] else ()):
            rank = p * (sketch[i]["n"] - 1)
            low, b = int(rank), counts[f"b{i}_{k}"]
            first, last = low - b["below"], max(b["m"] - 1, 1)
            if not 0 <= first <= min(first + (rank > low), b["m"] - 1):
                raise RuntimeError("a bracket misses its quantile")
            places[i, k] = rank - low
            wanted.append(F.percentile(F.when(inside[i][k], x[i]), F.array(F.lit(first / last), F.lit(min(first + 1, b["m"] - 1) / last))).alias(f"v{i}_{k}"))
    found = d.agg(*wanted).first()
    rows = [[found[f"v{i}_{k}"][0] + (found[f"v{i}_{k}"][1] - found[f"v{i}_{k}"][0]) * places[i, k] if places[i, k] else found[f"v{i}_{k}"][0] for k in range(len(at))] if many[i] else found[name] for i, name in enumerate(names)]
    return df.sparkSession.createDataFrame([tuple(rows)], ", ".join(f"`{n}` array<double>" for n in names))


_BINARY: dict[type, Callable[[Column, Column], Column]] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.Mod: modulo}


def arithmetic(text: str, columns: Iterable[str], most: int = 80) -> Column:
    """A column from an arithmetic expression over numeric columns: + - * / %, signs and numbers, nothing else.

    Parsed with Python's ast and rebuilt as a Column tree; the text never reaches a SQL parser.
    """
    allowed = set(columns)
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ParameterError(f"not an expression: {text!r}") from e
    if sum(1 for _ in ast.walk(tree)) > most:
        raise ParameterError(f"the expression has more than {most} parts")

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -build(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return build(a)
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=name) if name in allowed:
                return floating(F.col(f"`{name}`"))
        raise ParameterError(f"{type(node).__name__} is not allowed in an expression")

    return build(tree)


def safe_regex(pattern: str) -> str:
    """A pattern that linear-time engines accept too: no look-around, back-reference, possessive or atomic group."""
    if len(pattern) > 200:
        raise ParameterError("a pattern may have 200 characters at most")
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+", pattern):
        raise ParameterError("look-around, back-references and possessive quantifiers are not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ParameterError(f"invalid pattern: {e}") from e
    return pattern


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no default port, fragment or trailing dot; null if it has credentials or no host."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    url = F.trim(url)
    scheme, place = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^(.*?)(?::([0-9]*))?$", 1)), r"\.$", "")
    port = F.regexp_extract(place, r":([0-9]+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_extract(url, parts, 3)
    path = F.when(path == "", "/").otherwise(path)
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.regexp_extract(url, parts, 4))
    return F.when(url.rlike(parts) & (host != "") & ~F.contains(place, F.lit("@")), out)


def url_host(url: Column) -> Column:
    return F.regexp_extract(canonical_url(url), r"^[^:]+://([^/:?#]+)", 1)


def with_host(df: DataFrame, url: str, name: str) -> DataFrame:
    """Adds the host of an address that canonical_url takes, else null. The address is taken apart in steps of its own, so
    that none is worked out twice."""
    place = F.regexp_extract(F.trim(F.col(f"`{url}`")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    d = df.withColumn(name, place)
    host = F.regexp_replace(F.lower(F.regexp_replace(name, r":[0-9]*$", "")), r"\.$", "")
    return d.withColumn(name, F.when(~F.contains(name, F.lit("@")), F.nullif(host, F.lit(""))))


def in_domains(host: Column, domains: list[str]) -> Column:
    """Equal to a domain or below it; every host is if there are none."""
    if not domains:
        return F.lit(True)
    names = [d.lower().strip(".") for d in domains]
    below = [host.endswith(f".{d}") for d in names]
    return F.coalesce(reduce(lambda a, b: a | b, below, host.isin(names)), F.lit(False))


#: How a licence's name, in lower case with a hyphen for all but letters, digits and points, says its family.
_FAMILY = (r"(?:^|-)(?:cc|creative-?commons|licenses)-?(by(?:-(?:nc|sa|nd))*)(?:-|$)", r"^(by(?:-(?:nc|sa|nd))*)(?:-[0-9.]+)?$")
_FREE = (("zero", r"(^|-)(cc0|cc-?zero|zero)(-|$)"), ("pdm", r"(^|-)(pdm|public-domain)"))


def with_licence(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the struct (family, version, text) of a licence's name. family: the Creative Commons one: by, by-sa, by-nc,
    by-nd, by-nc-sa, by-nc-nd, zero or pdm, else null; version like 4.0, else null; text: the name itself in lower case."""
    raw = F.col(f"`{column}`").cast("string")
    d = df.withColumn(name, F.struct(F.lower(strip(raw)).alias("text"), F.regexp_extract(raw, r"([0-9]+\.[0-9]+)", 1).alias("version")))
    d = d.withColumn(f"{name}_plain", F.regexp_replace(F.col(f"{name}.text"), r"[^a-z0-9.]+", "-"))
    plain = F.col(f"{name}_plain")
    d = d.withColumn(f"{name}_family", F.concat_ws(",", *[F.regexp_extract(plain, p, 1) for p in _FAMILY]))
    # the first that isn't empty
    family = F.regexp_extract(f"{name}_family", r"^,?([^,]+)", 1)
    free = F.when(plain.rlike(_FREE[0][1]), _FREE[0][0]).when(plain.rlike(_FREE[1][1]), _FREE[1][0])
    whole = F.struct(F.coalesce(F.nullif(family, F.lit("")), free).alias("family"), F.nullif(F.col(f"{name}.version"), F.lit("")).alias("version"), F.col(f"{name}.text").alias("text"))
    return d.withColumn(name, whole).drop(f"{name}_plain", f"{name}_family")


def license_among(parts: str, allowed: Iterable[str], family_of: Callable[[str], tuple[str | None, str | None]] | None = None) -> Column:
    """Whether a licence, given by the column of with_licence, is among the allowed: same family, and same version where
    the allowed one names a version.

    A family never stands for one with further conditions: BY does not admit BY-NC.
    """
    out = F.lit(False)
    for a in allowed:
        family, version = (family_of or python_license)(a)
        same = F.col(f"{parts}.family") == family if family else F.col(f"{parts}.text") == a.strip().lower()
        out = out | F.coalesce(same & (F.col(f"{parts}.version") == version if version else F.lit(True)), F.lit(False))
    return out


def python_license(name: str) -> tuple[str | None, str | None]:
    """Family and version of a licence's name, as with_licence."""
    n = re.sub(r"[^a-z0-9.]+", "-", name.strip().lower())
    m = next(filter(None, (re.search(p, n) for p in _FAMILY)), None)
    family = m[1] if m else next((f for f, p in _FREE if re.search(p, n)), None)
    v = re.search(r"([0-9]+\.[0-9]+)", name)
    return family, v[1] if v else None


#: Words that carry no topic.
STOPWORDS = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "were", "has", "have", "into", "not", "but", "you", "your", "our", "its", "can", "all", "any")


def keywords(text: Column) -> Column:
    """Distinct topic words: runs of a-z and 0-9 longer than two, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*map(F.lit, STOPWORDS)))


def relevance(text: Column, expected: Column) -> Column:
    """Shared topic words over min(5, expected ones); 0 if nothing is expected."""
    n = F.least(F.lit(5), F.size(expected))
    return F.when(n > 0, F.least(F.lit(1.0), F.size(F.array_intersect(keywords(text), expected)) / n)).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes written as 16 hexadecimal digits."""
    (a1, a2), (b1, b2) = _halves(a), _halves(b)
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def _halves(c: Column) -> tuple[Column, Column]:
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), F.conv(F.substring(c, 9, 8), 16, 10).cast("long")


def json_value(c: Column, path: str) -> Column:
    """The scalar at a path like $.a.b[0] of JSON text, as text; null where there is none or the text is no JSON."""
    return F.get_json_object(c, path)
