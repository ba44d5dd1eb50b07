"""License scans by ordered signature rules, with DataFrame functions only.

A text is brought to its words. Rules are regular expressions over these words; each has keywords, and only rules of
which one occurs are tried. Every place where a rule matches is a detection with a span of words. A detection is
suppressed if its span lies in one of a rule of equal or higher priority, so that "gnu lesser general public license
version 2 1" is not also "lesser general public license". Beside the rules, four base phrases are looked up as such;
nothing suppresses them.

Everything is computed within the row: no shuffle, no Python.

Cases: null text counts as the empty text (no words, no labels, empty label strings, null places, score 0); texts of any
length are scanned whole; equal rows give equal results; rows with a null id are scanned like any other; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Everything that is not part of a word, once A-Z is lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_V = "(?: version| v| versions)?"


def rules() -> list[dict]:
    """The signature rules in their order: label, priority (0 is highest), weight, keywords and regex.

    A regex is written over words between single spaces and ends before a space. One of its keywords is a word of
    everything that it matches.
    """
    out: list[dict] = []

    def rule(label: str, priority: int, weight: float, keyword: str, pattern: str) -> None:
        out.append({"label": label, "priority": priority, "weight": weight, "keywords": keyword.split("|"), "pattern": f"{pattern}(?= )"})

    # identifiers: exact, therefore first
    spdx = {
        "gpl": ["gpl 1 0", "gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 0", "lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 1 0", "agpl 3 0"],
        "gfdl": ["gfdl 1 1", "gfdl 1 2", "gfdl 1 3"], "apache": ["apache 1 0", "apache 1 1", "apache 2 0"], "mit": ["mit", "mit 0"],
        "bsd": ["bsd 1 clause", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"], "isc": ["isc"], "zlib": ["zlib"],
        "mpl": ["mpl 1 0", "mpl 1 1", "mpl 2 0"], "epl": ["epl 1 0", "epl 2 0"], "eupl": ["eupl 1 1", "eupl 1 2"], "cddl": ["cddl 1 0", "cddl 1 1"],
        "artistic": ["artistic 1 0", "artistic 2 0"], "bsl": ["bsl 1 0"], "busl": ["busl 1 1"], "unlicense": ["unlicense"], "wtfpl": ["wtfpl"],
        "cc0": ["cc0 1 0"], "ofl": ["ofl 1 0", "ofl 1 1"], "afl": ["afl 2 1", "afl 3 0"], "osl": ["osl 2 1", "osl 3 0"], "ms-pl": ["ms pl"], "ms-rl": ["ms rl"],
        "ncsa": ["ncsa"], "postgresql": ["postgresql"], "psf": ["psf 2 0", "python 2 0"], "ruby": ["ruby"], "php": ["php 3 0", "php 3 01"], "vim": ["vim"],
        "cecill": ["cecill 2 0", "cecill 2 1", "cecill b", "cecill c"], "ecl": ["ecl 2 0"], "upl": ["upl 1 0"], "cpl": ["cpl 1 0"], "ipl": ["ipl 1 0"], "sspl": ["sspl 1 0"],
    }
    for label, names in spdx.items():
        for name in names:
            tail = "(?: or later| only)?" if label in ("gpl", "lgpl", "agpl", "gfdl") else ""
            rule(label, 0, 1.0, "spdx", f"spdx license identifier {name}{tail}")
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            rule(f"cc-{kind.replace(' ', '-')}", 0, 1.0, "cc", f"cc {kind} {version}")
        rule(f"cc-{kind.replace(' ', '-')}", 1, 0.9, "cc", f"cc {kind}")
        rule(f"cc-{kind.replace(' ', '-')}", 0, 1.0, "creativecommons", f"creativecommons org licenses {kind}(?: [1-4] [05])?")
    spelled = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
    for kind, words in spelled.items():
        rule(f"cc-{kind}", 1, 0.95, "creative", f"creative commons {words}(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?")
    rule("cc0", 0, 1.0, "creative", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?")
    rule("cc0", 1, 0.95, "cc0", "cc0(?: 1 0)?(?: universal)?")
    # full names with their versions
    named = [
        ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1", "3")), ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", ("2 1", "3")),
        ("lgpl", "library", "(?:gnu )?library general public licen[cs]e", ("2", "2 0")), ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
        ("gpl", "general", "(?:gnu )?general public licen[cs]e", ("1", "2", "3")), ("apache", "apache", "apache(?: software)? licen[cs]e", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")), ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
        ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")), ("cddl", "distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
        ("cpl", "common", "common public licen[cs]e", ("0 5", "1 0")), ("ipl", "ibm", "ibm public licen[cs]e", ("1 0",)), ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
        ("bsl", "boost", "boost software licen[cs]e", ("1 0",)), ("busl", "business", "business source licen[cs]e", ("1 0", "1 1")), ("ofl", "font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
        ("afl", "academic", "academic free licen[cs]e", ("1 1", "2 1", "3 0")), ("osl", "open", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
        ("ms-pl", "microsoft", "microsoft public licen[cs]e", ()), ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", ()), ("sspl", "side", "server side public licen[cs]e", ("1",)),
        ("psf", "python", "python software foundation licen[cs]e", ("2",)), ("php", "php", "php licen[cs]e", ("3 0", "3 01")), ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ()),
        ("isc", "isc", "isc licen[cs]e", ()), ("mit", "mit", "mit licen[cs]e", ()), ("mit", "mit", "(?:the )?mit licen[cs]e mit", ()), ("mit", "expat", "expat licen[cs]e", ()),
        ("x11", "x11", "x11 licen[cs]e", ()), ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", ()), ("postgresql", "postgresql", "postgresql licen[cs]e", ()),
        ("unlicense", "unlicense", "(?:the )?unlicense", ()), ("wtfpl", "wtfpl", "wtfpl", ("2",)), ("cecill", "cecill", "cecill(?: [bc])?(?: free software)? licen[cs]e", ("2 0", "2 1")),
        ("ecl", "educational", "educational community licen[cs]e", ("1 0", "2 0")), ("upl", "universal", "universal permissive licen[cs]e", ("1 0",)), ("odbl", "database", "open database licen[cs]e", ("1 0",)),
        ("pddl", "dedication", "public domain dedication and licen[cs]e", ("1 0",)), ("odc-by", "data", "open data commons attribution licen[cs]e", ("1 0",)), ("nposl", "non", "non profit open software licen[cs]e", ("3 0",)),
        ("openssl", "openssl", "openssl licen[cs]e", ()), ("beerware", "beer|beerware", "beer ?ware licen[cs]e", ()), ("vim", "vim", "vim licen[cs]e", ()), ("ruby", "ruby", "ruby licen[cs]e", ()), ("rail", "rail|openrail", "(?:open ?)?rail(?: m)? licen[cs]e", ()),
    ]
    for label, keyword, name, versions in named:
        for version in versions:
            rule(label, 1, 0.95, keyword, f"{name}{_V} {version}(?: or (?:later|any later version|newer))?")
        rule(label, 2, 0.85, keyword, name)
    for n, word in (("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        rule("bsd", 1, 0.95, "bsd", f"bsd (?:{n}|{word}) clause(?: licen[cs]e)?")
        rule("bsd", 1, 0.95, "bsd", f"(?:{n}|{word}) clause bsd(?: licen[cs]e)?")
    for adjective in ("simplified", "modified", "new", "revised", "original", "old"):
        rule("bsd", 1, 0.9, "bsd", f"{adjective} bsd licen[cs]e")
    rule("bsd", 2, 0.85, "bsd", "bsd(?: style)? licen[cs]e")
    # short names with versions
    for label, short, versions in (("gpl", "gpl", ("2", "3")), ("lgpl", "lgpl", ("2", "2 1", "3")), ("agpl", "agpl", ("3",)), ("mpl", "mpl", ("1 1", "2 0")), ("epl", "epl", ("1 0", "2 0"))):
        for version in versions:
            rule(label, 2, 0.8, short, f"(?:gnu )?{short} v? ?{version}")
            rule(label, 2, 0.8, f"{short}v{version.split()[0]}", f"(?:gnu )?{short}v{version}(?: or later)?")
    # what texts say of themselves
    grants = [
        ("apache", "apache", "licensed under the apache licen[cs]e"), ("mit", "mit", "(?:released|licensed|distributed|available) under the(?: terms of the)? mit licen[cs]e"),
        ("bsd", "bsd", "(?:released|licensed|distributed|available) under the(?: terms of the)? bsd licen[cs]e"), ("mpl", "mozilla", "subject to the terms of the mozilla public licen[cs]e"),
        ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"), ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
        ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"), ("bsl", "permission", "permission is hereby granted free of charge to any person or organization"),
        ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"), ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
        ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"), ("zlib", "provided", "this software is provided as is without any express or implied warranty"),
        ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e"), ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
        ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"), ("public-domain", "domain", "public domain"), ("proprietary", "reserved", "all rights reserved"),
        ("proprietary", "confidential", "proprietary and confidential"), ("proprietary", "redistribution", "redistribution is (?:prohibited|not permitted)"), ("cc", "creative", "creative commons(?: licen[cs]e)?"),
        ("beerware", "beer", "you can buy me a beer in return"), ("commercial", "commercial", "commercial licen[cs]e"), ("non-commercial", "commercial", "(?:for )?non commercial use only"),
    ]
    for label, keyword, pattern in grants:
        weak = label in ("public-domain", "proprietary", "cc", "commercial", "non-commercial")
        rule(label, 3 if weak else 1, 0.6 if weak else 0.95, keyword, pattern)
    return out


def _words(x: Column) -> Column:
    """How many words, each with a space before it, x holds."""
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _spaced(text: Column) -> Column:
    """Words with one space before each and one at the end; a single space if there are none.

    lower() also lowers beyond ASCII, which changes no match: of such characters only the Kelvin sign becomes an ASCII
    letter, so another letter stands in for it.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), BETWEEN, " ")


def _hits(n: Column, pattern: Column | str) -> Column:
    """Places of a pattern without overlaps: array of struct(s, e) in words, e exclusive.

    A mark (a character that no word holds) is set at both ends of each match; then the numbers of the words with a mark
    are what is asked for. Linear in the text, however many matches there are.
    """
    around = F.concat(F.lit("(?<= )("), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"(?<= )({pattern})")
    words = F.split(F.substring(F.regexp_replace(n, around, F.lit("\x01$1\x02")), 2, 2_000_000_000), " ")
    numbered = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.contains(x["w"], F.lit("\x01")) | F.contains(x["w"], F.lit("\x02")))
    at = lambda mark, more: F.transform(F.filter(numbered, lambda x: F.contains(x["w"], F.lit(mark))), lambda x: x["i"] + more)
    return F.transform(F.arrays_zip(at("\x01", 0).alias("s"), at("\x02", 1).alias("e")), lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e")))


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, starts (of base phrases by label), detections (s, e, label, priority, weight; none suppressed)."""
    table = rules() + (extra or [])
    kind = "array<struct<label:string,priority:int,weight:double,keywords:array<string>,pattern:string>>"
    keywords = sorted({k for r in table for k in r["keywords"]} | {p.split(" ")[0] for p in BASE})
    literal = F.from_json(F.lit(json.dumps(table)), kind)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), _spaced(F.col(text_col)).alias("n"))
    n = F.col("n")
    # most texts hold no keyword; one pass over their words tells
    own = F.array_intersect(F.split(n, " "), F.array(*map(F.lit, keywords)))
    src = src.select("doc_id", "n", (_words(n) - 1).alias("n_words"), own.alias("own"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,label:string,priority:int,weight:double>>)")
    tried = F.filter(F.filter(literal, lambda r: F.arrays_overlap(F.col("own"), r["keywords"])), lambda r: F.rlike(n, F.concat(F.lit(" "), r["pattern"])))
    found = F.flatten(F.transform(tried, lambda r: F.transform(_hits(n, r["pattern"]), lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight")))))
    src = src.withColumn("every", F.when(F.size("own") > 0, found).otherwise(none))
    # no base phrase begins as it ends, so its places don't overlap
    places = [F.when((F.size("own") > 0) & F.contains(n, F.lit(f" {phrase} ")), F.transform(_hits(n, f"{phrase}(?= )"), lambda h: h["s"])).otherwise(F.expr("cast(array() as array<int>)")).alias(label) for phrase, label in BASE.items()]
    src = src.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.struct(*places).alias("starts"), "every")
    return _unsuppressed(src, none)


def _unsuppressed(src: DataFrame, none: Column) -> DataFrame:
    """Turns every into detections, without those within one of equal or higher priority: in order of start, the furthest
    end so far of each priority is all that must be known.

    Goes through about sqrt(n) runs of sqrt(n) detections: each run needs only the furthest ends before it, and no array
    grows by one over all n. Each step is a column of its own that the next uses more than once, so that none is put into
    the function of the next and worked out again for every run.
    """
    keep = ["doc_id", "n_words", "starts"]
    key = F.sort_array(F.transform("every", lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("ne"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"))))
    src = src.select(*keep, key.alias("sorted"))
    n, size = F.size("sorted"), F.ceil(F.sqrt(F.size("sorted").cast("double"))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.slice("sorted", k * size + 1, size))
    src = src.select(*keep, F.when(n > 0, runs).otherwise(F.array()).alias("runs"))

    def furthest(far: Column, part: Column) -> Column:
        return F.transform(far, lambda x, i: F.greatest(x, F.coalesce(F.array_max(F.transform(F.filter(part, lambda d: d["priority"] == i), lambda d: -d["ne"])), F.lit(-1))))

    before = F.aggregate("runs", F.array(F.expr("array(-1, -1, -1, -1)")), lambda acc, part: F.concat(acc, F.array(furthest(F.element_at(acc, -1), part))))
    src = src.select(*keep, "runs", F.slice(before, 1, F.greatest(F.size("runs"), F.lit(1))).alias("before"))

    def step(acc: Column, d: Column) -> Column:
        e = -d["ne"]
        inside = F.array_max(F.slice(acc["far"], 1, d["priority"] + 1)) >= e
        own = F.array(F.struct(d["s"].alias("s"), e.alias("e"), d["label"].alias("label"), d["priority"].alias("priority"), d["weight"].alias("weight")))
        return F.struct(
            F.transform(acc["far"], lambda x, i: F.when(i == d["priority"], F.greatest(x, e)).otherwise(x)).alias("far"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], own)).alias("out"),
        )

    left = F.transform(F.arrays_zip(F.col("runs").alias("part"), F.col("before").alias("far")), lambda p: F.aggregate(p["part"], F.struct(p["far"].alias("far"), none.alias("out")), step)["out"])
    return src.select(*keep, F.when(F.size("runs") > 0, F.flatten(left)).otherwise(none).alias("detections"))


def licenses(df: DataFrame) -> DataFrame:
    """op9: n_words, places and labels of base phrases, labels with the rules', score (the best weight; base 0.6)."""
    s = scanned(df)
    places = F.concat(*[F.col(f"starts.`{label}`") for label in BASE.values()])
    base = F.filter(F.array(*[F.when(F.size(f"starts.`{label}`") > 0, F.lit(label)) for label in BASE.values()]), lambda x: x.isNotNull())
    s = s.select("doc_id", "n_words", "detections", places.alias("places"), base.alias("base"))
    labels = F.sort_array(F.array_distinct(F.concat("base", F.col("detections.label"))))
    best = F.greatest(F.coalesce(F.array_max("detections.weight"), F.lit(0.0)), F.when(F.size("places") > 0, 0.6).otherwise(0.0))
    return s.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.cast("double").alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
