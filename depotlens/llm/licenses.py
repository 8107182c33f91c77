"""License scan: files, blocks and notices matched to licences by TF-IDF cosine, the rest inherit from their directories.

Three kinds of units are compared. The whole file, its leading comment block and its paragraphs meet full licence texts
and their standard headers, whatever words they hold; a unit is compared if it shares enough rare tokens with a template
to reach the least cosine at all, so the prefilter loses nothing. Sentences with a word of licensing, within a line and
with line breaks joined, meet the phrases by which licences are referred to. Equal units are matched once, with document
frequencies over all files (texts) or over the notices of all files (phrases). A full text says more than a notice.

A licence file, by its name or by being mostly notice, speaks for its directory and all below; a file without a
recognised notice of its own takes the licence of its nearest ancestor directory that has one, found by joining each
directory's ancestors with the directories that have licences.

Nulls and empties: a null or empty text has no notice; a null path has no directory, so it inherits nothing and keeps the
notice of its own text. Equal cosines go to the template, and equal licence files to the path, that comes first. Every
row is a file: rows of one path with different texts have the licences of their own texts, equal rows have equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

LEAST_TEXT = 0.75  # cosine of a file, block or paragraph to a full text or a header
LEAST_COSINE = 0.5
FILE_SHARE = 30  # percent of a text that its notices make, to be a licence file
KEYWORDS = ("licens", "licenc", "copyright", "spdx", "public domain")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"

# How licences are referred to.
TEMPLATES = {
    "MIT": "released under the mit license permission is hereby granted free of charge to any person obtaining a copy",
    "MIT-header": "licensed under the mit license",
    "Apache-2.0": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
    "Apache-2.0-header": "licensed under the apache license version 2.0",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "GPL-2.0": "this program is licensed under the gnu general public license version 2",
    "LGPL-3.0": "licensed under the gnu lesser general public license version 3",
    "AGPL-3.0": "licensed under the gnu affero general public license version 3",
    "BSD-3-Clause": "redistribution and use in source and binary forms are permitted under the bsd 3-clause license",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "CC-BY-4.0": "licensed under cc by 4.0 creative commons attribution license",
    "CC-BY-SA-4.0": "licensed under cc by-sa 4.0 creative commons attribution sharealike license",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "CC0-1.0": "dedicated to the public domain under cc0 1.0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
}
# The paragraphs that licences ask to put at the head of a file, and the first ones of short licences.
_GNU = (
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu {0}general public license "
    "as published by the free software foundation either version {1} of the license or (at your option) any later version"
)
HEADERS = [
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge "
     "publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions"),
    ("Apache-2.0", "licensed under the apache license version 2.0 (the license) you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    ("GPL-2.0", _GNU.format("", 2)), ("GPL-3.0", _GNU.format("", 3)), ("AGPL-3.0", _GNU.format("affero ", 3)),
    ("LGPL-2.0", _GNU.format("library ", 2)), ("LGPL-2.1", _GNU.format("lesser ", 2.1)), ("LGPL-3.0", _GNU.format("lesser ", 3)),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at https://mozilla.org/mpl/2.0/"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission"),
    ("ISC", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
     "compiled binary for any purpose commercial or non-commercial and by any means"),
]
TEXTS = Path(__file__).parent / "license_texts"  # a file per licence, named by its identifier

TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# The comments at the head of a text, after an interpreter line. Possessive, so that long blocks need no stack.
LEADING = (
    r"^\s*+(?:#![^\n]*+\n\s*+)?+(?:/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\"|"
    r"(?:[ \t]*+(?:(?://|#|--|;|%|dnl |rem )[^\n]*+)?+\n)++(?:[ \t]*+(?://|#|--|;|%|dnl |rem )[^\n]*+)?+)"
)
PARAGRAPHS = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"  # lines without a letter or digit part them
_WRAPPED = r"\s*\n[\s*#/;%-]*"  # a line break within a paragraph, with the comment mark after it
_POINT = "\u0001"  # stands for a point before a digit while sentences are cut at points


def _has_keyword(text: Column) -> Column:
    found = [F.contains(text, F.lit(k)) for k in KEYWORDS]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def _sentences(low: Column) -> Column:
    cut = F.split(F.regexp_replace(low, "[.]([0-9])", f"{_POINT}$1"), "[\n.!?]")
    return F.array_distinct(F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit(_POINT), F.lit(".")))), _has_keyword))


def notices(files: DataFrame) -> DataFrame:
    """``file``, ``of`` (the notice's key), ``notice``, ``in_line``, ``wrapped``: the distinct sentences of licensing of every file (file, text), in lower case.

    A sentence ends with its line, or with its paragraph; most are found both ways.
    """
    low = F.lower("text")
    paragraphs = F.split(low, PARAGRAPHS)
    joined = F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(p, _WRAPPED, " ")), "\n")
    spoken = files.where(_has_keyword(low)).select("file", _sentences(low).alias("lines"), _sentences(joined).alias("joined"))
    each = spoken.select("file", "lines", "joined", F.explode(F.array_union("lines", "joined")).alias("notice"))
    found = each.select("file", F.sha2("notice", 256).alias("of"), "notice", F.array_contains("lines", F.col("notice")).alias("in_line"), F.array_contains("joined", F.col("notice")).alias("wrapped"))
    return found.distinct()  # equal rows are one file here


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


@cache
def _templates() -> list[tuple[str, str, bool, Counter]]:
    """Name, licence, whether it is a full text, and tokens of every template of a text or header."""
    full = [(p.stem, p.stem, True, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    heads = [(f"{name}-head{i}", name, False, body) for i, (name, body) in enumerate(HEADERS)]
    return [(t, name, whole, Counter(re.findall(TOKEN, body.lower()))) for t, name, whole, body in full + heads]


def _damped(n: float) -> float:
    return 1 + math.log(n)


def _could_match(weights: dict[str, dict[str, float]], least: float) -> str:
    """SQL of the condition on ``unit`` that it can reach the cosine ``least`` with some template.

    A unit of that cosine shares tokens that make least^2 of the template's squared norm. Of the rarest tokens, which make
    all but half of that, it then shares the other half, and so no fewer of them than the heaviest that make it up.
    """
    terms, every, fewest = [], set(), 1 << 30
    for tokens in weights.values():
        ranked = sorted(tokens.items(), key=lambda x: (-x[1], x[0]))
        total, need = sum(v * v for v in tokens.values()), least * least / 2
        rare, mass, n = [], 0.0, 0
        for token, v in ranked:
            if mass >= (1 - need) * total:
                break
            n += mass < need * total * 0.999  # room for rounding
            rare.append(token)
            mass += v * v
        terms.append(f"(size(h) >= {n} AND size(array_intersect(split('{' '.join(rare)}', ' '), h)) >= {n})")
        every.update(rare)
        fewest = min(fewest, n)
    some = ", ".join(f"'{t}'" for t in sorted(every))
    hits = f"filter(array_distinct(regexp_extract_all(unit, '({TOKEN})', 1)), t -> t IN ({some}))"
    return f"exists(array({hits}), h -> size(h) >= {fewest} AND ({' OR '.join(terms)}))"


def matched_texts(files: DataFrame, least: float = LEAST_TEXT) -> DataFrame:
    """``file``, ``kind`` (whole, block, paragraph), ``notice_chars``, ``license``, ``cosine``, ``full`` of every unit that resembles a text or header."""
    spark = files.sparkSession
    low = files.where("text IS NOT NULL").select("file", F.lower("text").alias("unit"))
    frequency = low.select(F.explode(F.array_distinct(_tokens(F.col("unit")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    frequency = written(frequency, "license-tokens")
    total = files.count()
    vocabulary = sorted({t for *_, tokens in _templates() for t in tokens})
    known = spark.createDataFrame([(t,) for t in vocabulary], "token string").join(frequency, "token")
    df = {r.token: r.df for r in known.collect()}  # of the templates' tokens only
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    weights = {t: {k: _damped(n) * idf(df.get(k, 0)) for k, n in tokens.items()} for t, _, _, tokens in _templates()}
    may = F.expr(_could_match(weights, least))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    unit = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("unit"))
    block = F.regexp_extract("unit", LEADING, 0)
    units = F.concat(
        F.array(unit("whole", F.col("unit")), unit("block", block)), F.transform(F.split("unit", PARAGRAPHS), lambda p: unit("paragraph", p))
    )
    # A unit's tokens are among those of its file, so a file that can't match holds no unit that can.
    each = low.where(may).select("file", F.posexplode(units).alias("place", "u")).select("file", "place", "u.kind", "u.unit").where(may)
    each = written(each.select("file", "place", "kind", F.length(flat(F.col("unit"))).alias("chars"), "unit").withColumn("of", F.sha2("unit", 256)), "license-units")
    distinct = each.groupBy("of").agg(F.min("unit").alias("unit")).select("of", F.explode(_tokens(F.col("unit"))).alias("token"))
    counts = distinct.groupBy("of", "token").agg(F.count(F.lit(1)).alias("tf")).join(frequency, "token")
    weighted = counts.select("of", "token", ((F.log("tf") + 1) * (F.log((1 + total) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weighted.groupBy("of").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = [(t, name, whole, k, v) for t, name, whole, _ in _templates() for k, v in weights[t].items()]
    template = spark.createDataFrame(rows, "template string, license string, full boolean, token string, v double")
    template_norm = template.groupBy("template", "license", "full").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("template_norm"))
    dots = weighted.join(template.select("template", "token", "v"), "token").groupBy("of", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6).alias("cosine")
    near = dots.join(norm, "of").join(template_norm, "template").select("of", "license", "full", cosine).where(F.col("cosine") >= least)
    best = near.groupBy("of").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "license", "full")).alias("best"))
    best = best.select("of", "best.license", (-F.col("best.far")).alias("cosine"), "best.full")
    found = each.select("file", "place", "kind", "of", F.col("chars").alias("notice_chars")).distinct()  # equal rows are one file here
    return found.join(best, "of").select("file", "kind", "notice_chars", "license", "cosine", "full")


def classified(found: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """``of``, ``license``, ``cosine`` of every distinct notice that resembles a template.

    Tokens carry the notice's key, as a notice may be a very long sentence.
    """
    spark = found.sparkSession
    distinct = found.groupBy("of").agg(F.min("notice").alias("notice"), F.count(F.lit(1)).alias("n"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    split = lambda c: F.explode(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))).alias("token")
    counts = distinct.select("of", "n", split("notice")).groupBy("of", "n", "token").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("token").agg(F.sum("n").alias("df"))
    idf = idf.select("token", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf, "token").select("of", "token", (F.col("tf") * F.col("idf")).alias("w"))
    template = spark.createDataFrame(list(TEMPLATES.items()), "template string, body string").select("template", split("body"))
    rare = F.log(1 + total) + 1  # of a token that no notice has
    template = template.groupBy("template", "token").agg(F.count(F.lit(1)).alias("tf")).join(idf, "token", "left")
    template = template.select("template", "token", (F.col("tf") * F.coalesce("idf", rare)).alias("v"))
    norm = weighted.groupBy("of").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template_norm = template.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("template_norm"))
    dots = weighted.join(template, "token").groupBy("of", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6)
    near = dots.join(norm, "of").join(template_norm, "template").select("of", "template", cosine.alias("cosine"))
    best = near.where(F.col("cosine") >= least_cosine).groupBy("of").agg(
        F.min(F.struct((-F.col("cosine")).alias("far"), "template")).alias("best")
    )
    return best.select("of", F.regexp_replace("best.template", "-header$", "").alias("license"), (-F.col("best.far")).alias("cosine"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def scanned(files: DataFrame) -> DataFrame:
    """``path``, ``license``, ``cosine``, ``own``, ``inherited_from`` of every file (path, text).

    ``own`` tells a notice of the file itself; ``inherited_from`` is the directory whose licence file spoke otherwise.
    """
    # What a text says of itself is found by path and text; equal rows share it.
    file = F.sha2(F.concat(F.coalesce("path", F.lit("")), F.lit("\u0000"), F.coalesce("text", F.lit(""))), 256)
    plain = files.select("path", "text").withColumn("file", file)
    found = written(notices(plain), "license-notices")
    of_length = lambda c: F.when(F.col(c), F.length("notice")).otherwise(0)
    spoken = found.join(classified(found), "of").select(
        "file", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), of_length(c).alias("notice_chars")) for c in ("in_line", "wrapped")])).alias("s"),
        "license", "cosine", F.lit(False).alias("full"),
    )
    known = spoken.select("file", "s.kind", "s.notice_chars", "license", "cosine", "full").unionByName(matched_texts(plain))
    best = F.min(F.struct((~F.col("full")).alias("part"), (-F.col("cosine")).alias("far"), "license")).alias("best")
    own = known.groupBy("file", "kind").agg(best, F.sum("notice_chars").alias("notice_chars"))  # the same words count once per kind
    own = own.groupBy("file").agg(F.min("best").alias("best"), F.max("notice_chars").alias("notice_chars"))
    own = own.select("file", F.col("best.license").alias("own_license"), (-F.col("best.far")).alias("cosine"), "notice_chars")
    sized = plain.select("path", "file", F.length(F.trim("text")).alias("chars"))
    marked = sized.join(own, "file", "left").withColumn("dir", directory(F.col("path")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    speaks = marked.where("own_license IS NOT NULL AND dir IS NOT NULL").where(
        (100 * F.col("notice_chars") >= FILE_SHARE * F.col("chars")) | name.rlike(FILE_NAMES)
    )
    licensed = speaks.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "path", "own_license")).alias("best"))
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("best.own_license").alias("dir_license"))
    dirs = marked.where("dir IS NOT NULL").select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    above = above.withColumn("ancestor", F.when(F.col("depth") == 0, "").otherwise(F.expr("substring_index(dir, '/', depth)")))
    nearest = above.where("depth = 0 OR ancestor <> ''").join(licensed, "ancestor").groupBy("dir").agg(
        F.max(F.struct("depth", "ancestor", "dir_license")).alias("near")
    )
    nearest = nearest.select("dir", F.col("near.ancestor").alias("ancestor"), F.col("near.dir_license").alias("dir_license"))
    out = marked.join(nearest, "dir", "left")
    return out.select(
        "path", F.coalesce("own_license", "dir_license").alias("license"), "cosine", F.col("own_license").isNotNull().alias("own"),
        F.when(F.col("own_license").isNull(), F.col("ancestor")).alias("inherited_from"),
    )
