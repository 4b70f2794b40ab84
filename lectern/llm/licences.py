"""Licence scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance by path.

A *unit* is a line of any text, the whole text of a licence file (by its base name), or a *window*: as many
terms as a template has, from the start of a line or sentence on, whatever line breaks and comment marks lie
between. A window is compared to templates of its length. Every unit must hold the template's
numbers and no word of ``QUALIFIERS`` that the template lacks, as these make it another licence. Terms are runs of ASCII letters and digits, lower-cased, weighted (1 + ln tf) * ln(1 + N / (1 + df)), with document counts
over all documents; a term of no template weighs as if it occurred in one document. A file's own licence is the
template of greatest cosine (to three digits), at least ``least``, over its units; ties go to the template of
more terms, then to the smaller name, so of two statements in one text the fuller tells. A text that also holds the statement of
a variant (``VARIANTS``) is that variant, and ``GENERIC`` tells only where nothing else does. A tag (``TAG``) that names
a known licence comes before all statements, a title on a line of its own (``TITLE``) behind them; both have similarity 1.

Of each template, the commonest terms whose part of the norm stays under ``least`` cannot reach it alone.
A unit therefore needs one of the other, rarer terms: only lines with one, and windows that reach one, are
taken apart. A window's cosine is at most the norm of the template's terms that it holds: if that is under
``least`` it is dropped before it is scored. None is missed by either.

A file without a licence of its own inherits that of the nearest directory above it that holds a licence
file with one (its own directory first; of several, the greatest cosine, then the smaller name).
Directories are resolved once each, by a join of their ancestors with the licensed directories.

The templates are this module's: a few dozen short texts, so their terms are a bounded broadcast.

Edge cases: a null or empty text has no units; a null path has no directory and inherits nothing; rows
that repeat a key, or have none, are told apart by path and text (64-bit hash) and each returned; of a very long
text only lines and windows near a rare term are taken apart; an empty table gives an empty result; other columns pass
through, and the operator's columns replace columns of the same name.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements by which the public licences are announced.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("X11", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("proprietary", "All rights reserved."),
)
#: A licence that holds another's statements and one of its own, and that other one. What says least, and tells only where nothing else does.
VARIANTS = (("BSD-3-Clause", "BSD-2-Clause"), ("X11", "MIT"))
GENERIC = "proprietary"
#: How a file names its licence by a tag, and by a line that is a title.
TAG = r"SPDX-License-Identifier:\s*([A-Za-z0-9][A-Za-z0-9.]*(?:-[A-Za-z0-9.]+)*?)(?:-only|-or-later|\+)?(?![A-Za-z0-9.+-])"
TITLE = r"(?im)^[^a-z0-9\n]*(?:the )?(bsd 2-clause|bsd 3-clause|boost software|isc|mit|x11|zlib) licen[sc]e(?: \([a-z0-9]+\))?[^a-z0-9\n]*$"
TITLES = {"bsd 2-clause": "BSD-2-Clause", "bsd 3-clause": "BSD-3-Clause", "boost software": "BSL-1.0", "isc": "ISC", "mit": "MIT", "x11": "X11", "zlib": "Zlib"}
LEAST = 0.75
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
SPLIT = "[^a-z0-9]+"
QUALIFIERS = ("affero", "alike", "commercial", "derivatives", "lesser", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike")
#: Where a window may start: behind a line break or the end of a sentence. Words that only mark comments.
BREAKS, MARKS = r"(?<=\n)|(?<=[.;:!?]\s)", r"^\s*(dnl|rem)\s"


def terms(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


def term_counts(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each term of the templates."""
    own = F.array_intersect(F.split(F.lower(text), SPLIT), F.array(*[F.lit(t) for t in vocabulary]))
    # one row for each term, and one (null) for each document
    counted = docs.select(F.explode(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(F.lit("")))).alias("term")).groupBy("term").count()
    found = {r["term"]: r["count"] for r in counted.collect()}  # at most one row for each template term
    return found.pop("", 0), found


def idf(n: int, df: int) -> float:
    return math.log(1 + n / (1 + df))


def needed(own) -> list[str]:
    """Terms without which a unit is another licence: the template's numbers."""
    return sorted({t for t in own if t.isdigit()})


def barred(own) -> list[str]:
    """Terms with which a unit is another licence."""
    return [t for t in QUALIFIERS if t not in own]


class Weights:
    """The templates as weighted unit vectors, and the terms of which a unit needs one."""

    def __init__(self, n: int, df: dict[str, int], templates=TEMPLATES, least: float = LEAST):
        self.n, self.idf = n, {t: idf(n, df.get(t, 0)) for _, text in templates for t in terms(text)}
        self.other = idf(n, 1)
        self.rows: list[tuple[int, str, str, float, int]] = []
        self.sizes = [len(terms(text)) for _, text in templates]
        self.needed: set[str] = set()
        for k, (name, text) in enumerate(templates):
            own = {t: (1 + math.log(c)) * self.idf[t] for t, c in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in own.values())) or 1.0
            own = {t: w / norm for t, w in own.items()}
            self.rows += [(k, name, t, w, len(terms(text))) for t, w in own.items()]
            common = 0.0
            for t, w in sorted(own.items(), key=lambda x: (x[1], x[0])):
                common += w * w
                if common >= (least * least) * 0.999:
                    self.needed.add(t)


#: What licence texts speak of; a text is one that speaks of most of it, at least once in ``SHARE`` characters.
LEGAL, SHARE = ("warrant", "licen[sc]", "copyright", "permission|permitted", "liab", "distribut", "conditions"), 300


def is_licence_text(text: Column) -> Column:
    """Whether a text of any length is a licence, told by how much of it legal terms make up; null for null."""
    kinds = sum((text.rlike(f"(?i){x}").cast("int") for x in LEGAL[1:]), F.lit(1))
    # a licence without a word on warranty is none of those known; most texts are done with after that
    return text.rlike(f"(?i){LEGAL[0]}") & (kinds >= 4) & (F.regexp_count(text, F.lit(f"(?i){'|'.join(LEGAL)}")) * SHARE >= F.length(text))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def windows(text: Column, rare: str, most: int) -> tuple[Column, Column, Column]:
    """Three projections that follow each other: ``pieces``, those of them (``at``) where a window may start, and the windows of ``most`` terms."""
    opening = rf"^(?:[^a-z0-9]*+[a-z0-9]++){{1,{most}}}+[^a-z0-9]*+"  # no more of a piece can matter
    pieces = F.filter(F.split(F.lower(text), BREAKS), lambda x: x.rlike("[a-z0-9]"))
    pieces = F.transform(pieces, lambda x: F.concat(F.regexp_extract(F.regexp_replace(x, MARKS, ""), opening, 0), F.lit(" ")))
    hit = F.filter(F.transform("pieces", lambda x, i: F.when(x.rlike(rare), i + 1)), lambda i: i.isNotNull())
    at = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(i - (most - 1), F.lit(1)), i))))
    found = F.transform("at", lambda i: F.regexp_extract(F.array_join(F.slice("pieces", i, most), ""), opening, 0))
    return pieces, at, F.filter(found, lambda x: x.rlike(rare))


def template_structs(weights: Weights) -> Column:
    """The templates as one constant: number, length, terms with their parts of the squared norm, and the terms a unit needs or must not have.

    It is read from a text once, when the plan is made; built up of its parts it would be thousands of expressions.
    """
    out = []
    for k, size in enumerate(weights.sizes):
        own = {t: w for j, _, t, w, _ in weights.rows if j == k}
        out.append({"k": k, "size": size, "parts": [{"t": t, "w": w * w} for t, w in own.items()], "needs": needed(own), "bars": barred(own)})
    return F.from_json(F.lit(json.dumps(out)), "array<struct<k:int,size:int,parts:array<struct<t:string,w:double>>,needs:array<string>,bars:array<string>>>")


def scan_licences(files: DataFrame, *, key: str, path: str = "path", text: str = "text", least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """Add ``own_licence``, ``similarity``, ``inherited_licence``, ``inherited_from`` and ``licence`` to ``files``, without its text."""
    spark = files.sparkSession
    vocabulary = sorted({t for _, x in templates for t in terms(x)})
    n, df = term_counts(files, text, vocabulary)
    weights = Weights(n, df, templates, least)
    fields = "template", "licence", "term", "weight", "length"
    rows = F.from_json(F.lit(json.dumps([dict(zip(fields, r)) for r in weights.rows])), "array<struct<template:int,licence:string,term:string,weight:double,length:int>>")
    template_rows = spark.range(1).select(F.explode(rows).alias("x")).select("x.*")
    row = F.struct(F.col(key).alias("k"), F.xxhash64(path, text).alias("h"))
    base = files.drop("own_licence", "similarity", "inherited_licence", "inherited_from", "licence").withColumn("_key", row)

    # units
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    is_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    rare = "(?i)(?<![a-z0-9])(" + "|".join(sorted(weights.needed)) + ")(?![a-z0-9])" if weights.needed else "(?!)"
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(rare))
    lines = F.when(is_file, F.concat(lines, F.array(F.col(text)))).otherwise(lines)
    pieces, at, found = windows(F.col(text), rare, max(weights.sizes, default=1))
    speaks = F.arrays_overlap(F.split(F.lower(text), SPLIT), F.from_json(F.lit(json.dumps(sorted(weights.needed))), "array<string>"))
    units = base.where(speaks).select("_key", lines.alias("lines"), pieces.alias("pieces")).select("_key", "lines", "pieces", at.alias("at"))
    mark = lambda units, window: F.transform(units, lambda x: F.struct(x.alias("unit"), F.lit(window).alias("window")))
    units = units.select("_key", F.explode_outer(F.concat(mark(F.col("lines"), False), mark(found, True))).alias("u")).select("_key", "u.unit", "u.window").where("unit is not null").distinct()
    # a line is compared to all templates, a window to those it may reach, cut to their lengths
    parted = lambda x: F.filter(F.split(F.lower(x), SPLIT), lambda t: t != "")
    units = units.withColumn("all", parted(F.col("unit")))
    held = lambda x: F.aggregate(x["parts"], F.lit(0.0), lambda a, y: a + F.when(F.array_contains("all", y["t"]), y["w"]).otherwise(0.0))
    reached = F.filter(template_structs(weights), lambda x: held(x) >= (least * least) * 0.999)
    units = units.select("_key", "unit", "all", "window", F.explode_outer(F.when(F.col("window"), reached)).alias("x")).where("not window or x is not null")
    units = units.select("_key", "unit", "x", F.when(F.col("window"), F.slice("all", 1, F.col("x.size"))).otherwise(F.col("all")).alias("all"))
    # the templates that a unit may be
    fits = lambda x: ~F.arrays_overlap("all", x["bars"]) & (F.size(F.array_except(x["needs"], "all")) == 0)
    allowed = F.transform(F.filter(F.when(F.col("x").isNull(), template_structs(weights)).otherwise(F.array("x")), fits), lambda x: x["k"])
    units = units.select("_key", "unit", F.col("x.k").alias("only"), "all", allowed.alias("allowed")).where(F.size("allowed") > 0)
    # sparse vectors: distinct terms with their weights, and the norm
    weight_of = F.from_json(F.lit(json.dumps(weights.idf)), "map<string,double>")
    units = units.withColumn("known", F.array_distinct("all"))
    tf = lambda t: 1 + F.log(F.size(F.filter("all", lambda x: x == t)).cast("double"))
    units = units.withColumn("vector", F.transform("known", lambda t: F.struct(t.alias("term"), (tf(t) * F.coalesce(F.try_element_at(weight_of, t), F.lit(weights.other))).alias("w"))))
    units = units.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    pairs = units.select("_key", "unit", "only", "allowed", "norm", F.explode("vector").alias("v")).select("_key", "unit", "only", "allowed", "norm", F.col("v.term").alias("term"), F.col("v.w").alias("w")).join(F.broadcast(template_rows), "term")
    pairs = pairs.where(F.array_contains("allowed", F.col("template")))
    scored = pairs.groupBy("_key", "unit", "only", "template", "licence", "length").agg((F.sum(F.col("w") * F.col("weight")) / F.first("norm")).alias("cosine"))
    permille = F.round(F.col("cosine") * 1000).cast("long")
    order = F.struct((F.col("licence") == GENERIC).alias("g"), (-permille).alias("s"), (-F.col("length")).alias("l"), "licence")
    best = scored.where(F.col("cosine") >= least).groupBy("_key").agg(F.min(order).alias("b"), F.collect_set("licence").alias("all"))
    told = F.col("b.licence")
    for variant, base_of in VARIANTS:
        told = F.when((F.col("b.licence") == base_of) & F.array_contains("all", variant), F.lit(variant)).otherwise(told)
    best = best.select(F.col("_key").alias("_row"), told.alias("_told"), (-F.col("b.s") / 1000).alias("_near"))
    tag, title = F.regexp_extract(F.col(text), TAG, 1), F.lower(F.regexp_extract(F.col(text), TITLE, 1))
    known = F.array(*[F.lit(x) for x in sorted({x for x, _ in templates})])
    base_named = base.withColumn("_tag", F.when(F.array_contains(known, tag), tag)).withColumn("_title", F.try_element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), title))

    # inheritance
    slim = base_named.drop(text).withColumn("_dir", directory(F.col(path))).withColumn("_file", is_file)
    own = slim.join(best, slim["_key"].eqNullSafe(best["_row"]), "left").drop("_key", "_row")
    statement = F.when(F.col("_told") != GENERIC, F.col("_told"))
    own = own.withColumn("own_licence", F.coalesce("_tag", statement, "_title", "_told")).withColumn("similarity", F.when(F.col("_tag").isNull() & (statement.isNotNull() | F.col("_title").isNull()), F.col("_near")).when(F.col("own_licence").isNotNull(), F.lit(1.0))).drop("_tag", "_title", "_told", "_near")
    licensed = own.where(F.col("_file") & F.col("own_licence").isNotNull() & F.col("_dir").isNotNull()).groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "own_licence")).alias("b")).select("_at", F.col("b.own_licence").alias("_dir_licence"))
    dirs = slim.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))).alias("a")).select("_dir", "a.depth", F.col("a.at").alias("_at"))
    nearest = above.join(licensed, "_at").groupBy("_dir").agg(F.max(F.struct("depth", "_at", "_dir_licence")).alias("b")).select(F.col("_dir").alias("_d"), F.col("b._at").alias("_from"), F.col("b._dir_licence").alias("_got"))
    out = own.join(nearest, own["_dir"] == nearest["_d"], "left")
    none = F.col("own_licence").isNull()
    return out.select(
        *[c for c in base.columns if c not in (text, "_key")], "own_licence", "similarity",
        F.when(none, F.col("_got")).alias("inherited_licence"), F.when(none, F.col("_from")).alias("inherited_from"), F.coalesce("own_licence", "_got").alias("licence"),
    )
