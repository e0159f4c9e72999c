"""License scans: sparse TF-IDF cosine of lines, windows of lines and whole files to templates, then inheritance along paths.

Only DataFrame functions. Terms are runs of a-z and 0-9 of the lower-case text. The weight of a template's term
is its frequency times ``ln((documents + 1) / (documents with it + 1)) + 1``, over all documents; other terms
weigh 1. Lines and windows of adjoining lines are compared with notices and short licences, whole files also with
full licence texts. The closest template that reaches the threshold names the licence. A file without a licence of
its own takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywright.llm.common import ROW, run_parts, stored

#: Wording of common notices, by SPDX name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Licences of the GNU family: SPDX name, words of its name, version.
GNU = (
    ("AGPL-3.0", "GNU Affero General Public License", "3"), ("GFDL-1.2", "GNU Free Documentation License", "1.2"), ("GFDL-1.3", "GNU Free Documentation License", "1.3"),
    ("GPL-1.0", "GNU General Public License", "1"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
)
#: Creative Commons 4.0 licences: short name, words of its name.
COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution ShareAlike"), ("BY-NC", "Attribution NonCommercial"), ("BY-NC-SA", "Attribution NonCommercial ShareAlike"),
    ("BY-ND", "Attribution NoDerivatives"), ("BY-NC-ND", "Attribution NonCommercial NoDerivatives"),
)
#: Other licences that a line may name.
NAMED = (
    ("0BSD", "Zero-Clause BSD License"), ("Artistic-2.0", "Artistic License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"), ("EPL-1.0", "Eclipse Public License, version 1.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("ISC", "ISC License"), ("MPL-1.1", "Mozilla Public License, version 1.1"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("NCSA", "University of Illinois NCSA Open Source License"), ("OFL-1.1", "SIL Open Font License, Version 1.1"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"),
)
TEMPLATES = NOTICES + tuple((n, f"This work is licensed under the {name}, version {v}") for n, name, v in GNU) + tuple(
    (n, f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.")
    for n, name, v in GNU) + tuple((f"CC-{n}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License") for n, name in COMMONS if n != "BY") + tuple(
    (f"CC-{n}-4.0", f"Licensed under CC {n} 4.0") for n, _ in COMMONS if n != "BY-NC") + tuple((n, f"{first} under the {name}") for n, name in NAMED for first in ("Licensed", "Released")) + (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
#: Full texts of at most so many terms are also looked for as blocks within a file.
BLOCK_TERMS = 400
#: Lines (with a term) of a window.
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
#: A block this close goes before a notice: the first sentence of two licences may be the same.
BLOCK_SCORE = 0.85
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
FOUND = "struct<block:boolean,score:double,name:string>"


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Full licence texts by SPDX name, from the files beside this module."""
    folder = resources.files("tallywright.llm").joinpath("license_texts")
    return tuple(sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".txt")))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def template_terms(text: str) -> Counter:
    return Counter("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def weights_of(docs: DataFrame, text_col: str, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template term, over all documents."""
    words = sorted({t for _, text in templates for t in template_terms(text)})
    each = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(terms(F.coalesce(F.col(text_col), F.lit("")))))).alias("term"))
    counts = each.filter(F.col("term").isin(["", *words])).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    seen = {r.term: r.n for r in counts.collect()}  # one row per template term
    total = seen.get("", 0)
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in words}


class Codes:
    """Terms as numbers: a template's term by its place among all of them, any other by a negative hash.

    Spark looks a key up in a map by scanning the keys, so the terms are dealt to many small maps by their hash. Weights
    and products then are constant arrays indexed by the number.
    """

    def __init__(self, spark: SparkSession, words: list[str], maps: int = 1024):
        self.place = {w: i for i, w in enumerate(words)}
        buckets: list[dict[str, int]] = [{} for _ in range(maps)]
        hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(maps)).alias("h")).collect() if words else []
        for row in hashed:
            buckets[row.h][row.w] = self.place[row.w]
        self.tables = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,bigint>>")  # constant, so the optimizer reads it once
        self.maps = maps

    def of(self, term: Column) -> Column:
        h = F.xxhash64(term)
        known = F.get(self.tables, F.pmod(h, F.lit(self.maps)).cast("int"))[term]
        return F.coalesce(known, F.when(h < 0, h).otherwise(-h - 1))

    def array(self, values: dict[str, float], default: float) -> Column:
        """A constant array of numbers by code."""
        line = [default] * len(self.place)
        for term, value in values.items():
            line[self.place[term]] = value
        return F.split(F.lit(" ".join(map(repr, line))), " ").cast("array<double>")

    def set(self, words) -> Column:
        return F.split(F.lit(" ".join(str(self.place[w]) for w in sorted(words))), " ").cast("array<bigint>")


def _words(words) -> Column:
    """A constant array of terms."""
    return F.split(F.lit(" ".join(words)), " ")


def anchors(idf: dict[str, float], threshold: float, templates=TEMPLATES) -> list[str]:
    """Terms of which a text must have one to reach the threshold.

    By Cauchy-Schwarz the cosine is at most the norm of the shared part of the template over the template's
    norm; so the most frequent terms of a template that together stay below the threshold can't do without others.
    """
    found: set[str] = set()
    for _, text in templates:
        squares = sorted((idf[t], t, (n * idf[t]) ** 2) for t, n in template_terms(text).items())
        bound, run = threshold**2 * sum(s for _, _, s in squares), 0.0
        for _, term, square in squares:
            run += square
            if run >= bound * (1 - 1e-5):
                found.add(term)
    return sorted(found)


def least_shared(own: Counter, idf: dict[str, float], threshold: float) -> int:
    """Different terms of the template that a text must have to reach the threshold, by the same bound."""
    squares = sorted(((n * idf[t]) ** 2 for t, n in own.items()), reverse=True)
    bound, run = threshold**2 * sum(squares) * (1 - 1e-5), 0.0
    for i, square in enumerate(squares, 1):
        run += square
        if run >= bound:
            return i
    return len(squares)


def cosines(tokens: Column, codes: Codes, idf: dict[str, float], templates=TEMPLATES, threshold: float = 0.0, block_terms: int = 1 << 30) -> Column:
    """Array of (block, score, name) for a non-empty array of coded terms, by template; null where the threshold is out of reach.

    Templates of at least ``block_terms`` terms are blocks.
    """
    weight = codes.array(idf, 1.0)
    start = F.struct(F.lit(0).cast("bigint").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))

    def add(state: Column, term: Column) -> Column:
        """The nth occurrence of a term makes its square grow from (n - 1)^2 to n^2."""
        run = F.when(state["term"] == term, state["run"] + 1).otherwise(F.lit(1.0))
        own = F.coalesce(_known(weight, term), F.lit(1.0))
        return F.struct(term.alias("term"), run.alias("run"), (state["squares"] + (run * 2 - 1) * own * own).alias("squares"))

    def scores(facts: Column) -> Column:
        out = []
        for name, text in templates:
            own = template_terms(text)
            length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
            product = codes.array({t: n * idf[t] ** 2 for t, n in own.items()}, 0.0)
            score = F.round(_dot(facts["known"], product) / facts["norm"] / length, 6)
            block = (score >= BLOCK_SCORE) if sum(own.values()) >= block_terms else F.lit(False)
            found = F.struct(block.alias("block"), score.alias("score"), F.lit(name).alias("name"))
            out.append(F.when(_reaches(facts["different"], codes, own, idf, threshold), found))
        return F.array(*out)

    norm = F.sqrt(F.aggregate(F.array_sort(tokens), start, add)["squares"])
    known = F.filter(tokens, lambda t: t >= 0)
    facts = F.array(F.struct(norm.alias("norm"), F.transform(known, lambda t: t.cast("int")).alias("known"), F.array_distinct(known).alias("different")))
    return F.flatten(F.transform(facts, scores))  # one norm for all templates


def _known(values: Column, code: Column) -> Column:
    """The value of a template's term; NULL for any other."""
    return F.get(values, F.when(code >= 0, code).cast("int"))


def _reaches(different: Column, codes: Codes, own: Counter, idf: dict[str, float], threshold: float) -> Column:
    """Whether enough of the template's terms are there; ``different`` has each of the text's template terms once."""
    least = least_shared(own, idf, threshold)
    return (F.size(different) >= least) & (F.size(F.array_intersect(different, codes.set(own))) >= least)


def _any_reaches(different: Column, codes: Codes, idf: dict[str, float], threshold: float, templates) -> Column:
    out = F.lit(False)
    for _, text in templates:
        out = out | _reaches(different, codes, template_terms(text), idf, threshold)
    return out


def _dot(tokens: Column, product: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda total, term: total + F.get(product, term))


def _best(found: Column) -> Column:
    """A block before a notice, then the highest score; ties to the first name."""
    def before(x: Column, a: Column) -> Column:
        same = x["block"] == a["block"]
        return (x["block"] & ~a["block"]) | (same & ((x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["name"] < a["name"]))))

    return F.aggregate(found, F.lit(None).cast(FOUND), lambda a, x: F.when(x.isNotNull() & (a.isNull() | before(x, a)), x).otherwise(a))


def windows_of(lines: Column, near: Column, heavy: Column) -> Column:
    """Coded terms of each window of adjoining lines that has a term of ``heavy``, and one of ``near`` in its first and last line.

    ``lines`` has only lines with a term. A line at the edge without a term of a template can only lower the cosine.
    """
    n = F.size(lines)
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.arrays_overlap(F.get(lines, i), heavy))
    edges = F.transform(lines, lambda t: F.exists(t, lambda x: F.coalesce(_known(near, x), F.lit(0.0)) > 0))

    def of_size(size: int, edge: Column, hit: Column) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(F.lit(0), i - size + 1), F.least(i, n - size)))))
        starts = F.filter(starts, lambda i: F.get(edge, i) & F.get(edge, i + size - 1))
        return F.when(n >= size, F.transform(starts, lambda i: F.flatten(F.slice(lines, i + 1, size)))).otherwise(F.array().cast("array<array<bigint>>"))

    marks = F.array(F.struct(edges.alias("edge"), hits.alias("hit")))
    return F.array_distinct(F.flatten(F.flatten(F.transform(marks, lambda m: F.array(*[of_size(k, m["edge"], m["hit"]) for k in WINDOWS])))))


def scan(docs: DataFrame, keep: list[str], path: Column, text_col: str = "text", threshold: float = 0.6, file_threshold: float = 0.9, templates=TEMPLATES, texts=None) -> DataFrame:
    """Columns ``keep`` packed as ``_row``, with path, license, kind and score of every document.

    kind: ``file`` (the whole text reaches ``file_threshold`` of a full licence text, or a file with a licence's name has a close
    line), ``header`` (a line or a window of adjoining lines is close), ``inherited`` (from the nearest directory above that holds a
    ``file``; of several there the highest score, then the first name), ``none``. A text that is only a notice is a ``header`` and gives
    nothing to its folder. Null and empty texts and texts without a term have
    none of their own and may inherit. A null path has no directory: it neither gives nor inherits. Ties go to
    the first licence name; equal rows get equal results; an empty table gives an empty result. A long text is scored
    line by line and window by window: each close line is in at most 76 windows, and each of these is one row. ``templates`` are
    notices, ``texts`` whole licences (by default ``full_texts()``).
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(ROW), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = full_texts() if texts is None else texts
    idf = weights_of(docs, text_col, [*templates, *texts])
    shorts = [(n, t) for n, t in texts if sum(template_terms(t).values()) <= BLOCK_TERMS]
    parts, wholes = [*templates, *shorts], list(texts)
    least_block = min([sum(template_terms(t).values()) for _, t in shorts], default=1 << 30)
    heavy = sorted({*anchors(idf, threshold, parts), *anchors(idf, file_threshold, wholes)})
    codes = Codes(docs.sparkSession, sorted(idf))
    near = codes.array({t: 1.0 for _, text in parts for t in template_terms(text)}, 0.0)
    lines = F.filter(F.transform(F.split("text", "\n"), terms), lambda t: F.size(t) > 0)
    marked = rows.withColumn("lines", lines).select(ROW, "path", F.when(
        F.exists("lines", lambda t: F.exists(t, lambda x: x.isin(heavy))), F.transform("lines", lambda t: F.transform(t, codes.of))).alias("lines"))
    marked = stored(marked.withColumn("rid", F.monotonically_increasing_id()), "lines")  # tables, so that no step is computed once for each template
    coded = marked.filter("lines IS NOT NULL").select("rid", "lines").repartition(run_parts(docs))
    whole = coded.withColumn("whole", F.flatten("lines")).withColumn("different", F.array_distinct(F.filter("whole", lambda t: t >= 0)))
    best_whole = _best(cosines(F.col("whole"), codes, idf, wholes, file_threshold))
    whole = stored(whole.select("rid", "lines", best_whole.alias("all"), _any_reaches(F.col("different"), codes, idf, threshold, parts).alias("reaches")), "wholes")
    open_ = ~F.coalesce(F.col("all.score") >= file_threshold, F.lit(False)) & F.col("reaches")
    window = whole.filter(open_).select("rid", F.explode(windows_of(F.col("lines"), near, codes.set(heavy))).alias("window"))
    window = stored(window.repartition(run_parts(docs)), "windows")
    found = window.select("rid", _best(cosines(F.col("window"), codes, idf, parts, threshold, least_block)).alias("f")).filter(F.col("f.score") >= threshold)
    order = F.struct((~F.col("f.block")).alias("a"), (-F.col("f.score")).alias("b"), F.col("f.name").alias("c"))
    best_line = found.groupBy("rid").agg(F.min(order).alias("o")).select("rid", F.struct((~F.col("o.a")).alias("block"), (-F.col("o.b")).alias("score"), F.col("o.c").alias("name")).alias("line"))
    scored = marked.select("rid", ROW, "path").join(whole.select("rid", "all"), "rid", "left").join(best_line, "rid", "left")
    name = F.element_at(F.split("path", "/"), -1)
    scored = scored.select(ROW, "path", "line", "all", F.coalesce(name.rlike(FILE_NAME), F.lit(False)).alias("by_name"))
    closer = F.when(F.coalesce(F.col("all.score") >= file_threshold, F.lit(False)), F.struct(F.lit("file").alias("kind"), F.col("all.name").alias("name"), F.col("all.score").alias("score"))).when(
        F.col("line.score") >= threshold, F.struct(F.when(F.col("by_name"), "file").otherwise("header").alias("kind"), F.col("line.name").alias("name"), F.col("line.score").alias("score")))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    own = stored(scored.select(ROW, "path", closer.alias("own"), folder.alias("folder")), "licenses")

    givers = own.filter("own.kind = 'file' AND folder IS NOT NULL").groupBy(F.col("folder").alias("above")).agg(
        F.min(F.struct((-F.col("own.score")).alias("order"), F.col("own.name").alias("name"))).alias("gives"))
    folders = own.filter("folder IS NOT NULL AND own IS NULL").select("folder").distinct()
    depth = F.size(F.split("folder", "/"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))))
    nearest = stored(folders.select("folder", F.posexplode(above).alias("level", "above")).join(givers, "above").groupBy("folder").agg(
        F.max_by("gives", "level").alias("gives")), "nearest")  # a table of its own, so that a folder with many files can be split in the join
    joined = own.join(nearest.withColumnRenamed("folder", "_folder"), F.col("folder") == F.col("_folder"), "left")
    taken = F.col("own").isNull() & F.col("gives").isNotNull()
    return joined.select(
        ROW, "path", F.when(taken, F.col("gives.name")).otherwise(F.col("own.name")).alias("license"),
        F.when(taken, F.lit("inherited")).otherwise(F.coalesce("own.kind", F.lit("none"))).alias("kind"),
        F.when(taken, -F.col("gives.order")).otherwise(F.col("own.score")).alias("score"))
