"""Licences of files: TF-IDF cosine to templates, then inheritance down the directory tree; DataFrame functions only.

Header candidates are the lines of a whole text that name a licence, with the line after.
Their words are weighted by inverse document frequency over all candidates and templates,
and compared with each template by cosine. A file takes its best header at or above the
threshold. A file without one inherits from the nearest directory, its own first, that has
a licence: that of the licence files in it (files that are mostly licence text), most
frequent first, ties by name.

Directories are resolved once each, not once a file: the directories of all files are
reduced before the shuffle, joined with the licensed ones on their ancestors, and files
meet their directory's answer in one join that AQE can split at a hot directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import hold

# How licences are commonly named in headers and licence files, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only",
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Dedicated to the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
MENTION = r"(?i)licen[cs]e|spdx|permission is hereby|redistribution and use|creative commons|public domain|\bcc0\b|\bcc by"
TOKEN = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
#: Least cosine of a header; share of a file's words in header lines from which it is a licence file; words of a candidate.
THRESHOLD, MOSTLY, MAX_WORDS = 0.6, 0.25, 64


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def candidates(files: DataFrame) -> DataFrame:
    """(file, line, words) of each line that names a licence.

    A longer line is cut into windows of ``MAX_WORDS`` words, half overlapping, so a header inside it is not drowned.
    """
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n", -1), lambda x: x.rlike(MENTION))
    words = files.where(F.col("_text").rlike(MENTION)).select("file", F.posexplode(lines).alias("line", "said")).select("file", "line", tokens(F.col("said")).alias("words"))
    half = MAX_WORDS // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - half - 1, F.lit(0)), F.lit(half))
    return words.where(F.size("words") > 0).select("file", "line", F.posexplode(F.transform(starts, lambda i: F.slice("words", i + 1, MAX_WORDS))).alias("part", "words"))


def _bag(words: Column) -> Column:
    return F.sha2(F.concat_ws(" ", F.array_sort(words)), 256)


def own_licences(files: DataFrame) -> DataFrame:
    """(file, licence, cosine, said) of each file with a header that reaches the threshold.

    The licence is that of the best header, ties by identifier; ``said`` counts the words of all such headers.
    """
    heads = hold(candidates(files).withColumn("bag", _bag(F.col("words"))))
    # Headers of the same words are one bag, scored once; whole groups of copies fall together here.
    known = files.sparkSession.createDataFrame(
        [(name, f"{name} {k}", said) for name, some in TEMPLATES.items() for k, said in enumerate(some)], "licence string, bag string, said string",
    ).select("licence", "bag", tokens(F.col("said")).alias("words"))
    bags = heads.groupBy("bag").agg(F.min("words").alias("words")).unionByName(known.select("bag", "words"))
    terms = hold(bags.select("bag", F.explode("words").alias("word")).groupBy("bag", "word").count())
    total = float(terms.select("bag").distinct().count())
    idf = hold(terms.groupBy("word").agg((F.log((total + 1) / (F.count("*") + 1)) + 1).alias("idf")))
    weights = hold(terms.join(idf, "word").select("bag", "word", (F.col("count") * F.col("idf")).alias("w")))
    unit = hold(weights.groupBy("bag").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    sparse = _template_vectors(weights, unit, known)
    dots = weights.join(F.broadcast(sparse), "word").groupBy("bag", "licence", "template").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    best = (
        dots.join(unit, "bag").select("bag", "licence", cosine.alias("cosine")).where(F.col("cosine") >= THRESHOLD)
        .groupBy("bag").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("best"))
    )
    placed = heads.select("file", F.size("words").alias("n"), "bag").join(hold(best), "bag")
    return placed.groupBy("file").agg(F.min("best").alias("best"), F.sum("n").alias("said")).select(
        "file", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("cosine"), "said",
    )


def _template_vectors(weights: DataFrame, unit: DataFrame, known: DataFrame) -> DataFrame:
    """(licence, template, word, t) with unit length; some words for each fixed template, so it may be broadcast."""
    named = F.broadcast(known.select("licence", "bag"))
    return weights.join(named, "bag").join(unit.join(named.select("bag"), "bag"), "bag").select(
        "licence", F.col("bag").alias("template"), "word", (F.col("w") / F.col("norm")).alias("t"),
    )


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first, the root as an empty text."""
    parts = F.split(directory, "/", -1)
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.struct(
        F.array_join(F.slice(parts, 1, n), "/").alias("above"), (F.size(parts) - n).alias("steps"),
    ))


def file_licences(files: DataFrame, path: str = "path", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keys, licence, cosine, origin, from_dir): one row for each row of ``files``.

    ``origin`` is ``header`` for a file with a header of its own, ``directory`` for one that
    inherits (from ``from_dir``), else null with a null licence. Null and empty texts have no
    header and inherit; a null path neither inherits nor gives. Rows that repeat a path
    are files of their own. Directories end at the last ``/``; a path without one lies in the root.
    """
    rows = hold(files.select(
        F.col(path).alias("_path"), *keys, F.xxhash64(F.col(path), F.col(text), *keys).alias("file"),
        F.regexp_replace(F.col(path), "/?[^/]*$", "").alias("_dir"), F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("_size"),
    ))
    named = files.select(F.xxhash64(F.col(path), F.col(text), *keys).alias("file"), F.col(text).alias("_text"))
    own = hold(own_licences(named))
    # Rows that are copies of one another share a key here, so what they say is divided among them.
    copies = rows.join(own.select("file"), "file").groupBy("file").agg(F.count("*").alias("copies"), F.first("_dir").alias("_dir"), F.first("_size").alias("_size"), F.first("_path").alias("_path"))
    sure = F.col("_path").rlike(r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$") | (F.col("said") / F.col("copies") >= MOSTLY * F.col("_size"))
    given = hold(
        copies.join(own, "file").where(F.col("_dir").isNotNull() & sure).groupBy("_dir", "licence").agg(F.sum("copies").alias("n"))
        .groupBy("_dir").agg(F.min(F.struct((-F.col("n")).alias("minus"), "licence")).alias("best")).select(F.col("_dir").alias("above"), F.col("best.licence").alias("given"))
    )
    directories = rows.select("_dir").where("_dir is not null").distinct()
    nearest = hold(
        directories.select("_dir", F.inline(ancestors(F.col("_dir")))).join(given, "above")
        .groupBy("_dir").agg(F.min(F.struct("steps", "above", "given")).alias("best"))
        .select(F.col("_dir").alias("of"), F.col("best.above").alias("from_dir"), F.col("best.given").alias("given"))
    )
    found = rows.join(own.select("file", "licence", "cosine"), "file", "left").join(nearest, F.col("_dir") == F.col("of"), "left")
    header = F.col("licence").isNotNull()
    return found.select(
        F.col("_path").alias(path), *keys, F.coalesce("licence", "given").alias("licence"), "cosine",
        F.when(header, "header").when(F.col("given").isNotNull(), "directory").alias("origin"), F.when(~header, F.col("from_dir")).alias("from_dir"),
    )
