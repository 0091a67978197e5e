"""License scans: MinHash bands over overlapping windows find templates, exact containment decides.

A text is a sequence of lower-cased words of letters and digits; five words make a shingle.  For
each length of template, windows of twice that length begin at each multiple of it, so an unbroken
copy of the template lies whole in one window.  A window and a template are compared if one of
their minimum hashes agrees, and match if the window holds 0.8 of the template's different
shingles.  Windows without any shingle of a template of their length can't match and are left out
before hashing.  All steps are column expressions and joins with the small table of templates.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm.chat import let
from arbitra.llm.tables import ascii_lower

SHINGLE, MIN_CONTAINMENT = 5, 0.8
#: One row per band: with Jaccard similarity j a pair is missed with probability (1 - j)^BANDS.
BANDS = 64

#: Public notices and the opening of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-notice": "Released under the MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0-notice": "licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "licensed under CC BY-NC 4.0",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(ws: Column, size: int = SHINGLE) -> Column:
    """64-bit hash of the shingle that begins at each word."""
    return let(ws, lambda w: F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>")))


def shingles(ws: Column, size: int = SHINGLE) -> Column:
    """The different shingles as texts."""
    return let(ws, lambda w: F.when(
        F.size(w) >= size,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.concat_ws(" ", F.slice(w, i, size)))),
    ).otherwise(F.array().cast("array<string>")))


def stride(n_words: int) -> int:
    """The window step for a template: its length, rounded up by a quarter at most."""
    unit = max(1, 1 << (n_words.bit_length() - 3)) if n_words >= 16 else 1
    return -(-n_words // unit) * unit


def miss_probability(n_words: int, bands: int = BANDS, size: int = SHINGLE) -> float:
    """Upper bound on the chance that a window with just enough of a template shares no band."""
    n, window = n_words - size + 1, 2 * stride(n_words) - size + 1
    shared = ceil(MIN_CONTAINMENT * n)
    return (1 - shared / (window + n - shared)) ** bands


def band_values(hashes: Column, bands: int = BANDS) -> Column:
    """Array of (band, value): the least of the shingles' hashes under each band's function."""
    return let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(b.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, b))).alias("value")),
    ))


@dataclass
class Library:
    """The templates as a table, and the shingle hashes by step for filters.  Configuration."""

    table: DataFrame  # name, step, texts (different shingles), hashes
    hashes: dict[int, list[int]]


def library(spark: SparkSession, templates: Mapping[str, str]) -> Library:
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    made = rows.select("name", license_words(F.col("text")).alias("w")).select(
        "name", F.size("w").alias("n"), shingles(F.col("w")).alias("texts"), shingle_hashes(F.col("w")).alias("hashes")
    ).collect()
    short = [r["name"] for r in made if r["n"] < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    by_step: dict[int, set[int]] = {}
    for r in made:
        by_step.setdefault(stride(r["n"]), set()).update(r["hashes"])
    table = spark.createDataFrame(
        [(r["name"], stride(r["n"]), r["texts"], r["hashes"]) for r in made],
        "name string, step int, texts array<string>, hashes array<bigint>",
    )
    return Library(table, {s: sorted(h) for s, h in sorted(by_step.items())})


def _windows(ws: Column, hashes: Column, steps: Mapping[int, list[int]]) -> Column:
    """Array of (step, start, words, hashes) of all windows with a shingle of a template of their step."""
    each = []
    for step, known in steps.items():
        def of_step(h: Column, step: int = step, known: list[int] = known) -> Column:
            at = F.filter(F.transform(h, lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
            ks = F.array_distinct(F.flatten(F.transform(at, lambda p: F.filter(
                F.array((p / step).cast("int"), (p / step).cast("int") - 1),
                lambda k: (k >= 0) & (p - k * step <= 2 * step - SHINGLE),
            ))))
            return F.transform(ks, lambda k: F.struct(
                F.lit(step).alias("step"), (k * step).alias("start"),
                F.slice(ws, k * step + 1, 2 * step).alias("words"),
                F.slice(h, k * step + 1, 2 * step - SHINGLE + 1).alias("hashes"),
            ))
        each.append(of_step(hashes))
    return F.concat(*each)


def license_matches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES,
    min_containment: float = MIN_CONTAINMENT, bands: int = BANDS,
) -> DataFrame:
    """One row per document row and template found: id, license, containment, start.

    ``containment`` is the largest share of the template's different shingles in one window and
    ``start`` the first such window's first word, from 0.  A null, empty or short text has no
    match.  Repeated rows with one id give their matches once; other columns are ignored; an empty
    table gives no rows.
    """
    known = library(docs.sparkSession, templates)
    every = sorted({h for hs in known.hashes.values() for h in hs})
    rows = docs.select(F.col(id_col).alias("id"), license_words(F.col(text_col)).alias("w"))
    hashed = rows.select("id", "w", shingle_hashes(F.col("w")).alias("h")).where(F.arrays_overlap("h", F.lit(every)))
    windows = hashed.select("id", F.explode(_windows(F.col("w"), F.col("h"), known.hashes)).alias("x"))
    banded = windows.select(
        "id", "x.step", "x.start", shingles(F.col("x.words")).alias("seen"),
        F.explode(band_values(F.col("x.hashes"), bands)).alias("b"),
    ).select("id", "step", "start", "seen", "b.band", "b.value")
    wanted = known.table.select(
        "name", F.col("step").alias("of"), "texts", F.explode(band_values(F.col("hashes"), bands)).alias("b")
    ).select("name", "of", "texts", F.col("b.band").alias("t_band"), F.col("b.value").alias("t_value"))
    candidates = banded.join(
        wanted, (F.col("step") == F.col("of")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value"))
    )
    share = F.size(F.array_intersect("texts", "seen")) / F.size("texts")
    matches = candidates.select("id", "name", "start", share.alias("share")).where(F.col("share") >= min_containment)
    best = F.max(F.struct("share", (-F.col("start")).alias("back"))).alias("best")
    return matches.groupBy("id", "name").agg(best).select(
        F.col("id").alias(id_col), F.col("name").alias("license"), F.col("best.share").alias("containment"),
        (-F.col("best.back")).cast("long").alias("start"),
    )
