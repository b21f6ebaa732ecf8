"""License scans by MinHash bands over overlapping text windows.

Words are lower-cased runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, shingles three words (a
text of one or two words has one). Templates are short notices or whole licences.

1. A document without any template's shingle can't contain a template; only others go on.
2. Their texts, and the templates, are cut into windows of ``WINDOW`` words, half a window apart. Each
   window has ``BANDS`` MinHash values, one in each band. Two windows of similarity J share a band with
   probability 1 - (1 - J)^64: over 0.998 from J = 0.1 on, which a notice of five words that stands in
   a window reaches. Bands that no template has are dropped before anything is exploded.
3. Each template that shares a band with a document is compared with it once, word for word: the share of the
   template's distinct shingles, as text, that the document holds must be at least 0.8.

Everything is DataFrame functions; arrays of a row are at most as long as its text, and only the
few documents of step 2 are shuffled: their words, once, and numbers.

Defined results: a row for each document and licence found (the best template of the licence);
null, empty and wordless texts have none; repeated documents each get their rows; no
templates or an empty table give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import materialise

SHINGLE = 3
WINDOW = 32
BANDS = 64
CONTAINED = 0.8
LITERAL_VALUES = 20_000  # template values up to this number are part of the scan's expression

#: Public licence notices (licence id, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of three consecutive words, by place; of all words where there are fewer."""
    last = F.size(w) - SHINGLE
    triple = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return (
        F.when(F.size(w) == 0, F.array().cast("array<long>"))
        .when(last < 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), triple))
    )


def spelled(w: Column) -> Column:
    """The same shingles as text."""
    last = F.size(w) - SHINGLE
    return F.when(last < 0, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " ")))


def windows(s: Column) -> Column:
    """Windows over a shingle array, half a window apart; the last one may be shorter."""
    width, step = WINDOW - SHINGLE + 1, WINDOW // 2
    count = F.greatest(F.ceil((F.size(s) - width) / F.lit(step)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(s, i * step + 1, F.lit(width)))


def bands(window: Column) -> Column:
    """One MinHash value in each band, hashed once more with the band's number."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, F.array_min(F.transform(window, lambda x: F.xxhash64(x, b)))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license_id string, text string")


def license_scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row for each document and licence: doc_id, license_id, containment, first_shingle."""
    # Words are a column of their own before shingles refer to them (else every shingle would split the
    # text again), and the row number beside the shingles keeps the filter from moving below them.
    named = templates.select("license_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("license_id", F.array_distinct(spelled(F.col("w"))).alias("t"), shingles(F.col("w")).alias("h"), F.monotonically_increasing_id().alias("template"))
    known = materialise(named.select("license_id", "template", "t", F.array_distinct("h").alias("h"), F.array_distinct(F.flatten(F.transform(windows(F.col("h")), bands))).alias("bands")))
    small = (known.agg(F.sum(F.size("bands"))).first()[0] or 0) <= LITERAL_VALUES
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    found = found.select("doc_id", "w", F.monotonically_increasing_id().alias("uid"), shingles(F.col("w")).alias("s"))
    if small:
        values = known.select(F.array_distinct(F.flatten(F.collect_set("h"))).alias("h"), F.array_distinct(F.flatten(F.collect_set("bands"))).alias("b")).first()
        of = lambda xs: F.array(*[F.lit(x) for x in xs or [0]])
        found = found.where(F.arrays_overlap("s", of(values["h"])))
        touched = F.filter(windows(F.col("s")), lambda w: F.arrays_overlap(w, of(values["h"])))
        hits = F.array_intersect(F.flatten(F.transform(touched, bands)), of(values["b"]))
    else:
        hits = F.array_distinct(F.flatten(F.transform(windows(F.col("s")), bands)))
    hit = found.select("uid", "doc_id", "w", hits.alias("hits"))
    if small:  # else every document goes on
        hit = hit.where(F.size("hits") > 0)
    hit = materialise(hit)
    by_band = known.select("template", F.explode("bands").alias("band"))
    met = hit.select("uid", F.explode("hits").alias("band")).join(F.broadcast(by_band) if small else by_band, "band").select("uid", "template").distinct()
    light = known.select("template", "license_id", "t")
    pairs = met.join(F.broadcast(light) if small else light, "template").join(hit.select("uid", "doc_id", spelled(F.col("w")).alias("s")), "uid")
    both = pairs.select("uid", "doc_id", "license_id", "t", "s", F.array_intersect("t", "s").alias("both"))
    exact = both.select("uid", "doc_id", "license_id", (F.size("both") / F.size("t")).alias("containment"), F.array_min(F.transform("both", lambda x: F.array_position("s", x))).alias("at")).where(
        F.col("containment") >= CONTAINED
    )
    best = exact.groupBy("uid", "doc_id", "license_id").agg(F.max(F.struct("containment", -F.col("at"))).alias("m"))
    return best.select("doc_id", "license_id", "m.containment", (-F.col("m.col2") - 1).cast("long").alias("first_shingle"))
