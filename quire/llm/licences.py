"""Licence scans: MinHash bands over overlapping windows, then exact containment.

A template of L words belongs to the window class w, the least power of two that
is L or more and 8 or more. Windows of 2w words start at every w words, so that
every passage of up to w words lies whole in one of them. Only windows that hold
a shingle of some template of their class are looked at: no other window can
contain any of it. Window and template meet under equal values of one of BANDS
MinHash functions (bands of one row). A window that contains SIMILARITY of a
template of m shingles has a Jaccard similarity j of 0.8m / (2w - 4 + 0.2m) or
more with it, and is found with probability 1 - (1 - j) ** BANDS: for the
shortest template, of five words, j is 1/12 and the probability above 0.9997.
Matches are then verified: the share of the template's distinct five-word
shingles that the window has.

All steps are DataFrame functions. Defined results: null or empty text matches
nothing; repeated rows of one doc_id count once; a null doc_id is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .shingles import WIDTH, rows, small, text_shingles, with_spots, words

BANDS, SIMILARITY, LEAST_CLASS = 96, 0.8, 8

#: Templates: name, licence, text (fixed values; wordings of public licences).
TEMPLATES = [
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl3-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "LGPL", "under the terms of the GNU Lesser General Public License"),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("rights-reserved", "proprietary", "All rights reserved. No part of this publication may be reproduced"),
]


def window_class(n_words: int) -> int:
    w = LEAST_CLASS
    while w < n_words:
        w *= 2
    return w


def minhash(sh):
    """Values of BANDS MinHash functions of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array_min(F.transform(sh, lambda x: F.xxhash64(x, i))))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]]) -> DataFrame:
    """template, licence, w, sh: those with a shingle at least."""
    base = rows(spark, templates, ["template", "licence", "text"]).withColumn("words", words(F.col("text")))
    w = F.greatest(F.lit(LEAST_CLASS), F.pow(F.lit(2), F.ceil(F.log2(F.size("words")))).cast("int"))
    return base.select("template", "licence", w.alias("w"), F.array_distinct(text_shingles(F.col("text"))).alias("sh")).where("size(sh) > 0")


def licence_scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, template, licence, containment, n_windows) of what each text contains."""
    spark = docs.sparkSession
    known = cut(template_table(spark, TEMPLATES if templates is None else templates), "templates")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    shingled = own.select("doc_id", text_shingles(F.col("text")).alias("sh"))
    keys = known.select(F.explode("sh").alias("h"), "w").distinct()
    hits = shingled.select("doc_id", F.posexplode("sh").alias("pos", "h")).join(small(keys), "h").select("doc_id", "pos", "w")
    # A shingle at a word is in the window that begins at the multiple of w before it, and in the one before that if it still ends there.
    last = F.expr("pos div w").cast("int")
    first = F.greatest(F.lit(0), F.when(F.col("pos") % F.col("w") <= F.col("w") - WIDTH, last - 1).otherwise(last))
    spots = hits.select("doc_id", "w", F.explode(F.sequence(first, last)).alias("k")).distinct()
    part = with_spots(own, cut(spots, "spots"), F.struct("w", "k")).select("doc_id", text_shingles(F.col("text")).alias("sh"), "spots").select("doc_id", "sh", F.explode("spots").alias("s")).select("doc_id", F.col("s.w").alias("w"), F.array_distinct(F.slice("sh", F.col("s.k") * F.col("s.w") + 1, 2 * F.col("s.w") - WIDTH + 1)).alias("win"), F.col("s.k").alias("k"))
    part = cut(part.select("doc_id", "w", "k", "win", F.xxhash64("w", F.array_sort("win")).alias("g")), "windows")
    # Equal windows are looked up once.
    kinds = part.dropDuplicates(["g"]).select("g", "w", "win")
    banded = kinds.select("g", "w", F.posexplode(minhash(F.col("win"))).alias("band", "value"))
    bands = known.select("template", "w", F.posexplode(minhash(F.col("sh"))).alias("band", "value"))
    near = banded.join(small(bands), ["w", "band", "value"]).select("g", "template").distinct()
    share = F.size(F.array_intersect("sh", "win")) / F.size("sh")
    found = near.join(kinds.select("g", "win"), "g").join(small(known), "template").withColumn("containment", share).where(F.col("containment") >= SIMILARITY)
    found = found.select("g", "template", "licence", "containment")
    return part.select("doc_id", "k", "g").join(found, "g").groupBy("doc_id", "template", "licence").agg(F.max("containment").alias("containment"), F.count_distinct("k").alias("n_windows"))


def oracle(templates: list[tuple[str, str, str]] | None = None) -> str:
    """DuckDB: containment in all windows, without any hashing."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in t) + ")" for t in (TEMPLATES if templates is None else templates))
    return f"""
    WITH t0 AS (SELECT * FROM (VALUES {quoted}) v(template, licence, text)),
    t1 AS (SELECT template, licence, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM t0),
    t2 AS (SELECT template, licence, greatest({LEAST_CLASS}, CAST(pow(2, ceil(log2(len(w)))) AS INT)) AS c,
                  list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS sh FROM t1 WHERE len(w) >= {WIDTH}),
    ts AS (SELECT template, licence, c, len(sh) AS m, unnest(sh) AS s FROM t2),
    d1 AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    d2 AS (SELECT doc_id, w, unnest(range(0, len(w) - {WIDTH} + 1)) AS pos FROM d1),
    ds AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {WIDTH}], ' ') AS s FROM d2),
    hit AS (SELECT doc_id, template, licence, m, c, pos, s FROM ds JOIN ts USING (s)),
    win AS (SELECT *, pos // c AS k FROM hit UNION ALL SELECT *, pos // c - 1 AS k FROM hit WHERE pos // c > 0 AND pos % c <= c - {WIDTH}),
    per AS (SELECT doc_id, template, licence, k, count(DISTINCT s) / any_value(m) AS containment FROM win GROUP BY ALL)
    SELECT doc_id, template, licence, max(containment) AS containment, count(DISTINCT k) AS n_windows FROM per WHERE containment >= {SIMILARITY} GROUP BY doc_id, template, licence
    """
