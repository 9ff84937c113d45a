"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them. DataFrame functions only.

A text's word shingles are hashed; windows of two shingles, six words, start at every word, so each shingle stands in two, and those at the ends stand in one of their own. A band is the lesser of a window's two hashes after each was hashed anew with the band's number, so bands are independent. Templates are windowed alike. A window that stands in text and template alike meets in every band. A lone shingle is the lesser in one of its two windows with a probability of two thirds, that is, unless it is the greatest of three; that of a template of one shingle is always in the template's band, so it is met in one of ``BANDS`` with a probability of 1 - 3^-BANDS, over 0.999998. In a longer template it is, again, with two thirds; of two lone shingles, and fewer are never enough for a longer template, one is met with over 0.999999. Every template that met a document is then compared with all of its shingles exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import few_rows, stage

SHINGLE, BANDS = 5, 12
SIMILARITY = 0.8
TEMPLATE_SHINGLES = 200_000  # shingles of all templates that are broadcast, some 10 MB; of more, all joins are shuffled ones
SPLIT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

#: Notices as they are commonly printed.
TEMPLATES = [
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-short", "Released under the MIT License."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all else beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT, -1), "")


def _spread(tokens: Column, made) -> Column:  # noqa: ANN001
    """An array with ``made`` of each shingle's start; a text of fewer words is one shingle, one without words none."""
    last = F.greatest(F.size(tokens) - SHINGLE, F.lit(0))
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), made))


def shingle_hashes(tokens: Column) -> Column:
    return _spread(tokens, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))


def shingles(tokens: Column) -> Column:
    last = F.greatest(F.size(tokens) - SHINGLE, F.lit(0))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(SHINGLE)]))
    return F.array_distinct(F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(every))


def banded(df: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, band, low): a row per window and band of the rows' shingle hashes."""
    h = F.col(hashes)
    none = F.array().cast("array<bigint>")
    before = F.when(F.size(h) > 0, F.concat(F.slice(h, 1, 1), h)).otherwise(none)
    after = F.when(F.size(h) > 0, F.concat(h, F.slice(h, -1, 1))).otherwise(none)
    windows = df.select(key, F.explode(F.arrays_zip(before.alias("a"), after.alias("b"))).alias("w")).select(key, F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    rows = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return rows.select(key, "band", F.least(F.xxhash64("band", "a"), F.xxhash64("band", "b")).alias("low"))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(license_id, license_shingles); the list is a parameter, so its size is the caller's."""
    rows = spark.createDataFrame(templates, "license_id string, text string")
    return rows.select("license_id", words(F.col("text")).alias("tokens")).select("license_id", "tokens", shingles(F.col("tokens")).alias("license_shingles"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, license_id, n_shared, n_shingles, containment): each document's templates of which it holds ``similarity`` of the distinct shingles or more.

    A null or empty text holds none and gives no row; repeated rows give repeated rows; ids may be null; other columns are ignored. Texts of any length are windowed whole. Templates without words match nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = stage(template_table(spark, templates or TEMPLATES).filter(F.size("tokens") > 0), "templates")
    small = known.agg(F.sum(F.size("license_shingles"))).first()[0] or 0
    side = F.broadcast if small <= TEMPLATE_SHINGLES else (lambda df: df)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    # From an array of one, the words are a generated column: no filter is pushed below it with the splitting inside its lambda.
    hashed = lambda df, *cols: df.select(*cols, F.explode(F.array(words(F.col("text")))).alias("tokens")).select(*cols, shingle_hashes(F.col("tokens")).alias("h"))
    marks = banded(known.select("license_id", shingle_hashes(F.col("tokens")).alias("h")), "license_id", "h").distinct()
    met = banded(hashed(own, "key"), "key", "h").join(side(marks), ["band", "low"]).select("key", "license_id").distinct()
    met = stage(met, "license-candidates")
    found = own.join(F.broadcast(met) if few_rows(met) else met, "key").join(side(known.select("license_id", "license_shingles")), "license_id")
    # The words are a column of their own: inside the shingles' lambda they would be split anew for each shingle.
    found = found.select("id", "license_id", "license_shingles", words(F.col("text")).alias("tokens")).select("id", "license_id", "license_shingles", shingles(F.col("tokens")).alias("own"))
    # Exploded from an array of one, the count is out of the filter's reach, which else would be pushed below with the words inside the lambda.
    shared = F.explode(F.array(F.size(F.array_intersect("license_shingles", "own")).cast("long")))
    out = found.select("id", "license_id", shared.alias("n_shared"), F.size("license_shingles").cast("long").alias("n_shingles"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= similarity)


def _oracle() -> str:
    quoted = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in TEMPLATES)
    tokens = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
    every = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) END"
    return f"""
WITH t AS (SELECT license_id, {every} AS s FROM (SELECT license_id, {tokens} AS w FROM (VALUES {quoted}) v(license_id, text))),
d AS (SELECT doc_id, {every} AS s FROM (SELECT doc_id, {tokens} AS w FROM documents))
SELECT doc_id, license_id, CAST(len(list_intersect(t.s, d.s)) AS BIGINT) AS n_shared, CAST(len(t.s) AS BIGINT) AS n_shingles, CAST(len(list_intersect(t.s, d.s)) AS DOUBLE) / len(t.s) AS containment
FROM d, t WHERE len(list_intersect(t.s, d.s)) >= 0.8 * len(t.s)
"""


ORACLE = _oracle()
