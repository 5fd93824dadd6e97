"""License scan by MinHash bands over overlapping windows, native.

Texts and templates become hashed word shingles.  Windows as long as each length of template overlap by three
quarters; 24 bands of one MinHash value retrieve the templates of a window, and exact containment of the template's
shingles in the window's surroundings verifies them.  At a containment of 0.8 some window has a similarity of 0.4 or
more, so that no band agrees with probability below 1e-5; next to a whole copy it is 0.77 or more, and that below 1e-15.
Texts that share no shingle with any template, whose windows have similarity 0 with all of them, make no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.shared import Scratch, documents

SHINGLE = 5
BANDS, BAND_ROWS = 24, 1
CONTAINMENT = 0.8

#: Notices by which texts name their license.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def _tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != F.lit(""))


def _shingles(coded: str, size: int) -> Column:
    """Hashes of all runs of ``size`` tokens; none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.size(coded) - (size - 1))
    return F.when(F.size(coded) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(coded, i, size), F.lit(size)))).otherwise(F.array().cast("array<bigint>"))


def _seeded(seed: int):
    return lambda x: F.xxhash64(x, F.lit(seed))


def _bands(window: Column) -> Column:
    """Band hashes of a window's shingles: each of BAND_ROWS MinHash values."""
    low = [F.array_min(F.transform(window, _seeded(k))) for k in range(BANDS * BAND_ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *low[b * BAND_ROWS : (b + 1) * BAND_ROWS]) for b in range(BANDS)])


def _places(size: int, known: list[int]) -> Column:
    """Positions, from 1, of the shingles that some template has."""
    shingles = f"s{size}"
    every = F.when(F.size(shingles) > 0, F.sequence(F.lit(1), F.size(shingles))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.get(shingles, i - 1).isin(*known))


def _windows(size: int, length: int) -> Column:
    """Windows of ``length`` shingles, a quarter of it apart, that hold one of the places; each with its surroundings."""
    step, shingles = max(1, length // 4), f"s{size}"
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - length) / step).cast("int"))
    numbers = F.array_distinct(F.flatten(F.transform(f"at{size}", lambda p: F.sequence(first(p), F.floor((p - 1) / step).cast("int")))))
    return F.transform(
        numbers,
        lambda j: F.struct(
            F.lit(size).alias("size"),
            F.slice(shingles, j * step + 1, length).alias("window"),
            F.slice(shingles, F.greatest(F.lit(1), (j - 1) * step + 1), length + 2 * step).alias("around"),
        ),
    )


def templates(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """(template, license, size, shingles, bands): shingles of five words, or of the whole notice if it is shorter."""
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(a).alias("license"), F.lit(t).alias("text")) for i, (a, t) in enumerate(notices)])
    plain = spark.range(1).select(F.inline(listed))
    coded = plain.select("template", "license", F.transform(_tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("coded"))
    size = F.least(F.lit(SHINGLE), F.size("coded"))
    per = [coded.where((size == k) & (F.size("coded") > 0)).select("template", "license", F.lit(k).alias("size"), _shingles("coded", k).alias("shingles")) for k in range(1, SHINGLE + 1)]
    out = per[0]
    for more in per[1:]:
        out = out.unionAll(more)
    return out.select("*", _bands(F.col("shingles")).alias("bands"))


def scan(docs: DataFrame, notices=NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment): each license of which a document holds a notice, with the best containment.

    Null and empty texts hold none; rows with equal ids, null ids among them, count as one document.  The catalogue of
    notices is a fixed list, so its tables are broadcast.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    catalogue = Scratch(spark, "licenses").write(templates(spark, notices).coalesce(1), "templates")
    known = [(r["size"], len(r["shingles"]), r["shingles"]) for r in catalogue.collect()]
    sizes = sorted({k for k, _, _ in known})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(_tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("coded"))
    rows = rows.select("doc_id", *[_shingles("coded", k).alias(f"s{k}") for k in sizes])
    mine = {k: sorted({x for size, _, s in known if size == k for x in s}) for k in sizes}
    # Places whose shingle is in some template; all windows that share anything with a template hold one of them.
    rows = rows.select("*", *[_places(k, mine[k]).alias(f"at{k}") for k in sizes])
    windows = [_windows(k, n) for k, n in sorted({(k, n) for k, n, _ in known})]
    any_place = sum((F.size(f"at{k}") for k in sizes), F.lit(0)) > 0
    cut = rows.select("doc_id", F.explode(F.when(any_place, F.flatten(F.array(*windows))).otherwise(F.array())).alias("x"))
    banded = cut.select("doc_id", F.col("x.size").alias("size"), F.col("x.around").alias("around"), F.explode(F.array_distinct(_bands(F.col("x.window")))).alias("band"))
    theirs = F.broadcast(catalogue.select("template", "license", "size", "shingles", F.explode("bands").alias("band")))
    met = banded.join(theirs, ["band", "size"])
    held = met.select("doc_id", "license", (F.size(F.array_intersect("around", "shingles")) / F.size(F.array_distinct("shingles"))).alias("c"))
    return held.where(F.col("c") >= containment).groupBy("doc_id", "license").agg(F.max("c").alias("containment"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLAIN = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
OP10_SQL = f"""
WITH notices(id, license, text) AS (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(t)})" for i, (a, t) in enumerate(NOTICES))}),
n AS (SELECT id, license, ws, least({SHINGLE}, len(ws)) AS k FROM (SELECT id, license, {_PLAIN} AS ws FROM notices)),
own AS (SELECT DISTINCT id, license, k, len(ws) - k + 1 AS size, greatest(1, (len(ws) - k + 1) // 4) AS step,
               array_to_string(ws[i : i + k - 1], ' ') AS s FROM n, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
need AS (SELECT id, count(*) AS n FROM own GROUP BY id),
d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS ws FROM documents),
there AS (SELECT r, doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS s
          FROM d, (SELECT DISTINCT k FROM n) ks, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - ks.k + 2))) AS i)),
hit AS (SELECT r, doc_id, id, license, size, step, i, s FROM there JOIN own USING (k, s)),
around AS (SELECT r, doc_id, id, license, s, j FROM hit,
           LATERAL (SELECT unnest(range(greatest(0, (i - size - step) // step - 1), (i - 1) // step + 2)) AS j)
           WHERE i BETWEEN greatest(1, (j - 1) * step + 1) AND greatest(1, (j - 1) * step + 1) + size + 2 * step - 1),
part AS (SELECT r, doc_id, a.id, license, j, CAST(count(DISTINCT s) AS DOUBLE) / any_value(need.n) AS c
         FROM around a JOIN need ON need.id = a.id GROUP BY ALL)
SELECT doc_id, license, max(c) AS containment FROM part WHERE c >= {CONTAINMENT} GROUP BY doc_id, license
"""
