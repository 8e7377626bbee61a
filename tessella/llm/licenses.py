"""License scans by MinHash bands over overlapping text windows (operator 1), DataFrame functions only.

Words are runs of ASCII letters and digits in lower case; shingles are five words. Templates are classed by their
number of shingles m into powers of two P (P/2 < m <= P). A text is seen through windows of P + P/4 shingles that
start every P/4, so that each occurrence lies whole in some window. Windows without any template shingle can't
contain a template and are passed over; the others get ``BANDS`` MinHash values, each a band of one row.

At containment 0.8 the Jaccard similarity of template and window is 0.29 at least (m = P/2 + 1, the window otherwise
full of other text), so that a true match collides in some band with probability 1 - 0.71^32 > 0.99998; a whole
template (0.4 at least) with 1 - 0.6^32 > 0.9999999. Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table
from tessella.plans.storage import row_id, stage

WIDTH = 5
CONTAINMENT = 0.8
BANDS = 32

# Short public license notices.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")


def _shingle(w: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)])


def _shingles(w: Column, first: Column, last: Column) -> Column:
    """Hashes of the shingles ``first`` to ``last``; none if there are no such."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: _shingle(w, i))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, hashes, m, P``; a template has five words at least."""
    rows = spark.createDataFrame(list(templates.items()), "license string, body string").select("license", words(F.col("body")).alias("w"))
    rows = rows.select("license", F.array_distinct(_shingles(F.col("w"), F.lit(0), F.size("w") - WIDTH)).alias("hashes"))
    rows = rows.withColumn("m", F.size("hashes"))
    return rows.withColumn("P", F.pow(2, F.ceil(F.log2(F.col("m")))).cast("int"))


def minhash(hashes: Column) -> Column:
    """``BANDS`` band keys: the least of each seeded re-hash, with its band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j)))))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``id, license, containment, start_word, windows``: one row per row of ``df`` and license found in it.

    containment is the best over the text's windows, start_word the first word of the first matching window and
    windows their number. Null, empty and short texts match nothing; repeated rows match alike; overlapping licenses
    (a line within a longer notice) are all reported; an empty table gives an empty result.
    """
    spark = df.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates).collect()  # as large as the template list
    if bad := [t["license"] for t in known if not t["m"]]:
        raise ValueError(f"templates with fewer than {WIDTH} words: {bad}")
    every = sorted({h for t in known for h in t["hashes"]})
    classes = sorted({t["P"] for t in known})

    def look(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: _shingle(w, i).isin(every))
        hits = F.when(F.size(w) >= WIDTH, places).otherwise(F.array().cast("array<int>"))
        return F.struct(w.alias("w"), hits.alias("hits"))

    # the words are bound by a lambda, so that they are made once a text
    seen = F.get(F.transform(F.array(words(F.col(text_col))), look), F.lit(0))
    texts = stage(df.select(row_id(df).alias("rid"), F.col(id_col).alias("id"), seen.alias("t")).where("size(t.hits) > 0"), "license-texts")
    sized = F.explode(F.array(*[F.struct(F.lit(p).alias("P"), F.lit(max(1, p // 4)).alias("step"), F.lit(p + max(1, p // 4)).alias("len")) for p in classes]))
    at = texts.select("rid", "id", "t", sized.alias("c"))
    step, size = F.col("c.step"), F.col("c.len")
    starts = F.transform("t.hits", lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / step)).cast("int"), F.floor(p / step).cast("int")))
    at = at.select("rid", "id", F.col("c.P").alias("P"), "t", size.alias("len"), F.explode(F.array_distinct(F.flatten(F.transform(starts, lambda k: F.transform(k, lambda x: x * step))))).alias("start"))
    inside = _shingles(F.col("t.w"), F.col("start"), F.least(F.col("start") + F.col("len") - 1, F.size("t.w") - WIDTH))
    windows = stage(at.select("rid", "id", "P", "start", F.array_distinct(inside).alias("hashes")), "license-windows")
    banded = windows.withColumn("band", F.explode(minhash(F.col("hashes"))))
    temps = template_table(spark, TEMPLATES if templates is None else templates).select("license", "m", "P", F.col("hashes").alias("own"))
    bands = temps.select("license", "P", F.explode(minhash(F.col("own"))).alias("band"))
    pairs = banded.select("rid", "P", "start", "band").join(bands, ["P", "band"]).select("rid", "P", "start", "license").distinct()
    checked = pairs.join(temps, ["license", "P"]).join(windows, ["rid", "P", "start"])
    share = F.size(F.array_intersect("hashes", "own")) / F.col("m")
    found = checked.select("rid", "id", "license", "start", share.alias("share")).where(F.col("share") >= containment)
    return found.groupBy("rid", "id", "license").agg(F.max("share").alias("containment"), F.min("start").cast("bigint").alias("start_word"), F.count("*").alias("windows")).drop("rid")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _op1_sql() -> str:
    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in TEMPLATES.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = "string_split(trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
WITH tw AS (SELECT license, {split.format(low.format("body"))} AS w FROM (VALUES {values}) t(license, body)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tm AS (SELECT license, count(*) AS m, pow(2, ceil(log2(count(*))))::INT AS p FROM ts GROUP BY license),
tc AS (SELECT license, m, p, greatest(1, p // 4) AS step, p + greatest(1, p // 4) AS size FROM tm),
dw AS (SELECT doc_id, {split.format(low.format("coalesce(text, '')"))} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
h AS (SELECT ds.doc_id, ds.pos, s, license, m, step, size FROM ds JOIN ts USING (s) JOIN tc USING (license)),
k AS (SELECT *, unnest(range(greatest(0, ceil((pos - size + 1) / step))::BIGINT, (pos // step + 1)::BIGINT)) * step AS start FROM h),
c AS (SELECT doc_id, license, start, count(DISTINCT s) / any_value(m)::DOUBLE AS share FROM k GROUP BY ALL)
SELECT doc_id, license, max(share) AS containment, min(start)::BIGINT AS start_word, count(*) AS windows
FROM c WHERE share >= {CONTAINMENT} GROUP BY doc_id, license
"""


OP1_SQL = _op1_sql()
