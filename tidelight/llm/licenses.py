"""License texts found by diagonal voting. DataFrame functions only.

Words are lower-cased runs of letters, digits and non-ASCII characters. Every three-word window
of a document is hashed and joined to the places where a template has that window. A hit votes
for the diagonal ``place in the document - place in the template``: the start the template would
have. Votes are summed for each document, template and diagonal. Short phrases must have all
their votes on one diagonal, which is an exact place. For texts, neighbouring diagonals (words
put in or left out, up to as many as the template has) are merged, and a span is confirmed if its
hits cover enough of the template's windows. A second hash confirms each hit.

Only hits leave a document, combined on the map side; the template windows, a few thousand of
given texts, are broadcast. Texts are never shuffled.

Defined cases: a null or empty text has no words and no labels; rows equal in id and text give
equal results, one for each row; null ids are kept; an empty table gives no rows; other columns
are not read. ``n_base`` counts all places, overlapping ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, col, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3

#: Fixed phrases of the registered query: phrase, label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public license notices.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
     " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
     " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and"
     " this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
     " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
     " required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\""
     " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
     " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
     " version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
     " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later"
     " version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
     " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
     " conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
     " granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
     " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
     " publish, use, compile, sell, or distribute this software"),
)
SLACK = 4
COVER = 0.6


def words(text):
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(ws):
    """Structs (h, check) of the windows, in order."""
    gram = lambda i: (F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    places = F.sequence(F.lit(0), F.size(ws) - GRAM)
    made = F.transform(places, lambda i: F.struct(F.xxhash64(*gram(i)).alias("h"), F.hash(*gram(i)).alias("check")))
    return F.when(F.size(ws) >= GRAM, made)


def template_windows(spark: SparkSession, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """template, label, base, n_windows, place, h, check. A template is at least three words."""
    rows = [(f"b{i}", label, True, t) for i, (t, label) in enumerate(phrases)]
    rows += [(f"t{i}", label, False, t) for i, (label, t) in enumerate(texts)]
    given = spark.createDataFrame(rows, "template string, label string, base boolean, text string")
    made = given.withColumn("ws", words(F.col("text")))
    made = made.select("template", "label", "base", (F.size("ws") - GRAM + 1).alias("n_windows"), windows(F.col("ws")).alias("g"))
    return made.select("template", "label", "base", "n_windows", F.posexplode("g").alias("place", "g")).select(
        "template", "label", "base", "n_windows", "place", F.col("g.h").alias("h"), F.col("g.check").alias("check"))


def votes(docs: DataFrame, templates: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, digest, template, label, base, n_windows, diagonal, places: hits of each diagonal."""
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("digest"), words(col(text_col)).alias("ws"))
    rows = rows.select("doc_id", "digest", F.posexplode(windows(F.col("ws"))).alias("at", "g"))
    rows = rows.select("doc_id", "digest", "at", F.col("g.h").alias("h"), F.col("g.check").alias("check"))
    hits = rows.join(F.broadcast(templates), ["h", "check"])
    keys = ["doc_id", "digest", "template", "label", "base", "n_windows", (F.col("at") - F.col("place")).alias("diagonal")]
    # places of one template: at most its length
    return hits.groupBy(*keys).agg(F.collect_set("place").alias("places"))


def spans(diagonals: DataFrame, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """doc_id, digest, label, base, first, last, cover: confirmed places.

    Phrases: a full diagonal. Texts: a run of diagonals, each within ``slack`` or the length of the
    template of the one before, so that a notice with a page footer or a header inside is one span."""
    n = F.size("places")
    exact = diagonals.where(F.col("base") & (n == F.col("n_windows"))).select(
        "doc_id", "digest", "label", "base", F.col("diagonal").alias("first"), F.col("diagonal").alias("last"),
        F.lit(1.0).alias("cover"))
    own = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > F.greatest(F.lit(slack), "n_windows"), F.lit(True))
    runs = diagonals.where(~F.col("base")).withColumn("run", F.sum(fresh.cast("int")).over(own))
    merged = runs.groupBy("doc_id", "digest", "template", "label", "n_windows", "run").agg(
        F.min("diagonal").alias("first"), F.max("diagonal").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"))
    share = F.col("n") / F.col("n_windows")
    loose = merged.where(share >= cover).select(
        "doc_id", "digest", "label", F.lit(False).alias("base"), "first", "last", share.alias("cover"))
    return exact.unionByName(loose)


def scan(docs: DataFrame, phrases=PHRASES, texts=TEXTS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    spark = docs.sparkSession
    found = stage(votes(docs, template_windows(spark, phrases, texts), id_col, text_col))
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by = spans(found).groupBy("doc_id", "digest").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max("cover").alias("score"))
    by = by.withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_digest")
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("digest"),
                       F.coalesce(F.regexp_count(ascii_lower(col(text_col)), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle(phrases=PHRASES, texts=TEXTS) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    given = [(f"b{i}", label, "true", t) for i, (t, label) in enumerate(phrases)]
    given += [(f"t{i}", label, "false", t) for i, (label, t) in enumerate(texts)]
    rows = ",\n  ".join(f"({quote(n)}, {quote(label)}, {base}, {quote(t)})" for n, label, base, t in given)
    low = f"translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'"
    return f"""
WITH given(template, label, base, text) AS (VALUES
  {rows}),
tw AS (SELECT template, label, base, regexp_extract_all({low.format("text")}) AS ws FROM given),
tg AS (SELECT template, label, base, len(ws) - 2 AS n_windows, p - 1 AS place, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
       FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS p FROM tw)),
dw AS (SELECT doc_id, regexp_extract_all({low.format("coalesce(text, '')")}) AS ws FROM documents),
dg AS (SELECT doc_id, p - 1 AS pos, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
       FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM dw)),
v AS (SELECT doc_id, template, label, base, n_windows, pos - place AS diagonal, place FROM dg JOIN tg USING (g)),
full_ AS (SELECT doc_id, label, true AS base, diagonal AS first, 1.0::DOUBLE AS cover FROM v WHERE base
          GROUP BY doc_id, template, label, n_windows, diagonal HAVING count(DISTINCT place) = n_windows),
d AS (SELECT DISTINCT doc_id, template, n_windows, diagonal FROM v WHERE NOT base),
f AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > greatest({SLACK}, n_windows), true)::INT AS fresh FROM d
      WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM f),
loose AS (SELECT doc_id, label, false AS base, min(diagonal) AS first, count(DISTINCT place) / n_windows::DOUBLE AS cover
          FROM v JOIN r USING (doc_id, template, n_windows, diagonal) GROUP BY doc_id, template, label, n_windows, run
          HAVING count(DISTINCT place) / n_windows::DOUBLE >= {COVER}::DOUBLE),
s AS (SELECT * FROM full_ UNION ALL SELECT * FROM loose),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM dw LEFT JOIN a USING (doc_id)
"""
