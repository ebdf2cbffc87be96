"""Licence scan; built-in expressions only.

Vectors are sparse TF-IDF, compared by their cosine (idf of the template words
over all documents; other words weigh 1). Lines are compared with notice
templates. A template can only reach the limit with a line that holds one of its
heaviest words, so lines without any of those are left out before words are
counted; that loses nothing. The whole text and its head are compared with whole
licence texts and standard headers, there with 1 + ln of each count; the head for
a template is as long as it, or ``MORE`` words longer. A text that lacks so many words of
a template that the rest cannot reach the limit is left out, which loses nothing.

A document's licence is that of its SPDX line, else of its whole text, else of its
head, else of its best line. A document is a licence file if its whole text reaches
the limit or its matching lines hold at least ``file_share`` of its words. Licence
files speak for their directory (the licence of most of them); a document without a
licence of its own inherits from the nearest ancestor directory that has one.

A null or empty text has no licence of its own. A path without a slash lies in the
root directory, '', which is above all others. A null path or an empty one has no
directory. Ties go to the first name. Repeated rows are judged like others.
Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitally.session import settle

from .license_texts import HEADERS, TEXTS

# Short notices by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
# Further short forms, which the SQL twin does not have.
NOTICES = (
    ("MIT", "MIT License"),  # not with "mit" twice: German lines would match
    ("MIT", "Licensed under the MIT License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("GPL-1.0-or-later", "GNU General Public License"),  # any version, as none is named
    ("GPL-3.0", "GNU General Public License version 3"),
    ("GPL-3.0", "Licensed under the GNU GPL v3"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-2.0", "Licensed under the GNU GPL v2"),
    ("LGPL-2.0-or-later", "GNU Lesser General Public License"),
    ("AGPL-3.0", "GNU Affero General Public License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("ISC", "ISC License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
)
BREAK = "[^a-z0-9]+"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9.+:-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9.+:-]+\)*)*)"
LIMIT, FILE_SHARE, SALTS, MORE = 0.75, 0.5, 16, 40
WHOLE = -1  # the unit of the whole text; a head of n words is -1 - n, lines are 0 and more


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.lower()) if w]


def template_vectors(templates, idf: dict[str, float], damped: bool = False) -> list[tuple[int, str, str, float]]:
    """number, licence, word, weight of unit vectors."""
    out = []
    for number, (name, text) in enumerate(templates):
        counts = Counter(words_of(text))
        weight = {w: (1 + math.log(n) if damped else n) * idf[w] for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        out += [(number, name, w, x / norm) for w, x in sorted(weight.items())]
    return out


def anchors(vectors, limit: float) -> list[str]:
    """For each template its heaviest words, so many that a line without them
    cannot reach the limit."""
    out, of = set(), {}
    for number, _, word, weight in vectors:
        of.setdefault(number, []).append((-weight, word))
    for words in of.values():
        left = 1.0
        for weight, word in sorted(words):
            if left < (limit - 1e-9) ** 2:
                break
            out.add(word)
            left -= weight * weight
    return sorted(out)


def fewest(vectors, limit: float) -> dict[int, int]:
    """For each template the number of its words below which no text reaches the limit."""
    out, of = {}, {}
    for number, _, _, weight in vectors:
        of.setdefault(number, []).append(weight * weight)
    for number, squares in of.items():
        held, out[number] = 0.0, 0
        for square in sorted(squares, reverse=True):
            if held >= (limit - 1e-9) ** 2:
                break
            held, out[number] = held + square, out[number] + 1
    return out


def constant(words) -> Column:
    """An array of words as one literal."""
    return F.split(F.lit(" ".join(sorted(words))), " ")


def scan(files: DataFrame, templates=TEMPLATES + NOTICES, limit: float = LIMIT,
         file_share: float = FILE_SHARE, texts=(*TEXTS.items(), *HEADERS)) -> DataFrame:
    """doc_id, path, license, score, how ('own', 'file', 'inherited' or null), from_dir.

    ``files`` has doc_id, path (parts divided by '/', the file's name last), text."""
    spark = files.sparkSession
    files = files.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path"),
        F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        F.regexp_extract(F.coalesce(F.col("text").cast("string"), F.lit("")), SPDX, 1).alias("spdx"),
    )
    of_lines = {w for _, t in templates for w in words_of(t)}
    of_texts = {w for _, t in texts for w in words_of(t)}
    vocabulary = sorted(of_lines | of_texts)
    # A text is split once: a line break divides words, so its words are those of its lines.
    files = files.withColumn("units", F.transform(
        F.split("text", "\n"), lambda x: F.array_remove(F.split(x, BREAK), ""))
    ).withColumn("words", F.flatten("units")).withColumn(
        "held", F.array_intersect("words", constant(vocabulary)))
    # One row for each word of the templates: bounded by them.
    found = {
        r["word"]: r["n"] for r in
        files.select(F.explode(F.array_union("held", F.array(F.lit("")))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    total = found.get("", 0)
    idf = {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1 for w in vocabulary}
    vectors = template_vectors(templates, idf)
    wholes = template_vectors(texts, idf, damped=True)
    heavy = constant(anchors(vectors, limit))
    lines = F.when(F.arrays_overlap("held", heavy),
                   F.filter("units", lambda x: F.arrays_overlap(x, heavy)))
    # Few texts hold enough words of the templates for any whole text, so the number
    # that they hold at all is compared before the words of each template are.
    least = fewest(wholes, limit)
    near = [
        F.when((F.size("held") >= least[i])
               & (F.size(F.array_intersect("held", constant(set(words_of(t))))) >= least[i]),
               F.lit(len(words_of(t))))
        for i, (_, t) in enumerate(texts)
    ]
    heads = F.flatten(F.transform(F.array_distinct(F.array_compact(F.array(*near))),
                                  lambda n: F.array(n, n + MORE)))
    heads = F.array_distinct(heads) if near else F.array().cast("array<int>")
    layer = settle(
        files.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "path", "spdx",
            F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
            .when(F.col("path") != "", "").alias("dir"),
            F.size("words").alias("n_words"), lines.alias("lines"), heads.alias("heads"), "words",
        ).withColumn("words", F.when(F.size("heads") > 0, F.col("words"))), "license-lines")
    shape = "number int, license string, word string, weight double"
    # As large as the templates: lines are compared with the notices, a whole text with
    # all texts, a head with those of its length.
    templates_df = F.broadcast(spark.createDataFrame(vectors, shape))
    long = [len(words_of(t)) for _, t in texts]
    wholes_df = F.broadcast(spark.createDataFrame(
        [(*v, unit) for v in wholes for unit in (WHOLE, -1 - long[v[0]], -1 - long[v[0]] - MORE)],
        shape + ", line int"))
    idf_df = F.broadcast(spark.createDataFrame(
        [(w, idf[w] if w in of_lines else None, idf[w] if w in of_texts else None) for w in vocabulary],
        "word string, line_idf double, text_idf double"))
    by_text = layer.filter("size(heads) > 0").select("row", "words", F.explode(
        F.concat(F.array(F.lit(WHOLE)), F.transform("heads", lambda n: -1 - n))).alias("line"))
    by_text = by_text.select("row", "line", F.when(F.col("line") == WHOLE, F.col("words")).otherwise(
        F.slice("words", F.lit(1), F.greatest(-1 - F.col("line"), F.lit(0)))).alias("words"))
    terms = (
        layer.select("row", F.posexplode("lines").alias("line", "words")).unionByName(by_text)
        .select("row", "line", F.explode("words").alias("word"))
        .groupBy("row", "line", "word").agg(F.count(F.lit(1)).alias("tf"))
        .join(idf_df, "word", "left")
        .withColumn("w", F.when(F.col("line") >= 0, F.col("tf") * F.coalesce("line_idf", F.lit(1.0)))
                    .otherwise((1 + F.log("tf")) * F.coalesce("text_idf", F.lit(1.0))))
        .drop("line_idf", "text_idf")
    )
    terms = settle(terms, "license-terms")
    norms = terms.groupBy("row", "line").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words")
    )
    products = terms.filter("line >= 0").join(templates_df, "word").unionByName(
        terms.filter("line < 0").join(wholes_df, ["word", "line"])
    )
    dots = products.groupBy("row", "line", "number", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    matched = dots.join(norms, ["row", "line"]).withColumn(
        "score", F.round(F.col("dot") / F.col("norm"), 6)
    ).filter(F.col("score") >= limit)
    by_line = matched.groupBy("row", "line").agg(
        F.max("words").alias("words"),
        F.min(F.struct((-F.col("score")).alias("worse"), F.col("license"))).alias("best"),
    )
    unit = F.when(F.col("line") >= 0, 2).when(F.col("line") == WHOLE, 0).otherwise(1)
    own = by_line.groupBy("row").agg(
        F.sum(F.when(F.col("line") >= 0, F.col("words"))).alias("words"),
        F.max(F.col("line") == WHOLE).alias("is_text"),
        F.min(F.struct(unit.alias("unit"), "best")).alias("best"),
    ).select("row", "words", "is_text", F.col("best.best.license").alias("own"),
             (-F.col("best.best.worse")).alias("own_score"))
    named = F.col("spdx") != ""
    spdx_words = F.size(F.array_remove(F.split(F.lower("spdx"), BREAK), "")) + 3
    judged = settle(
        layer.select("row", "doc_id", "path", "dir", "n_words", "spdx").join(own, "row", "left")
        .withColumn("is_file", F.coalesce("is_text", F.lit(False)) | F.coalesce(
            F.greatest("words", F.when(named, spdx_words)) >= file_share * F.col("n_words"), F.lit(False)))
        .withColumns({"own": F.when(named, F.col("spdx")).otherwise(F.col("own")),
                      "own_score": F.when(named, 1.0).otherwise(F.col("own_score"))})
        .drop("spdx", "is_text"), "license-own")
    votes = judged.filter("is_file and dir is not null").groupBy("dir", "own").agg(
        F.count(F.lit(1)).alias("n")
    )
    speaks = votes.groupBy("dir").agg(
        F.min(F.struct((-F.col("n")).alias("fewer"), "own")).alias("best")
    ).select(F.col("dir").alias("from_dir"), F.col("best.own").alias("inherited"))
    # Directories, not documents, look for their ancestors.
    dirs = judged.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    ancestors = ancestors.withColumn(
        "from_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")
    )
    nearest = ancestors.join(speaks, "from_dir").groupBy("dir").agg(
        F.max(F.struct("depth", "from_dir", "inherited")).alias("near")
    ).select("dir", "near.from_dir", "near.inherited",
             F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = judged.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    is_own = F.col("own").isNotNull()
    return salted.join(nearest, ["dir", "salt"], "left").select(
        "doc_id", "path", F.coalesce("own", "inherited").alias("license"),
        F.col("own_score").alias("score"),
        F.when(F.col("is_file"), "file").when(is_own, "own")
        .when(F.col("inherited").isNotNull(), "inherited").alias("how"),
        F.when(~is_own, F.col("from_dir")).alias("from_dir"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The documents as a tree: a folder for each source, one for each language."""
    return docs.select(
        "doc_id", "text",
        F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias("path"),
    )


def _values() -> str:
    return ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))


SQL = f"""
WITH files AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS t,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' ||
         coalesce(CAST(doc_id AS VARCHAR), 'none') AS path
  FROM documents),
tmpl AS (SELECT * FROM (VALUES {_values()}) v(number, license, notice)),
tword AS (
  SELECT number, license, word, count(*) AS tf FROM (
    SELECT number, license, unnest(regexp_split_to_array(lower(notice), '{BREAK}')) AS word FROM tmpl)
  WHERE word <> '' GROUP BY ALL),
vocab AS (SELECT DISTINCT word FROM tword),
words AS MATERIALIZED (
  SELECT rid, line, unnest(regexp_split_to_array(x, '{BREAK}')) AS word
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line
        FROM files)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM words WHERE word IN (SELECT word FROM vocab) GROUP BY word),
idf AS (
  SELECT word, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(n, 0))) + 1 AS idf
  FROM vocab LEFT JOIN df USING (word)),
tnorm AS (SELECT number, sqrt(sum((tf * idf) ** 2)) AS norm FROM tword JOIN idf USING (word) GROUP BY number),
tvec AS (
  SELECT number, license, word, tf * idf / norm AS weight FROM tword JOIN idf USING (word) JOIN tnorm USING (number)),
terms AS MATERIALIZED (
  SELECT rid, line, word, tf, tf * coalesce(idf, 1.0) AS w
  FROM (SELECT rid, line, word, count(*) AS tf FROM words WHERE word <> '' GROUP BY ALL) LEFT JOIN idf USING (word)),
norms AS (SELECT rid, line, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM terms GROUP BY ALL),
matched AS (
  SELECT rid, line, license, words, round(dot / norm, 6) AS score
  FROM (SELECT rid, line, number, license, sum(w * weight) AS dot FROM terms JOIN tvec USING (word) GROUP BY ALL)
  JOIN norms USING (rid, line)),
by_line AS (
  SELECT rid, line, max(words) AS words, arg_min(license, (-score, license)) AS license, max(score) AS score
  FROM matched WHERE score >= {LIMIT} GROUP BY rid, line),
own AS (
  SELECT rid, sum(words) AS words, arg_min(license, (-score, license)) AS own, max(score) AS own_score
  FROM by_line GROUP BY rid),
judged AS MATERIALIZED (
  SELECT f.rid, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own, own_score,
         coalesce(words >= {FILE_SHARE} * coalesce(n, 0), false) AS is_file
  FROM files f LEFT JOIN own USING (rid)
  LEFT JOIN (SELECT rid, count(*) AS n FROM words WHERE word <> '' GROUP BY rid) USING (rid)),
speaks AS (
  SELECT dir AS from_dir, arg_min(own, (-n, own)) AS inherited
  FROM (SELECT dir, own, count(*) AS n FROM judged WHERE is_file GROUP BY ALL) GROUP BY dir),
anc AS (
  SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS from_dir
  FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth
        FROM (SELECT DISTINCT dir FROM judged))),
nearest AS (
  SELECT dir, arg_max(from_dir, depth) AS from_dir, arg_max(inherited, depth) AS inherited
  FROM anc JOIN speaks USING (from_dir) GROUP BY dir)
SELECT doc_id, path, coalesce(own, inherited) AS license, own_score AS score,
       CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'own'
            WHEN inherited IS NOT NULL THEN 'inherited' END AS how,
       CASE WHEN own IS NULL THEN from_dir END AS from_dir
FROM judged LEFT JOIN nearest USING (dir)
"""
