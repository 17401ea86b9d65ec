"""License scan by diagonal voting (native DataFrame operations only).

Every word k-gram of every text is joined by its hash to the places where that k-gram stands in a template. A
match votes for the diagonal ``place in the text - place in the template``. Each diagonal is merged with its
neighbours, so a few words more or less do not break a span, and a merged span is verified by the template words that
its matches cover, each counted once: a fragment said many times is no license. The span is as long as the template and
twice the band at most. A phrase is a template whose k-grams must all lie on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table, text_of

#: Words of a k-gram.
K = 3
#: Phrases and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Passages of license texts and notices, and their labels.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        "apache-2",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        "mpl-2",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this work is licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)
#: Diagonals this near to one are merged with it; the share of a template's words that makes a span its license.
BAND, LEAST_COVERAGE = 4, 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(gram, h, template, label, phrase, n_grams, place): one row for each k-gram of each template, and template -1
    for the mark that ``scan`` gives every text. Its size is that of the constants above. A template has at least
    K words."""
    rows = [(None, -1, "", False, 0, 0)]
    for n, (words, label, phrase) in enumerate([(w, x, True) for w, x in phrases] + [(w, x, False) for w, x in templates]):
        words = words.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {words}")
        last = len(words) - K + 1
        rows += [(words[i : i + K], n, label, phrase, last, i) for i in range(last)]
    grams = spark.createDataFrame(rows, "gram array<string>, template int, label string, phrase boolean, n_grams int, place int")
    return grams.withColumn("h", F.when(F.col("template") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(K)])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: doc_id, text_hash, copies, n_words, one row for each id and text; repeated rows are counted in
    ``copies``. spans: doc_id, text_hash, label, phrase, first_word, last_word, coverage, one row for each place of
    a phrase and each verified span of a template. A null text counts as empty; null ids are an id of their own.
    Other columns are not read; empty in, empty out. Very long texts are cut into k-grams where they lie: the
    k-grams are joined to a broadcast table of fixed size and only matches are shuffled.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    words = F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words.alias("words"))
    last = F.size("words") - K
    grams = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(K)]),
    )
    # place 0 holds a mark that every text has once, so texts without a match stay
    marked = rows.select("doc_id", "text_hash", "words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), grams)).alias("p", "h"))
    known = template_grams(spark, phrases, templates)
    same = F.slice("words", F.col("p"), F.lit(K)) == F.col("gram")
    hits = (
        marked.join(F.broadcast(known), "h")
        .where(F.when(F.col("template") < 0, F.col("p") == 0).otherwise((F.col("p") > 0) & same))
        .select(
            "doc_id", "text_hash", "template", "label", "phrase", "n_grams", "place", (F.col("p") - 1).alias("at"),
            (F.col("p") - 1 - F.col("place")).alias("diagonal"),
            F.when(F.col("template") < 0, F.size("words")).cast("long").alias("n_words"),
        )
    )
    doc = ["doc_id", "text_hash"]
    votes = hits.groupBy(*doc, "template", "label", "phrase", "n_grams", "diagonal").agg(
        F.sort_array(F.collect_set("place")).alias("places"), F.min("at").alias("low"), F.max("at").alias("high"),
        F.max("n_words").alias("n_words"), F.count("*").alias("copies"),
    )
    votes = cut(votes, "votes")  # one scan of the texts; what follows reads a few narrow rows
    documents = votes.where("template < 0").select(*doc, "copies", "n_words")
    known = votes.where("template >= 0").drop("copies", "n_words")
    places = known.where("phrase AND size(places) = n_grams").select(
        *doc, "label", "phrase", F.col("diagonal").cast("long").alias("first_word"), F.col("diagonal").cast("long").alias("last_word"), F.lit(1.0).alias("coverage"),
    )
    along = Window.partitionBy(*doc, "template").orderBy("diagonal")
    near = along.rangeBetween(-BAND, BAND)
    merged = known.where("NOT phrase").withColumns({
        "places": F.array_distinct(F.flatten(F.collect_list("places").over(near))), "low": F.min("low").over(near), "high": F.max("high").over(near),
    })
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    merged = merged.withColumn("coverage", F.size("places") / F.col("n_grams")).where(covered / (F.col("n_grams") + K - 1) >= LEAST_COVERAGE)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > BAND, F.lit(True)).cast("int")
    spans = merged.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    best = F.max(F.struct("coverage", (-F.col("low")).alias("low"), "high")).alias("best")
    spans = spans.groupBy(*doc, "template", "label", "phrase", "span").agg(best).select(
        *doc, "label", "phrase", (-F.col("best.low")).cast("long").alias("first_word"), (F.col("best.high") + K - 1).cast("long").alias("last_word"), F.col("best.coverage").alias("coverage"),
    )
    return documents, places.unionByName(spans)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see
    ``scan``. Score: the largest share of a template's k-grams that a verified span has, 1 for a phrase, 0 for
    nothing."""
    documents, spans = scan(docs, id_col, text_col)
    base = F.when(F.col("phrase"), F.col("first_word"))
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"), F.collect_set("label").alias("any"), F.max("coverage").alias("score"),
    )
    found = found.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("x"), "n_base", "first_word", "last_word", "base", "any", "score")
    out = documents.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("x")), "left")
    line = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    out = out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        line("base").alias("base_labels"), line("any").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result word by word: where all words of a phrase stand; and for each word of a text that starts three
    words of a template, which template words and 3-grams lie within BAND words of that alignment."""
    phrases = ", ".join(f"('{words}', '{label}')" for words, label in PHRASES)
    templates = ", ".join(f"({n}, '{words}', '{label}')" for n, (words, label) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
pw AS (SELECT words, label, string_split(words, ' ') AS pl FROM (VALUES {phrases}) v(words, label)),
p AS (SELECT d.r, label, i FROM word JOIN pw ON x = pl[1] JOIN d ON d.r = word.r
      WHERE list_slice(w, i + 1, i + len(pl)) = pl),
tw AS (SELECT n, label, string_split(words, ' ') AS tl FROM (VALUES {templates}) v(n, words, label)),
three AS (SELECT n, label, len(tl) AS size, tl[k] AS x, tl[k + 1] AS y, tl[k + 2] AS z, k - 1 AS place
          FROM (SELECT *, unnest(range(1, len(tl) - 1)) AS k FROM tw)),
hit AS (SELECT a.r, n, label, size, place, a.i - place AS diag
        FROM word a JOIN word b ON a.r = b.r AND b.i = a.i + 1 JOIN word c ON a.r = c.r AND c.i = a.i + 2
        JOIN three t ON a.x = t.x AND b.x = t.y AND c.x = t.z),
centre AS (SELECT DISTINCT r, n, label, size, diag FROM hit),
around AS (SELECT DISTINCT c.r, c.n, c.label, c.size, c.diag, h.place
           FROM centre c JOIN hit h ON c.r = h.r AND c.n = h.n AND abs(c.diag - h.diag) <= {BAND}),
said AS (SELECT r, n, diag, count(DISTINCT place + o) AS words
         FROM around CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY ALL),
span AS (SELECT r, label, count(*) / (any_value(size) - 2)::DOUBLE AS coverage
         FROM around JOIN said USING (r, n, diag) GROUP BY r, n, label, diag
         HAVING any_value(words) >= {LEAST_COVERAGE} * any_value(size)),
a AS (SELECT r, label, i, 1.0::DOUBLE AS coverage FROM p UNION ALL SELECT r, label, NULL, coverage FROM span),
g AS (SELECT r, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (i IS NOT NULL), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
      FROM a GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""


QUERIES = {"op4_license_diagonals": op4_license_diagonals}
ORACLE_SQL = {"op4_license_diagonals": _sql()}
