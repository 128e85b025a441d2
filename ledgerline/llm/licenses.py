"""License notices by diagonal voting of word k-grams."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORDLIKE, lowered

# Phrases whose every place counts: (label, words). Fixed values.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Opening sentences of public licenses: (label, words). Fixed values.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
                "software and accompanying documentation covered by this license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
GRAM = 2
DRIFT = 2
COVERAGE = 0.8


def gram_rows(gram: int = GRAM, phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, base, grams, place, word 0 .. word k-1) for each k-gram of each template."""
    rows = []
    for base, source in ((True, phrases), (False, notices)):
        for label, text in source:
            words = re.findall(WORDLIKE, text)
            n = len(words) - gram + 1
            if not 1 <= n <= 63:
                raise ValueError(f"a template needs {gram} to {gram + 62} words: {text}")
            template = len({r[0] for r in rows})
            rows += [(template, label, base, n, i, *words[i : i + gram]) for i in range(n)]
    return rows


def values_sql(rows: list[tuple]) -> str:
    """The rows as the text of a VALUES list."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


def _templates(spark: SparkSession, rows: list[tuple], gram: int) -> DataFrame:
    names = ["template", "label", "base", "grams", "place", *[f"t{i}" for i in range(gram)]]
    return spark.sql(f"SELECT * FROM VALUES {values_sql(rows)} AS t({', '.join(names)})").withColumn(
        "key", F.xxhash64(*[f"t{i}" for i in range(gram)])
    )


def spans(docs: DataFrame, gram: int = GRAM, drift: int = DRIFT, phrases=PHRASES, notices=NOTICES,
          id: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidate spans per row of ``docs``: (row, id, n_words, template, label, base, start, last, coverage).

    Every k-gram of a text is joined by its hash, and checked word by word, with
    the k-grams of the templates, a table made in code and therefore broadcast.
    A hit at word p of the text and place t of a template votes for diagonal
    p - t; votes are bits per place, combined before the shuffle. A span lies on
    neighbouring diagonals, ``drift`` from the first to the last at most (words
    put in or left out), so it is no longer than its template and ``drift``
    words more; phrases must stand whole on one diagonal. Spans are verified:
    coverage is the share of the template's k-grams that stand there in order.
    Of overlapping spans the best covered one is returned. A row without hits
    keeps one row of NULLs.
    """
    words = F.regexp_extract_all(lowered(F.col(text)), F.lit(WORDLIKE), F.lit(0))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), words.alias("words"))
    shifted = [F.slice("words", j + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{j}") for j in range(gram)]
    grams = base.select("row", "id", F.size("words").cast("long").alias("n_words"),
                        F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "gram"))
    grams = grams.select("row", "id", "n_words", "at", *[F.col(f"gram.w{j}").alias(f"w{j}") for j in range(gram)])
    grams = grams.withColumn("gram_key", F.xxhash64(*[f"w{j}" for j in range(gram)]))
    known = F.broadcast(_templates(docs.sparkSession, gram_rows(gram, phrases, notices), gram))
    same = reduce(Column.__and__, [F.col(f"w{j}") == F.col(f"t{j}") for j in range(gram)])
    votes = grams.join(known, (F.col("gram_key") == F.col("key")) & same, "left").select(
        "row", "id", "n_words", "template", "label", "base", "grams", "at",
        (F.col("at") - F.col("place")).alias("diagonal"),
        F.expr("shiftleft(1L, place)").alias("vote"),
    )
    keys = ["row", "id", "n_words", "template", "label", "base", "grams"]
    lines = votes.groupBy(*keys, "diagonal").agg(
        F.bit_or("vote").alias("votes"), F.min("at").alias("start"), F.max("at").alias("last")
    )
    ordered = Window.partitionBy("row", "template").orderBy("diagonal")
    reach = F.when(F.col("base"), 0).otherwise(drift)
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered) > reach).cast("int"), F.lit(1))
    # What begins on a diagonal and drifts no further than so many words: at most drift + 1 diagonals.
    near = ordered.rangeBetween(0, drift)
    seen = F.struct("diagonal", "votes", "start", "last")
    windows = lines.withColumn("span", F.sum(opens).over(ordered)).withColumn(
        "seen", F.when(F.col("base"), F.array(seen)).otherwise(F.collect_list(seen).over(near))
    )
    merged = windows.withColumn("coverage", _in_order("seen", "diagonal", "grams", drift) / F.col("grams"))
    found = F.struct("coverage", (-F.col("diagonal")).alias("first"), F.array_min("seen.start").alias("start"), F.array_max("seen.last").alias("last"))
    best = merged.groupBy(*keys, "span").agg(F.max(found).alias("best"))
    return best.select("row", "id", "n_words", "template", "label", "base", F.col("best.start").cast("long").alias("start"),
                       (F.col("best.last") + gram - 1).cast("long").alias("last"), "best.coverage")


def _in_order(seen: str, first: str, grams: str, drift: int) -> Column:
    """The most places of a template that stand in a text in rising order, on diagonals from ``first`` to ``drift`` more.

    On one diagonal every hit is in order. On several, a place that is k words
    off its expected word needs the one before it less than k + 1 off: going
    through the places, the best counts so far are kept by how far the last hit
    lies ahead.
    """
    rows = range(drift + 1)

    def votes_of(k: int) -> Column:
        there = F.get(F.filter(seen, lambda x: x["diagonal"] == F.col(first) + k), F.lit(0))
        return F.coalesce(there["votes"], F.lit(0))

    votes = [votes_of(k) for k in rows]
    none = F.lit(-1000)

    def step(state: Column, place: Column) -> Column:
        def kept(k: int) -> Column:
            # Passing a place by brings the last hit one word closer.
            passed = F.greatest(state[0], state[1]) if k == 0 and drift else state[k + 1] if k < drift else state[0] if not drift else none
            before = state[0] if k == 0 else F.greatest(*[state[j] for j in range(k + 1)])
            here = F.call_function("shiftright", votes[k], place).bitwiseAND(1) == 1
            return F.greatest(passed, F.when(here, before + 1).otherwise(none))
        return F.array(*[kept(k) for k in rows])

    start = F.array(F.lit(0), *[none for _ in range(drift)])
    places = F.sequence(F.lit(0), F.col(grams) - 1)
    walked = F.array_max(F.aggregate(places, start, step))
    return F.when(F.size(seen) == 1, F.bit_count(F.get(F.col(seen), F.lit(0))["votes"])).otherwise(walked)


def scan(docs: DataFrame, threshold: float = COVERAGE, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` with its license labels.

    n_words; n_base, first_word and last_word: number, smallest and largest
    start of the base phrases (NULL where there is none); base_labels and
    labels: distinct, sorted, comma-joined, the second with every notice covered
    to ``threshold``; score: the best coverage, 1 for a base phrase, 0 for no hit.
    NULL and empty texts have no words and empty labels. Rows that repeat, also
    whole ones, each give a row of their own; other columns are ignored.
    """
    found = spans(docs, id=id, text=text, **options)
    whole = F.col("base") & (F.col("coverage") == 1)
    kept = whole | (~F.col("base") & (F.col("coverage") >= threshold))
    sure = F.when(F.col("base"), F.when(whole, 1.0).otherwise(0.0)).otherwise(F.col("coverage"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).alias("first_word"),
        F.max(F.when(whole, F.col("start"))).alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.coalesce(F.max(sure), F.lit(0.0)).alias("score"),
    ).drop("row").withColumnRenamed("id", id)


ORACLE = f"""
WITH RECURSIVE t(template, label, base, grams, place, t0, t1) AS (VALUES {values_sql(gram_rows())}),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz'), '{WORDLIKE}') AS ws
      FROM documents),
g AS (SELECT r, unnest(ws[:-2]) AS w0, unnest(ws[2:]) AS w1, unnest(range(len(ws) - 1)) AS spot FROM d WHERE len(ws) > 1),
v AS (SELECT r, template, label, base, grams, spot, place, spot - place AS diagonal FROM g JOIN t ON w0 = t0 AND w1 = t1),
l AS (SELECT r, template, label, base, grams, diagonal, min(spot) AS start, list(place) AS places FROM v GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= CASE WHEN base THEN 0 ELSE {DRIFT} END THEN 0 ELSE 1 END AS opens
      FROM l WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM o),
a AS (SELECT s.r, s.template, s.diagonal AS anchor, v.place, v.spot FROM s JOIN v ON v.r = s.r AND v.template = s.template
        AND v.diagonal BETWEEN s.diagonal AND s.diagonal + CASE WHEN s.base THEN 0 ELSE {DRIFT} END),
c AS (SELECT r, template, anchor, place, spot, 1 AS n FROM a
      UNION SELECT c.r, c.template, c.anchor, a.place, a.spot, c.n + 1 FROM c JOIN a ON a.r = c.r AND a.template = c.template AND a.anchor = c.anchor AND a.place > c.place AND a.spot > c.spot),
k AS (SELECT r, template, anchor, max(n) AS n FROM c GROUP BY ALL),
m AS (SELECT s.r, s.template, s.label, s.base, span, min(start) AS start, max(k.n) / any_value(grams) AS coverage
      FROM s JOIN k ON k.r = s.r AND k.template = s.template AND k.anchor = s.diagonal GROUP BY s.r, s.template, s.label, s.base, span),
x AS (SELECT r, count(*) FILTER (base AND coverage = 1) AS n_base,
             min(start) FILTER (base AND coverage = 1) AS first_word, max(start) FILTER (base AND coverage = 1) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND coverage = 1) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label)
                 FILTER ((base AND coverage = 1) OR (NOT base AND coverage >= {COVERAGE})) AS labels,
             max(CASE WHEN NOT base OR coverage = 1 THEN coverage ELSE 0 END) AS score
      FROM m GROUP BY r)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_base, 0) AS n_base,
       cast(first_word AS bigint) AS first_word, cast(last_word AS bigint) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN x USING (r)
"""
