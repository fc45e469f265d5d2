"""License notices by diagonal voting: word k-grams joined to template positions, votes per diagonal, verified spans."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchstone.llm.common import settle, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Wording of published license notices, lower-cased.  The first three are phrases that must stand exactly.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

K = 3
GAP = 3  # diagonals this near are one place with words left out or put in
COVERAGE = 0.6
DENSITY = 2 / 3
BROADCAST_GRAMS = 100_000


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def rolling(words: str, k: int) -> Column:
    """The hash of the k words that begin at each word; null where fewer are left."""
    def gram(word: Column, i: Column) -> Column:
        return F.when(i + k <= F.size(words), F.xxhash64(word, *[F.get(F.col(words), i + j) for j in range(1, k)]))

    return F.transform(words, gram)


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """One row per position of a template: ``template``, ``label``, ``exact``, ``grams``, ``tpos``, ``gram`` and its ``hash``."""
    rows = [{"template": i, "label": label, "exact": i < len(phrases), "words": text.split(" ")}
            for i, (label, text) in enumerate([*phrases, *notices])]
    short = [r for r in rows if len(r["words"]) < k]
    if short:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    kind = "array<struct<template:int,label:string,exact:boolean,words:array<string>>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    out = (table.select("template", "label", "exact", (F.size("words") - k + 1).alias("grams"), "words",
                        F.posexplode(F.slice("words", 1, F.size("words") - k + 1)).alias("tpos", "first"))
           .select("template", "label", "exact", "grams", "tpos", F.slice("words", F.col("tpos") + 1, F.lit(k)).alias("gram"))
           .withColumn("hash", F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(k)])))
    size = sum(len(r["words"]) for r in rows)
    return F.broadcast(out) if size <= BROADCAST_GRAMS else out


def _hits(docs: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """A head row for each document (``n_words``) and a row for each of its words at which a template's k-gram begins.

    Written once: the row numbers that the later steps join on are fixed by it.
    """
    rows = (docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), words_of(whole_text(docs)).alias("words"))
            .select("doc_id", "row_no", "words", F.posexplode_outer(rolling("words", k)).alias("pos", "hash")))
    met = rows.join(grams, "hash", "left")
    same = F.slice("words", F.col("pos") + 1, F.lit(k)) == F.col("gram")
    head = F.coalesce(F.col("pos") == 0, F.lit(True))
    return settle(met.filter(head | F.col("template").isNotNull()).select(
        "row_no", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.size("words").cast("long")).alias("n_words"),
        F.when(same, F.col("template")).alias("template"), "label", "exact", "grams", "tpos", F.col("pos").cast("long").alias("pos")))


_BY = ["row_no", "template", "label", "exact", "grams"]


def _diagonals(hits: DataFrame) -> DataFrame:
    """Votes per document, template and diagonal (place in the text less place in the template)."""
    return (hits.filter("template is not null").withColumn("diagonal", F.col("pos") - F.col("tpos"))
            .groupBy(*_BY, "diagonal").agg(F.count(F.lit(1)).alias("votes")))


def _spans(hits: DataFrame, diagonals: DataFrame, k: int, gap: int) -> DataFrame:
    """Neighbouring diagonals as one span: first word, end, share of the template's k-grams met, share of the span's words met.

    Diagonals are neighbours up to ``gap``, less for short templates, so that a phrase said twice stays two spans.
    """
    near = F.least(F.lit(gap), F.floor((F.col("grams") + k - 2) / 2))
    along = Window.partitionBy("row_no", "template").orderBy("diagonal")
    islands = diagonals.withColumn("opens", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > near, F.lit(True)).cast("long"))
    islands = islands.withColumn("island", F.sum("opens").over(along)).select("row_no", "template", "diagonal", "island")
    placed = hits.filter("template is not null").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    placed = placed.join(islands, ["row_no", "template", "diagonal"])
    per = placed.groupBy(*_BY, "island", "tpos").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    whole = per.groupBy(*_BY, "island").agg(F.count(F.lit(1)).alias("met"), F.min("low").alias("start"), (F.max("high") + k).alias("end"))
    return whole.select(
        "row_no", "template", "label", "start", "end", (F.col("met") / F.col("grams")).alias("coverage"),
        F.least(F.lit(1.0), (F.col("met") + k - 1) / (F.col("end") - F.col("start"))).alias("density"))


def license_spans(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, k: int = K,
    gap: int = GAP, coverage: float = COVERAGE, density: float = DENSITY,
) -> DataFrame:
    """Spans of license notices: ``doc_id``, ``label``, ``template``, ``start``, ``end`` (words), ``coverage``, ``density``.

    Every word k-gram of every text is hashed and joined to the positions of the templates (``phrases`` and ``notices``,
    lists of label and text).  Matches are compared word by word, so hashes decide nothing.  Votes are added up per
    diagonal, neighbouring diagonals become one span, and a span holds if it has ``coverage`` of the template's k-grams
    and ``density`` of its own words lies in them.  Texts, words and edge cases are those of :func:`license_labels`.
    """
    hits = _hits(docs, template_grams(docs.sparkSession, phrases, notices, k), k)
    heads = hits.filter("n_words is not null").select("row_no", "doc_id").distinct()
    spans = _spans(hits, _diagonals(hits), k, gap).filter((F.col("coverage") >= coverage) & (F.col("density") >= density))
    return heads.join(spans, "row_no").drop("row_no")


def license_labels(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, k: int = K,
    gap: int = GAP, coverage: float = COVERAGE, density: float = DENSITY,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``phrases`` count only where all their words stand consecutively (``n_base`` places, the smallest and largest first
    word, their labels); ``labels`` adds those of spans that :func:`license_spans` holds for verified.  ``score`` is the
    best span's coverage times density, 1 where a phrase stands, 0 where nothing does.

    Null and empty texts have no words and no labels; repeated rows give repeated results and a null doc_id stays null;
    other columns are ignored, whatever their names; an empty table gives no rows.  A document's votes are grouped by
    (row, template, diagonal), so neither a frequent phrase nor a long text meets other documents in a task.
    """
    hits = _hits(docs, template_grams(docs.sparkSession, phrases, notices, k), k)
    heads = hits.filter("n_words is not null").select("row_no", "doc_id", "n_words").distinct()
    diagonals = _diagonals(hits)
    base = (diagonals.filter("exact and votes = grams").groupBy("row_no")
            .agg(F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
                 F.collect_set("label").alias("exact_labels")))
    spans = _spans(hits, diagonals, k, gap).filter((F.col("coverage") >= coverage) & (F.col("density") >= density))
    found = spans.groupBy("row_no").agg(
        F.collect_set("label").alias("span_labels"), F.max(F.round(F.col("coverage") * F.col("density"), 6)).alias("best"))
    out = heads.join(base, "row_no", "left").join(found, "row_no", "left")
    none = F.array().cast("array<string>")

    def joined(*sets: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(s, none) for s in sets]))), ",")

    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("exact_labels").alias("base_labels"), joined("exact_labels", "span_labels").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(
    f"({i}, {_quoted(label)}, {str(i < len(PHRASES)).lower()}, string_split({_quoted(text)}, ' '))"
    for i, (label, text) in enumerate([*PHRASES, *NOTICES]))

OP13_SQL = rf"""
with t as (select * from (values {_VALUES}) v(template, label, exact, ws)),
tg as (select template, label, exact, len(ws) - {K - 1} as grams, i as tpos, ws[i + 1:i + {K}] as gram
       from (select *, unnest(range(len(ws) - {K - 1})) as i from t)),
d as (select row_number() over () as row_no, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
      from documents),
w as (select row_no, i as pos, ws[i + 1:i + {K}] as gram from (select *, unnest(range(len(ws) - {K - 1})) as i from d)),
h as (select row_no, template, label, exact, grams, tpos, pos, pos - tpos as diagonal from w join tg using (gram)),
g as (select row_no, template, label, exact, grams, diagonal, count(*) as votes from h group by all),
b as (select row_no, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word, list(distinct label) as ls
      from g where exact and votes = grams group by 1),
o as (select *, coalesce(diagonal - lag(diagonal) over a > least({GAP}, (grams + {K - 2}) // 2), true) as opens
      from g window a as (partition by row_no, template order by diagonal)),
i as (select *, sum(opens::int) over (partition by row_no, template order by diagonal) as island from o),
s as (select row_no, label, count(distinct tpos) / any_value(grams) as coverage,
             least(1.0, (count(distinct tpos) + {K - 1}) / (max(pos) + {K} - min(pos))) as density
      from h join (select row_no, template, diagonal, island from i) using (row_no, template, diagonal)
      group by row_no, template, label, island),
f as (select row_no, list(distinct label) as ls, max(round(coverage * density, 6)) as best
      from s where coverage >= {COVERAGE} and density >= {DENSITY!r} group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
       cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       array_to_string(list_sort(coalesce(b.ls, [])), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ',') as labels,
       case when n_base > 0 then 1.0 else coalesce(best, 0.0) end as score
from d left join b using (row_no) left join f using (row_no)
"""
