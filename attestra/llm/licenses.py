"""License scans by diagonal voting: rolling word grams joined with the templates' grams, votes per offset diagonal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, content_key, plain_words, small, stash

#: Words of a gram; words that a span may slide along its template by what was put in or left out;
#: share of a template's words that a span must have; words below which a template must be there whole.
GRAM, SLIDE, COVER, WHOLE = 3, 3, 0.8, 10


@dataclass(frozen=True)
class Template:
    """What to find: a phrase stands word by word, a notice may differ by a fifth of its words."""

    label: str
    text: str
    phrase: bool = False


# The phrases of the scan, and the usual short notices of public licenses.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Licensed under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    Template("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]
TEMPLATES = PHRASES + NOTICES


def _template_table(spark: SparkSession, templates: list[Template], gram: int) -> DataFrame:
    """(t, label, phrase, tw, tn, g): the words of each template that has any, and the length of its grams."""
    rows = [(k, x.label, x.phrase, x.text) for k, x in enumerate(templates)]
    table = spark.createDataFrame(rows, "t int, label string, phrase boolean, text string").select("t", "label", "phrase", plain_words(ascii_lower(F.col("text"))).alias("tw"))
    return table.withColumn("tn", F.size("tw")).where("tn > 0").withColumn("g", F.least("tn", F.lit(gram)))


def _gram(words: Column, at: Column, g: Column, widths: list[int]) -> Column:
    """The hash of the g words from a position on."""
    out = F.lit(None).cast("long")
    for k in widths:
        out = F.when(g == k, F.xxhash64(*[F.get(words, at + j) for j in range(k)])).otherwise(out)
    return out


def license_spans(docs: DataFrame, templates: list[Template] = TEMPLATES, gram: int = GRAM, slide: int = SLIDE, cover: float = COVER, whole: int = WHOLE) -> DataFrame:
    """Verified spans: (doc_id, text_key, t, label, phrase, begin, end, votes, coverage), words counted from 0, end exclusive.

    Each gram that a document shares with a template votes for the diagonal (place in the document
    less place in the template). Diagonals at most `slide` apart, and a quarter of the template,
    whose places lie within a template's length merge to one span. It is verified word by word: its
    coverage is the share of the template's words that stand on one of its diagonals; notices need
    `cover`, those of fewer than `whole` words and phrases all. Of notices that overlap the one with
    the greater coverage, then more votes, stays. Phrases are not merged and stay. Null or wordless texts and templates have no spans;
    repeated rows have those of one; no documents or templates: no rows.
    """
    known = _template_table(docs.sparkSession, templates, gram)
    shape = known.select("g", F.get("tw", F.lit(0)).alias("first")).distinct().collect()  # of a hand-made list
    widths, firsts = sorted({r["g"] for r in shape}), sorted({r["first"] for r in shape if r["g"] < gram})
    if not widths:
        widths = [gram]
    marks = known.select("t", "g", "tn", F.explode(F.sequence(F.lit(0), F.col("tn") - F.col("g"))).alias("q"), "tw").withColumn("mark", _gram(F.col("tw"), F.col("q"), F.col("g"), widths)).select("g", "mark", "t", "q")

    d = docs.select("doc_id", content_key(F.col("text")).alias("text_key"), plain_words(ascii_lower(F.col("text"))).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    # a row for each place and length of grams; what starts no short template needs no short gram
    rows = d.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") * len(widths) - 1)))
    rows = rows.withColumn("p", F.expr(f"cast(x div {len(widths)} as int)")).withColumn("g", F.get(F.array(*[F.lit(k) for k in widths]), F.col("x") % len(widths)))
    rows = rows.where(F.col("p") + F.col("g") <= F.col("n")).where((F.col("g") == gram) | F.get("words", F.col("p")).isin(firsts))
    hits = rows.withColumn("mark", _gram(F.col("words"), F.col("p"), F.col("g"), widths)).join(small(marks, marks.count()), ["g", "mark"])
    hits = hits.join(small(known.select("t", "phrase", "tw", "tn"), len(templates)), "t").withColumn("d", F.col("p") - F.col("q"))
    # the first gram of a run compares all words of its diagonal; the others only vote
    opens = (F.col("q") == 0) | (F.col("p") == 0) | ~F.get("words", F.col("p") - 1).eqNullSafe(F.get("tw", F.col("q") - 1))
    equal = F.filter(F.sequence(F.lit(0), F.col("tn") - 1), lambda k: (F.col("d") + k >= 0) & (F.get("words", F.greatest(F.col("d") + k, F.lit(0))) == F.get("tw", k)))
    votes = hits.select("doc_id", "text_key", "t", "phrase", "tn", "d", "p", "q", "g", F.when(opens, equal).alias("equal"))
    lines = votes.groupBy("doc_id", "text_key", "t", "phrase", "tn", "d").agg(F.size(F.collect_set("q")).alias("votes"), F.first("equal", ignorenulls=True).alias("equal"), F.min("p").alias("begin"), F.max(F.col("p") + F.col("g")).alias("end"))

    lines = stash(lines, "diagonals")
    one = lines.where("phrase").withColumn("coverage", F.size("equal") / F.col("tn"))
    far = F.least(F.lit(slide), F.floor(F.col("tn") / 4))
    inside = Window.partitionBy("doc_id", "text_key", "t").orderBy("begin", "d")  # of one text
    apart = (F.abs(F.col("d") - F.lag("d").over(inside)) > far) | (F.col("begin") - F.lag("end").over(inside) > F.col("tn"))
    spans = lines.where("not phrase").withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(inside))
    spans = spans.groupBy("doc_id", "text_key", "t", "tn", "span").agg(F.sum("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("equal")))).alias("found"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = spans.withColumn("coverage", F.col("found") / F.col("tn")).withColumn("phrase", F.lit(False))
    columns = ["doc_id", "text_key", "t", "phrase", "begin", "end", "votes", "coverage"]
    spans = spans.where(F.col("coverage") >= F.when(F.col("tn") < whole, 1.0).otherwise(cover)).select(*columns)
    spans = stash(spans, "spans")
    longest = spans.agg(F.max(F.col("end") - F.col("begin"))).first()[0] or 0  # none that begins farther off overlaps
    near = Window.partitionBy("doc_id", "text_key").orderBy("begin").rangeBetween(-longest, longest)
    rank = lambda s: F.struct(s["coverage"], s["votes"], -s["t"])
    mine = F.struct("coverage", "votes", "t", "begin", "end")
    spans = spans.withColumn("rivals", F.collect_list(mine).over(near)).where(~F.exists("rivals", lambda o: (o["begin"] < F.col("end")) & (F.col("begin") < o["end"]) & (rank(o) > rank(mine)))).drop("rivals")
    out = one.where("coverage = 1").select(*columns).union(spans)
    return out.join(small(known.select("t", "label"), len(templates)), "t").select("doc_id", "text_key", "t", "label", "phrase", "begin", "end", "votes", "coverage")


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, **options) -> DataFrame:
    """One row per document: doc_id, n_words, places, first_word, last_word, base_labels, labels, spans, score.

    places, first_word, last_word and base_labels are those of phrases (how many, the least and the
    greatest start, or null); labels and spans are of phrases and notices. score is the greatest
    coverage of a notice; a document with phrases only has 0.5, one with nothing 0. Repeated rows
    stay and have the same result; null texts have no words; extra columns are ignored.
    """
    found = license_spans(docs, templates, **options)
    start, label = F.when(F.col("phrase"), F.col("begin")), F.when(F.col("phrase"), F.col("label"))
    span = F.struct("begin", "end", "label", "phrase", "votes", "coverage")
    per = found.groupBy("doc_id", "text_key").agg(
        F.count(start).alias("places"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), F.array_sort(F.collect_set(label)).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_list(span)).alias("spans"), F.max(F.when(F.col("phrase"), 0.5).otherwise(F.col("coverage"))).alias("score"),
    )
    per = stash(per.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k"), "licenses")
    base = docs.select("doc_id", content_key(F.col("text")).alias("text_key"), F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(small(per, per.count()), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("places", F.lit(0)).cast("long").alias("places"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), "spans", F.coalesce("score", F.lit(0.0)).alias("score"))
