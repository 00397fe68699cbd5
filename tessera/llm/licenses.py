"""License scans by diagonal voting: rolling word k-grams of every text joined to template positions.

A k-gram at word p of a text and at word t of a template votes for the diagonal p - t. Votes are summed by
(text, template, diagonal); diagonals a few words apart that lie next to each other in the text are merged, since an
inserted or missing word shifts the rest; a merged span is verified by the share of the template's words that its
k-grams cover and by its length. A short phrase whose diagonal has all its k-grams stands in the text word for word,
which is how the base counts are got.

Defined cases: a null or empty text has no words and no labels, score 0; overlapping and repeated phrases count at
every place; equal rows give equal result rows, one for each input row; a null doc_id is a value like another;
templates of under k words are refused; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import gram_rows, probe, stored

K = 3
#: The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening or naming passages of public licenses and their labels.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("licensed under the Apache License, Version 2.0", "apache-2"),
    ("licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under the Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    ("licensed under the GNU General Public License, version 2", "gpl-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl-3"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
)
#: Diagonals at most DRIFT apart and GAP words from each other are one span; a span counts from COVER of the template's
#: words on, in at most STRETCH times the template's length. Templates of under LONG words must be covered wholly:
#: one word tells licenses such as version 2 and version 3 apart.
DRIFT, GAP, COVER, STRETCH, LONG = 3, 8, 0.8, 1.5, 16


def template_grams(spark, phrases: Iterable, templates: Iterable, k: int = K) -> DataFrame:
    """One row per k-gram place of each template: gram_size, gram_hash, gram, tpl, tpl_place, tpl_words, label, base."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *templates])]
    items = spark.createDataFrame(rows, "tpl int, _text string, label string, base boolean")
    grams = gram_rows(items, ["tpl", "label", "base"], "_text", k, whole_if_shorter=False).withColumnRenamed("place", "tpl_place")
    return grams.withColumn("tpl_words", F.max("tpl_place").over(Window.partitionBy("tpl")) + k)


def votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Votes by diagonal, and one row per text with tpl null: doc_id, text_hash, n_words, tpl, label, base, tpl_words,
    diagonal, n_votes, first_pos, last_pos, places (template places voted for), copies."""
    grams = template_grams(docs.sparkSession, phrases, templates, k)
    payload = ["tpl", "tpl_place", "tpl_words", "label", "base"]
    longest = sum(len(text) for text, _ in [*phrases, *templates])  # more than the templates' k-grams
    hits = probe(docs, doc_id, text, grams, [k], payload, longest)
    return hits.groupBy("doc_id", "text_hash", "n_words", "tpl", "label", "base", "tpl_words", (F.col("pos") - F.col("tpl_place")).cast("bigint").alias("diagonal")).agg(
        F.sum("own").alias("copies"), F.collect_set("tpl_place").alias("places"), F.min("pos").alias("first_pos"), (F.max("pos") + k).alias("last_pos"),
    )


def spans(by_diagonal: DataFrame, k: int = K) -> DataFrame:
    """Merged neighbouring diagonals of each (text, template): start, end (words), cover, verified."""
    of = ["doc_id", "text_hash", "n_words", "tpl", "label", "base", "tpl_words"]
    order = Window.partitionBy(*of).orderBy("first_pos", "diagonal")
    d = by_diagonal.where(F.col("tpl").isNotNull())
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT) | (F.col("first_pos") - F.lag("last_pos").over(order) > GAP)
    d = d.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(order))
    s = d.groupBy(*of, "_span").agg(
        F.min("first_pos").alias("start"), F.max("last_pos").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("_places"),
        F.min(F.when(F.size("places") == F.col("tpl_words") - k + 1, F.col("diagonal"))).alias("exact_first"),
        F.max(F.when(F.size("places") == F.col("tpl_words") - k + 1, F.col("diagonal"))).alias("exact_last"),
        F.sum((F.size("places") == F.col("tpl_words") - k + 1).cast("bigint")).alias("n_exact"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    words = F.aggregate("_places", zero, lambda a, t: F.struct((a["n"] + t + k - F.greatest(t, a["end"])).alias("n"), (t + k).alias("end")), lambda a: a["n"])
    cover = words / F.col("tpl_words")
    return s.withColumn("cover", cover).withColumn("verified", (F.col("cover") >= F.when(F.col("tpl_words") >= LONG, COVER).otherwise(1.0)) & (F.col("end") - F.col("start") <= STRETCH * F.col("tpl_words"))).drop("_places")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    by_diagonal = stored(votes(docs, doc_id, text, phrases, templates, k), "votes")  # read twice, made once
    key = ["doc_id", "text_hash", "n_words"]
    found = spans(by_diagonal, k).select(*key, F.struct("label", "base", "start", "end", "cover", "verified", "exact_first", "exact_last", "n_exact").alias("span"), F.lit(0).cast("bigint").alias("copies"))
    own = by_diagonal.where(F.col("tpl").isNull()).select(*key, F.lit(None).cast(found.schema["span"].dataType).alias("span"), "copies")
    x, base = F.col("span"), F.col("span.base")
    out = own.unionByName(found).groupBy(*key).agg(
        F.sum("copies").alias("_copies"),
        F.coalesce(F.sum(F.when(base, x["n_exact"])), F.lit(0).cast("bigint")).alias("n_base"),
        F.min(F.when(base, x["exact_first"])).alias("first_word"),
        F.max(F.when(base, x["exact_last"])).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base & (x["n_exact"] > 0), x["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(x["verified"] | (base & (x["n_exact"] > 0)), x["label"]))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base & (x["n_exact"] == 0), F.lit(0.0)).otherwise(x["cover"])), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(x["verified"], F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"))))).alias("spans"),
    )
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")).drop("_copies", "_copy", "text_hash")
