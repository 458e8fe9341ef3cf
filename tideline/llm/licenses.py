"""License scan: exact set-similarity join of text blocks with license templates, and base phrases by place.

A block is a run of consecutive words, across lines too (notices are often wrapped), that is as long as the template
divided by ``threshold``; nothing wider counts, however long a line is. A template matches a block when the block holds
at least ``threshold`` of the template's distinct words, or all of them if it has fewer than ``WHOLE`` (one word less
would be another licence). The join is exact: every template word is ordered by its frequency over all documents
(rarest first); the first word in that order that a sufficient block and the template share is one of the template's
first n - needed + 1 (prefix filter). The words around each such place, as far as a block of that template reaches, must
hold at least ``needed`` of the template's words (length filter), and so must those from the met word on in the order
(positional filter). What passes is counted exactly: each occurrence of a template word adds to the blocks in which it
is the word's first, so the counts of all blocks are one running sum over the places of a text.

Templates are tables: their words, prefixes and sizes are joined by broadcast after a check of their size, so whole
licence texts of thousands of words cost a place only the template it meets, not the vocabulary of all.

Cases: null and empty texts have no words, places or labels and score 0; repeated rows each get their result;
ties in frequency go by the word; null ids are kept; other columns are ignored. Templates without words match nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import cut, small, words

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and whole licence texts: label, words.
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-short", "licensed under the apache license version"),
    ("bsd-2-clause", "bsd 2 clause license"),
    ("bsd-3-clause", "bsd 3 clause license"),
    ("bsd-conditions", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("eclipse", "eclipse public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-work", "this work is licensed under the gnu general public license version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-short", "released under the mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
#: Templates of fewer distinct words must be held whole.
WHOLE = 10


def _texts(values) -> Column:
    """An array of words without separators in them, as one literal."""
    return F.split(F.lit(" ".join(values)), " ")


def _places(w: Column) -> Column:
    """Array of (place, label) of the base phrases in a word array."""
    return F.concat(*[_places_of(w, phrase.split(), label) for phrase, label in PHRASES.items()])


def _places_of(w: Column, phrase: list[str], label: str) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.coalesce(_all(F.get(w, i + j) == F.lit(x) for j, x in enumerate(phrase)), F.lit(False)))
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def word_order(documents: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words by their number of documents, rarest first (as many rows as the templates have words)."""
    vocabulary = sorted({x for _, t in templates for x in t.split()})
    met = documents.select(words(F.col("text")).alias("w")).select(F.explode_outer(F.array_intersect("w", _texts(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in met.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda x: (counts.get(x, 0), x))


def _blocks(rows: DataFrame, starts: list[str], prefixes: DataFrame, sides: DataFrame, own_words: DataFrame) -> DataFrame:
    """(doc_id, row, template, shared, n_template) of the templates that a text holds; shared is the most in one block."""
    text = ["doc_id", "row", "tid"]
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(*starts))
    # places first, the words around each afterwards: a text never stands in memory once for each of its prefix words
    placed = rows.select("doc_id", "row", "w", at.alias("at")).select("doc_id", "row", "w", F.explode_outer("at").alias("i")).where("i is not null")
    met = placed.withColumn("word", F.get("w", "i")).join(prefixes, "word").join(sides, "tid")
    first = F.greatest(F.col("i") - F.col("length") + 1, F.lit(0))
    met = met.select(*text, "word", "own", "needed", "length", first.alias("first"), F.slice("w", first + 1, 2 * F.col("length") - 1).alias("near"))
    # array_intersect keeps the order of its first side: the words around come out in global order
    met = met.withColumn("b", F.array_intersect("own", "near"))
    met = met.where((F.size("b") >= F.col("needed")) & (F.size("b") - F.array_position("b", F.col("word")) + 1 >= F.col("needed")))
    around = met.select(*text, "length", "first", F.posexplode_outer("near").alias("j", "x"))
    held = around.join(own_words, ["tid", "x"]).select(*text, "length", "x", (F.col("first") + F.col("j")).alias("pos")).distinct().repartition(*text)
    earlier = F.lag("pos").over(Window.partitionBy(*text, "x").orderBy("pos"))
    # blocks that begin from here on hold this occurrence and none of the word before it
    since = F.greatest(F.col("pos") - F.col("length"), F.coalesce(earlier, F.lit(-1) - F.col("length"))) + 1
    steps = held.select(*text, since.alias("since"), "pos").select(*text, F.explode(F.array(F.struct(F.col("since").alias("s"), F.lit(1).alias("d")), F.struct((F.col("pos") + 1).alias("s"), F.lit(-1).alias("d")))).alias("e"))
    shared = F.sum("e.d").over(Window.partitionBy(*text).orderBy("e.s"))  # equal places are peers
    most = steps.select(*text, shared.alias("shared")).groupBy(*text).agg(F.max("shared").alias("shared"))
    return most.join(sides, "tid").where("shared >= needed").select("doc_id", "row", "template", "shared", "n_template")


def scan(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates.

    score is the largest containment of a template in a block, or 1 where a base phrase stands. ``templates`` are pairs
    of label and words, or a table (label, text) of texts as they are, whose words the driver can hold.
    """
    spark = documents.sparkSession
    if isinstance(templates, DataFrame):
        templates = [(r["label"], r["t"]) for r in templates.where("label is not null").select("label", F.array_join(words(F.col("text")), " ").alias("t")).collect()]
    templates = [(label, text) for label, text in templates if text.split()]
    order = word_order(documents, templates)
    rank = {x: i for i, x in enumerate(order)}
    sides, prefixes = [], []
    for tid, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.get)
        needed = math.ceil(threshold * len(own) - 1e-9) if len(own) >= WHOLE else len(own)
        length = math.ceil(len(text.split()) / threshold - 1e-9)
        sides.append((tid, label, len(own), needed, own, length))
        prefixes += [(x, tid) for x in own[: len(own) - needed + 1]]
    starts = sorted({x for x, _ in prefixes})
    sides = cut(spark.createDataFrame(sides, "tid int, template string, n_template int, needed int, own array<string>, length int"))
    prefixes = small(cut(spark.createDataFrame(prefixes, "word string, tid int")))
    own_words, sides = small(cut(sides.select("tid", F.explode("own").alias("x")))), small(sides)

    rows = documents.select("doc_id", "text", words(F.col("text")).alias("w"), F.xxhash64("text").alias("row"))
    rows = rows.withColumn("first_words", F.arrays_overlap("w", _texts(sorted({p.split()[0] for p in PHRASES}))))
    rows = rows.withColumn("may_match", F.arrays_overlap("w", _texts(starts)))
    places = F.when(F.col("first_words"), _places(F.col("w"))).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))
    base = rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), places.alias("p"))
    base = base.select(
        "doc_id", "row", "n_words", F.size("p").cast("long").alias("n_base"),
        F.array_min(F.transform("p", lambda x: x["place"])).alias("first_word"),
        F.array_max(F.transform("p", lambda x: x["place"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("p", lambda x: x["label"]))).alias("base"),
    )

    sized = _blocks(rows.where("may_match"), starts, prefixes, sides, own_words)
    found = sized.groupBy("doc_id", "row").agg(F.collect_set("template").alias("templates"), F.max(F.col("shared") / F.col("n_template")).alias("best"))
    found = found.select(F.col("doc_id").alias("f_doc"), F.col("row").alias("f_row"), "templates", "best")
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("row") == F.col("f_row")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("templates", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))), 6).alias("score"), F.coalesce(F.size("templates"), F.lit(0)).cast("long").alias("n_templates"),
    )
