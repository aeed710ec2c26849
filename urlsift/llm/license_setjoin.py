"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

A text block is a stretch of successive words, wherever lines break: for a template of ``m`` distinct words, any
``SLACK_PERCENT`` of ``m`` words (rounded up). It matches when it holds at least ``percent`` of the template's words, so
a wrapped notice is found and words that stand far apart are none. The join runs over windows of twice the longest
stretch, one stretch apart, so that each stretch lies whole in a window. It is exact and filtered in the usual order:
words are ordered by their frequency in the whole corpus, rarest first; a match must share a word with the template's
prefix (its ``m - c + 1`` rarest words, for ``m`` words of which ``c`` are needed); windows with fewer than ``c`` words
are out (length filter); the place of the first shared word bounds what can still be shared (positional filter); what
is left is verified on its stretches. A match whose template's words are all in a longer template that the same window
matches is not reported (the plain GPL within the Affero GPL).

Scale. Everything is DataFrame expressions. Frequencies are counted for the templates' vocabulary only, with partial
aggregation, and templates are a parameter of bounded size, so the join's other side is always small and broadcast.
A document leaves the one wide scan as a short row with the windows that hold a prefix word; no text is shuffled, and
only matches are grouped. A window and a template meet once, at their first shared word, so pairs need no removal of doubles.

Defined results. Null or empty text: no words, empty labels, score 0. Ids may be null or repeat: results go by row. An
empty table gives an empty result, an empty template list only the base labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import id_text, let, lower_az, stored

CONTAINED_PERCENT = 90
SLACK_PERCENT = 150

# fixed values: phrases and labels of the base rule
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# fixed values: notices and headers of common licenses, by label
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("artistic", "licensed under the artistic license 2 0"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("bsd", "licensed under the bsd 2 clause license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("epl", "licensed under the eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "licensed under the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # what is no word, before letters are lowered


def _spaced(text: Column) -> Column:
    """`` w1 w2 ... wn `` : the words with one space before, between and behind; a single space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), _GAP, " ")


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


_MATCHES = "array<struct<label:string,start:bigint,words:bigint,share:double>>"


def stretch(words: int) -> int:
    """Successive words within which a template of ``words`` distinct words is sought."""
    return -(-SLACK_PERCENT * words // 100)


def _words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_remove(F.array_distinct(F.split(lower_az(_spaced(text)), " ")), "")


def template_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Number of documents that hold each word of the vocabulary, over all documents (as many rows as words)."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    rows = (id_text(docs, text_col, text_col).select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("word"))
            .groupBy("word").count().collect())
    return {r["word"]: r["count"] for r in rows}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row, and
    ``matches``: an array of (label, first word of the stretch, its words, contained share) that the join found."""
    sets = [(label, sorted(set(words.split()))) for label, words in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    frequency = template_frequencies(docs, vocabulary, text_col) if vocabulary else {}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    ordered = [(label, sorted(ws, key=rank.get)) for label, ws in sets]
    need = [-(-percent * len(ws) // 100) for _, ws in ordered]
    prefixes = sorted({w for (_, ws), c in zip(ordered, need, strict=True) for w in ws[:len(ws) - c + 1]})

    phrase = " (" + "|".join(PHRASES) + ")(?= )"
    spaced = F.col("spaced")
    pieces, found = F.split(spaced, "(?i)" + phrase, -1), F.regexp_extract_all(spaced, F.lit("(?i)" + phrase), F.lit(1))
    of = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    holds = "(?i)(?<![0-9a-z\\x{80}-\\x{10FFFF}])(?:" + "|".join(prefixes) + ")(?![0-9a-z\\x{80}-\\x{10FFFF}])"
    spans = [stretch(len(ws)) for _, ws in ordered]
    step = max(spans, default=1)

    def windows(words):
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))
        cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice(words, at + 1, F.lit(2 * step)).alias("words")))
        return F.filter(cut, lambda x: F.arrays_overlap(x["words"], F.array(*[F.lit(w) for w in prefixes])))

    blocks = (F.when(F.col("text").rlike(holds), let(F.split(lower_az(F.trim(spaced)), " "), windows)) if prefixes
              else F.lit(None).cast("array<struct<at:int,words:array<string>>>"))
    scanned = stored(
        id_text(docs, id_col, text_col).withColumn("spaced", _spaced(F.col("text")))
        .select("id", "text", "spaced", (_spaces(spaced) - 1).cast("long").alias("n_words"), pieces.alias("pieces"), found.alias("found"))
        .select("id", "n_words", F.size("found").cast("long").alias("n_base"),
                F.when(F.size("found") > 0, _spaces(F.element_at("pieces", 1))).cast("long").alias("first_word"),
                F.when(F.size("found") > 0, F.col("n_words") - (_spaces(F.element_at("pieces", -1)) - 1)
                       - (_spaces(F.element_at("found", -1)) + 1)).cast("long").alias("last_word"),
                F.array_distinct(F.transform("found", lambda x: F.element_at(of, lower_az(x)))).alias("base"), blocks.alias("windows"))
        .withColumn("row", F.monotonically_increasing_id()), "license-scan")

    if not ordered:
        return _answer(scanned.withColumn("matches", F.lit(None).cast(_MATCHES)), id_col)
    spark = docs.sparkSession
    wider = [[j for j, (_, other) in enumerate(ordered) if set(ws) < set(other)] for _, ws in ordered]
    heads = spark.createDataFrame(
        [(k, label, ws, ws[:len(ws) - c + 1], c, spans[k], wider[k], j, w)
         for k, ((label, ws), c) in enumerate(zip(ordered, need, strict=True)) for j, w in enumerate(ws[:len(ws) - c + 1])],
        "template int, label string, words array<string>, prefix array<string>, need int, span int, wider array<int>, place int, word string")
    places = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    known = F.array(*[F.lit(w) for w in vocabulary])
    # a window as its vocabulary words in global order; other words cannot be shared with any template
    own = F.transform(F.array_sort(F.transform(F.array_intersect("block", known), lambda w: F.struct(F.element_at(places, w).alias("r"), w.alias("w")))),
                      lambda x: x["w"])
    probes = (scanned.select("row", F.explode("windows").alias("x")).select("row", "x.at", F.col("x.words").alias("block"))
              .withColumn("own", own).withColumn("size", F.size(F.array_distinct("block")))
              .select("*", F.posexplode("own").alias("i", "word")))
    met = (probes.join(F.broadcast(heads), "word")
           .where(F.col("size") >= F.col("need"))  # length
           .where(1 + F.least(F.size("own") - F.col("i") - 1, F.size("words") - F.col("place") - 1) >= F.col("need"))  # position
           .where(~F.arrays_overlap(F.slice("own", F.lit(1), F.col("i")), "prefix"))  # their first shared word
           .where(F.size(F.array_intersect("own", "words")) >= F.col("need")))
    # the best stretch: most words of the template, then the first
    starts = F.sequence(F.lit(0), F.greatest(F.size("block") - F.col("span"), F.lit(0)))
    best = F.array_max(F.transform(starts, lambda i: F.struct(
        F.size(F.array_intersect(F.slice("block", i + 1, F.col("span")), "words")).alias("shared"), (-i).alias("back"))))
    pairs = (met.withColumn("best", best).where(F.col("best.shared") >= F.col("need"))
             .groupBy("row", "at").agg(F.collect_list(F.struct(
                 "template", "wider", "label", (F.col("at") - F.col("best.back")).cast("long").alias("start"),
                 F.least("span", F.size("block")).cast("long").alias("words"), (F.col("best.shared") / F.size("words")).alias("share"))).alias("held")))
    held = F.filter("held", lambda m: ~F.arrays_overlap(m["wider"], F.transform("held", lambda o: o["template"])))  # templates at most
    matches = (pairs.select("row", F.explode(held).alias("m")).groupBy("row")
               .agg(F.collect_set(F.struct("m.label", "m.start", "m.words", "m.share")).alias("matches")))
    return _answer(scanned.drop("windows").join(matches, "row", "left"), id_col)


def _answer(rows: DataFrame, id_col: str) -> DataFrame:
    own = F.coalesce(F.col("matches"), F.array().cast(_MATCHES))
    labels = F.array_sort(F.array_union("base", F.transform(own, lambda m: m["label"])))
    best = F.array_max(F.transform(own, lambda m: m["share"]))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                       F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                       F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
                       own.alias("matches"))
