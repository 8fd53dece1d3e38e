"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A text is one sequence of words, so line ends, comment marks and punctuation don't matter and a wrapped notice is found. Its
blocks of a width are the runs of twice ``width`` words that start at every multiple of ``width``: whatever stands within
``width`` words lies whole in one of them. A template belongs to the least of ``WIDTHS`` that holds its words, so short notices
are looked for in short blocks and whole licence texts in long ones.

Tokens are ordered by their frequency over the corpus, rarest first. A block whose words hold at least the threshold's
share of a template's words must hold one of the template's first ``size - need + 1`` tokens (prefix filter), must have
enough template words at all (length filter), and must still have enough of them after the place of the first shared token
(positional filter). Blocks that pass are verified by an exact intersection. Everything is DataFrame operations.

Licences differ in a word or two (version 2 or 3, NonCommercial or ShareAlike), which a share of the words may forgive. So a match must
also tell its template from the siblings: templates of another label and the same width that a block of one could be taken for. All words
that the template has and a sibling lacks must be in the block; where the sibling has all of the template's words and more, those
that it has more must not all be there. This follows from the templates and needs no list.

The template table is fixed and short, so it is broadcast; the frequencies that come to the driver are one row for each
word of the templates. No text is shuffled: only blocks' template words and matches are, with the key of their row
(doc_id and the hash of its text). Texts are split once; what is kept of them (the number of words, and the blocks that have
enough template words) is written to the checkpoint folder.

Null texts count as empty: no words, no labels, score 0. Repeated rows each get their own (equal) result. Columns of the
input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.llm.common import WORD_BREAKS, cut_lineage, literal_array, lowered_ascii, once, words_of

#: Phrases whose consecutive words name a licence.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public licence notices and texts, as words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-1", "licensed under the apache license version 1 0"),
    ("apache-1", "licensed under the apache license version 1 1"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("lgpl-2", "this work is licensed under the gnu lesser general public license version 2 1"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("lgpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
        "or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
        "in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
        "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
)

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.85
#: Words that a block's half has; no template has more than the last.
WIDTHS = (16, 48, 192)


def needed(size: int, threshold: float) -> int:
    return math.ceil(round(threshold * size, 9))


def phrase_places(rows: DataFrame, text: str, keys: Sequence[str], phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """keys, n_base, first_word, last_word, base_labels of the rows in which a phrase's words stand consecutively; equal keys give one row. Phrases may not overlap themselves.

    The words of the few texts in which a phrase can occur are joined by single spaces and split at each phrase: the words of
    the first piece, and of all but the last, give the starts.
    """
    anywhere = "|".join(WORD_BREAKS.join(p.split()) for p, _ in phrases)
    words = words_of(F.col(text))
    spaced = rows.filter(F.col(text).rlike(f"(?i)(?:{anywhere})")).withColumn(text, lowered_ascii(F.col(text))).select(*keys, F.size(words).alias("n"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("spaced"))

    def spaces(piece: Column) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))

    places, first, last, labels = [], [], [], []
    for phrase, label in phrases:
        pieces = F.split("spaced", f" {phrase}(?= )")
        found = F.size(pieces) > 1
        places.append(F.size(pieces) - 1)
        first.append(F.when(found, spaces(F.get(pieces, F.lit(0)))))
        last.append(F.when(found, F.col("n") - (spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return (
        spaced.select(
            *keys,
            sum(places[1:], places[0]).cast("long").alias("n_base"),
            F.array_min(F.array(*first)).cast("long").alias("first_word"),
            F.array_max(F.array(*last)).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"),
        )
        .filter(F.col("n_base") > 0)
        .distinct()
    )


def width_of(template: str) -> int:
    return next(w for w in WIDTHS if len(template.split()) <= w)


def vocabulary_of(templates: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def blocks_of(rows: DataFrame, text: str, keys: Sequence[str], templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """keys, n_words, blocks: those with enough template words, each with its width, its first word and its distinct words that templates of that width have. ``text`` is lower-cased and not null."""
    worded = once(rows, "words", words_of(F.col(text)))
    n = F.size("words")

    def of_width(width: int) -> Column | None:
        own = [x for x in templates if width_of(x[1]) == width]
        if not own:
            return None
        vocabulary, least = literal_array(vocabulary_of(own)), min(needed(len(set(t.split())), threshold) for _, t in own)
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 2, F.lit(0)))
        found = F.transform(
            numbers, lambda k: F.struct(F.lit(width).alias("width"), (k * width).alias("at"), F.array_intersect(F.slice("words", k * width + 1, F.lit(2 * width)), vocabulary).alias("tokens"))
        )
        return F.filter(found, lambda b: F.size(b["tokens"]) >= least)

    parts = [p for p in map(of_width, WIDTHS) if p is not None]
    return worded.select(*keys, n.alias("n_words"), F.concat(*parts).alias("blocks"))


def siblings_of(templates: Sequence[tuple[str, str]], threshold: float) -> list[tuple[list[str], list[list[str]]]]:
    """For each template the words that must all be in its block, and the sets of words of which none may be there as a whole."""
    sets, out = [set(t.split()) for _, t in templates], []
    for (label, t), own in zip(templates, sets, strict=True):
        need, must, never = needed(len(own), threshold), set(), []
        for (other, s), more in zip(templates, sets, strict=True):
            if other == label or width_of(s) != width_of(t) or len(own & more) < need:
                continue
            must |= own - more
            if own < more:
                never.append(sorted(more - own))
        out.append((sorted(must), sorted(never)))
    return out


def matches(blocks: DataFrame, keys: Sequence[str], templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """keys, width, at, template (its number), label, overlap, containment for every block (of ``blocks_of``) and template at or over the threshold."""
    sets = [sorted(set(t.split())) for _, t in templates]
    vocabulary = vocabulary_of(templates)
    blocks = blocks.select(*keys, F.explode("blocks").alias("block")).select(*keys, "block.*")
    counted = {r["token"]: r["n"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for number, ((label, t), s, (must, never)) in enumerate(zip(templates, sets, siblings_of(templates, threshold), strict=True)):
        ranked, need = sorted(s, key=rank.__getitem__), needed(len(s), threshold)
        prefixes += [(number, label, width_of(t), ranked, len(s), need, must, never, place, token) for place, token in enumerate(ranked[: len(s) - need + 1])]
    table = blocks.sparkSession.createDataFrame(prefixes, "template int, label string, width int, template_tokens array<string>, size int, need int, must array<string>, never array<array<string>>, template_place int, token string")
    ordered = blocks.select(*keys, "width", "at", F.array_intersect(literal_array(order), "tokens").alias("tokens"))
    placed = ordered.select(*keys, "width", "at", "tokens", F.posexplode("tokens").alias("place", "token"))
    possible = placed.join(F.broadcast(table), ["token", "width"]).filter(
        (F.size("tokens") >= F.col("need")) & (1 + F.least(F.size("tokens") - F.col("place") - 1, F.col("size") - F.col("template_place") - 1) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("tokens", "template_tokens"))
    told = (F.size(F.array_except("must", "tokens")) == 0) & ~F.exists("never", lambda words: F.size(F.array_except(words, F.col("tokens"))) == 0)
    verified = possible.withColumn("overlap", overlap).filter((F.col("overlap") >= F.col("need")) & told)
    return verified.select(*keys, "width", "at", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (those that match a template: first word, width, template's number, label, containment)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    blocks = cut_lineage(blocks_of(rows.withColumn("text", lowered_ascii(F.col("text"))), "text", ["doc_id", "key"], templates, threshold))
    by_row = (
        matches(blocks, ["doc_id", "key"], templates, threshold)
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("method_labels"), F.max("containment").alias("best"), F.collect_set(F.struct("at", "width", "template", "label", "containment")).alias("found"))
    )
    places = phrase_places(rows, "text", ["doc_id", "key"], phrases)
    joined = blocks.groupBy("doc_id", "key").agg(F.max("n_words").cast("long").alias("n_words"), F.count("*").cast("int").alias("repeats"))
    for side in (by_row, places):
        side = side.withColumnsRenamed({"doc_id": "side_id", "key": "side_key"})
        joined = joined.join(side, F.col("doc_id").eqNullSafe(F.col("side_id")) & (F.col("key") == F.col("side_key")), "left").drop("side_id", "side_key")
    joined = joined.withColumn("repeat", F.explode(F.array_repeat(F.lit(0), F.col("repeats"))))
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base_labels", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("method_labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("best"), F.lit(0.0))).alias("score"),
        F.coalesce(F.array_sort("found"), F.array().cast("array<struct<at:int,width:int,template:int,label:string,containment:double>>")).alias("blocks"),
    )
