"""License scan by a positional index of rare licence words.

Every template is a notice of some words with a mandatory key phrase at a known place in it.
1. The document frequency of each licence word is counted over all documents.
2. A key phrase is looked up by its words of highest IDF, the anchors.  The posting lists of the
   anchors in a file are shifted by their place in the phrase and intersected: what remains are
   the starts where all anchors stand as they do in the phrase.  No place is lost, because a
   place of the phrase holds all its anchors.
3. The other words of the key phrase are compared there.
4. A verified place is scored by the IDF share of the notice's words that stand around it as in
   the template.

The lists of a file live in its row, so nothing is shuffled but one count per licence word.
"""

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.text import string_array, words

# Label, notice, key phrase (a part of the notice), base label or not.
TEMPLATES = [
    ("mit", "released under the mit license", "under the mit license", True),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    ("agpl-3", "gnu affero general public license version 3", "gnu affero general public license version 3", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms", False),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal", False),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2", False),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     "permission to use copy modify and or distribute this software", False),
    ("lgpl-3", "gnu lesser general public license version 3", "gnu lesser general public license version 3", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge to any person", False),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0", False),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software released into the public domain", False),
]
ANCHORS = 2
DIGITS = 6


def place(notice: list, phrase: list) -> int:
    """Where the phrase stands in the notice."""
    return next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _, _ in templates for w in notice.split()})


def licence_idf(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """``1 + ln((N + 1) / (df + 1))`` of each licence word; one row per word reaches the driver."""
    vocab = vocabulary(templates)
    held = F.array_append(F.array_intersect(words(F.col(text)), string_array(vocab)), F.lit(""))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}  # "" stands once in every row
    n = df.get("", 0)
    return {w: 1 + math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocab}


def _anchors(phrase: list, idf: dict, count: int) -> list[tuple[str, int]]:
    """The phrase's words of highest IDF with their places."""
    order = sorted(range(len(phrase)), key=lambda i: (-idf[phrase[i]], i))
    return [(phrase[i], i) for i in order[:count]]


INDEX = """array<struct<label: string, base: boolean, place: int, phrase: array<string>,
    anchors: array<struct<word: string, offset: int>>,
    notice: array<struct<word: string, offset: int, weight: double>>>>"""


def template_index(templates, idf: dict, anchors: int) -> Column:
    """The templates as one literal: anchors by IDF, the phrase, the notice with offsets and weights."""
    index = []
    for label, notice, phrase, base in templates:
        notice, phrase = notice.split(), phrase.split()
        at, total = place(notice, phrase), sum(idf[w] for w in notice)
        index.append(
            {
                "label": label,
                "base": base,
                "place": at,
                "phrase": phrase,
                "anchors": [{"word": w, "offset": i} for w, i in _anchors(phrase, idf, anchors)],
                "notice": [{"word": w, "offset": j - at, "weight": idf[w] / total} for j, w in enumerate(notice)],
            }
        )
    return F.from_json(F.lit(json.dumps(index)), INDEX)


def _places(text_words: Column, postings: Column, template: Column) -> Column:
    """Verified places of one template."""

    def shifted(anchor):
        own = F.filter(postings, lambda p: p["word"] == anchor["word"])
        return F.transform(own, lambda p: p["at"] - anchor["offset"])

    lists = F.transform(template["anchors"], shifted)
    rest = F.slice(lists, 2, F.size(lists))
    starts = F.aggregate(rest, F.get(lists, F.lit(0)), lambda left, right: F.array_intersect(left, right))
    phrase = template["phrase"]
    whole = F.filter(
        starts,
        lambda s: (s >= 0) & (F.slice(text_words, F.greatest(s, F.lit(0)) + 1, F.size(phrase)) == phrase),
    )

    def place_at(s):
        # a word beyond either end of the text is null and so never equal
        stands = F.filter(template["notice"], lambda x: F.get(text_words, s + x["offset"]) == x["word"])
        share = F.aggregate(stands, F.lit(0.0), lambda total, x: total + x["weight"])
        return F.struct(
            s.cast("long").alias("start"),
            template["label"].alias("label"),
            template["base"].alias("base"),
            F.round(share, DIGITS).alias("coverage"),
        )

    return F.transform(whole, place_at)


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, anchors: int = ANCHORS
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_words`` and ``places``.

    ``places`` is an array of ``(start, label, base, coverage)`` in order of the start, one for every
    verified key phrase; words count from 0.  A null or empty text has no words and no places.
    Repeated rows stay as they are; other columns of ``docs`` are not read, so their names
    cannot clash.  An empty table gives an empty result.
    """
    idf = licence_idf(docs, text, templates)
    looked_up = [_anchors(phrase.split(), idf, anchors) for _, _, phrase, _ in templates]
    # the rarest word of each phrase decides whether a file is looked at any further
    rarest = sorted({a[0][0] for a in looked_up})
    anchor_words = sorted({w for a in looked_up for w, _ in a})
    w = F.col("words")
    listed = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    postings = F.filter(
        F.transform(w, lambda word, at: F.struct(word.alias("word"), at.alias("at"))),
        lambda p: p["word"].isin(anchor_words),
    )
    listed = listed.select(
        "key",
        F.size(w).cast("long").alias("n_words"),
        "words",
        F.when(F.arrays_overlap(w, string_array(rarest)), postings).alias("postings"),
    )
    index = template_index(templates, idf, anchors)
    found = F.flatten(F.transform(index, lambda t: _places(w, F.col("postings"), t)))
    none = F.array().cast("array<struct<start:bigint,label:string,base:boolean,coverage:double>>")
    places = F.when(F.col("postings").isNotNull(), F.array_sort(found)).otherwise(none)
    return listed.select(F.col("key").alias(key), "n_words", places.alias("places"))


def license_report(places: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, labels and score of ``scan_licenses``."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(F.col("base"), lambda p: p["start"])

    def joined(column):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda p: p["label"]))), ",")

    return places.withColumn("base", base).select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )
