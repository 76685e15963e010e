"""Benchmark decontamination by a distributed positional inverted index.

1. The frequency of every benchmark term is counted over the whole corpus.
2. Every window of 13 consecutive words of an item names its rarest terms: two for phrases, and for
   proximity as many as a text can lack, and one more, of those that the corpus has.
3. The index is stored: postings of these terms over all documents, each with its term, its place and
   the words around it.  Other terms are not posted, nor are places with too few of an item's words around.
4. Postings meet the items at their term.  A place minus the place in the item is the diagonal; the
   lists of a window's phrase anchors are intersected on it.  Where all of them agree and the words around
   equal the window, it is an exact phrase.
5. A proximity match is a window with ``NEAR_SHARE`` of its distinct words, in any order, within 13
   consecutive words of the text.  Such a text holds at least one of the window's proximity anchors, so
   every match is found from a posting, whatever other documents hold.

Everything is DataFrame operations, and texts are never shuffled.  The benchmark is taken in blocks
of at most ``block_words`` words.  The windows and anchors of one block are broadcast: their rows are at most
its words, whatever the benchmark, and every block is a pass over the corpus.  So a term that stands in
many items or documents is never a hot key of a join.
"""

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.llm.text import words
from tabulant.sources.scratch import materialize

WINDOW = 13
ANCHORS = 2
NEAR_SHARE = 0.7
BLOCK_WORDS = 500_000
END = ""  # a posting of it, behind the last word, tells the length of a text


def item_texts(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences ``(seq, words)`` and which items have them; items without words go."""
    listed = items.select(F.col(key).alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    listed = listed.select("item", F.sha2(F.array_join("words", " "), 256).alias("seq"), "words")
    return listed.select("seq", "words").dropDuplicates(["seq"]), listed.select("seq", "item").distinct()


def term_frequency(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in the corpus; ``terms`` is of bounded size."""
    found = texts.select(F.explode("words").alias("term")).join(F.broadcast(terms), "term", "left_semi")
    return found.groupBy("term").agg(F.count("*").alias("frequency"))


def item_windows(
    sequences: DataFrame,
    frequency: DataFrame,
    window: int = WINDOW,
    anchors: int = ANCHORS,
    near_share: float = NEAR_SHARE,
) -> DataFrame:
    """``(seq, first, window, need, anchors, near)``: each window with the places and terms of its rarest terms.

    An item of fewer words is one window.  ``need`` is how many of its distinct words a proximity match
    holds.  A text with ``need`` of them lacks at most ``present - need`` of those that the corpus has, so
    one more of the rarest, ``near``, cannot all be lacking.  A window with a term that the corpus
    lacks is no phrase and has no ``anchors``; one with fewer than ``need`` present terms is left out.
    """
    placed = sequences.select("seq", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    placed = placed.join(frequency, "term", "left").fillna(0, ["frequency"])
    ahead = Window.partitionBy("seq").orderBy("at").rowsBetween(0, window - 1)
    framed = placed.select("seq", "n", "at", F.collect_list(F.struct("frequency", "at", "term")).over(ahead).alias("cells"))
    framed = framed.where(F.col("at") <= F.greatest(F.col("n") - window, F.lit(0)))
    terms = F.transform("cells", lambda c: c["term"])
    framed = framed.select(
        "seq",
        F.col("at").alias("first"),
        terms.alias("window"),
        F.ceil(F.size(F.array_distinct(terms)) * F.lit(near_share) - 1e-9).cast("int").alias("need"),
        F.array_sort("cells").alias("cells"),
    )
    # the first place of every present term, rarest first
    present = F.filter(
        "cells",
        lambda c: (c["frequency"] > 0) & (F.col("first") + F.array_position("window", c["term"]) - 1 == c["at"]),
    )

    def named(cells):
        return F.transform(cells, lambda c: F.struct(c["at"].alias("at"), c["term"].alias("term")))

    whole = ~F.exists("cells", lambda c: c["frequency"] == 0)
    rarest = F.slice("cells", 1, F.when(whole, anchors).otherwise(0))
    return framed.withColumn("present", present).where(F.size("present") >= F.col("need")).select(
        "seq",
        "first",
        "window",
        "need",
        named(rarest).alias("anchors"),
        named(F.slice("present", 1, F.size("present") - F.col("need") + 1)).alias("near"),
    )


def anchor_places(windows: DataFrame, sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(term, seq, anchor_at, centre, need)``: every anchor with the distinct item words around it, once."""
    lists = windows.select("seq", "need", F.explode(F.array_union("anchors", "near")).alias("anchor"))
    lists = lists.groupBy("seq", "anchor").agg(F.min("need").alias("need")).join(sequences, "seq")
    left = F.greatest(F.col("anchor.at") - (window - 1), F.lit(0))
    until = F.col("anchor.at") + window
    return lists.select(
        "anchor.term",
        "seq",
        F.col("anchor.at").alias("anchor_at"),
        F.array_distinct(F.slice("words", left + 1, until - left)).alias("centre"),
        "need",
    )


def positional_index(texts: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """Postings ``(key, text_hash, term, at, around, around_from)`` of the anchors, and of every text's end.

    ``around`` holds up to ``window - 1`` words on either side; ``around_from`` is the place of its first.
    A posting without the words of any anchor around it, exact or near, is not stored.
    """
    spark = places.sparkSession
    ended = spark.createDataFrame([(END, [], 0)], "term string, centre array<string>, need int")
    sought = places.select("term", "centre", "need").distinct().union(ended)
    sought = sought.withColumnRenamed("term", "sought")
    listed = texts.select("key", "text_hash", "words", F.posexplode(F.array_append("words", F.lit(END))).alias("at", "term"))
    left = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = F.slice("words", left + 1, F.col("at") + window - left)
    met = (F.col("term") == F.col("sought")) & (F.size(F.array_intersect("centre", around)) >= F.col("need"))
    return listed.join(F.broadcast(sought), met, "left_semi").select(
        "key",
        "text_hash",
        "term",
        "at",
        F.when(F.col("term") != END, around).alias("around"),
        left.alias("around_from"),
    )


def window_matches(postings: DataFrame, windows: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(key, text_hash, seq, kind, first, until)`` of phrases and proximity matches, words from 0.

    An item text that has a phrase in a text is not searched for proximity there.
    """
    own = ["key", "text_hash", "seq"]
    met = postings.where(F.col("term") != END).join(F.broadcast(places), "term")
    met = met.where(F.size(F.array_intersect("centre", "around")) >= F.col("need"))
    met = met.select(*own, "anchor_at", "at", "around", "around_from")

    diagonal = (F.col("at") - F.col("anchor_at")).alias("diagonal")
    seen = F.collect_set(F.struct("anchor_at", "around", "around_from")).alias("seen")
    diagonals = met.groupBy(*own, diagonal).agg(seen)
    # a window is met at its rarest anchor only
    by_rarest = windows.where(F.size("anchors") > 0).select(
        "seq", F.col("first").alias("item_first"), "window", F.col("anchors")[0]["at"].alias("rarest"), "anchors"
    )
    agreed = diagonals.select(
        *own, "diagonal", F.transform("seen", lambda s: s["anchor_at"]).alias("places"), F.explode("seen").alias("here")
    )
    agreed = agreed.withColumn("rarest", F.col("here.anchor_at")).join(F.broadcast(by_rarest), ["seq", "rarest"])
    agreed = agreed.where(F.forall("anchors", lambda a: F.array_contains("places", a["at"])))
    first = F.col("diagonal") + F.col("item_first")
    length = F.size("window")
    offset = first - F.col("here.around_from")
    exact = (offset >= 0) & (F.slice("here.around", F.greatest(offset, F.lit(0)) + 1, length) == F.col("window"))
    phrases = agreed.where(exact).select(
        *own, F.lit("phrase").alias("kind"), first.alias("first"), (first + length).alias("until")
    )
    phrases, _ = materialize(phrases, "phrases")

    found = phrases.select(*[F.col(c).alias(f"_{c}") for c in own]).distinct()
    without = met.distinct().join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own], "left_anti")
    by_near = windows.select("seq", F.array_distinct("window").alias("bag"), "need", F.explode("near").alias("a"))
    by_near = by_near.select("seq", F.col("a.at").alias("anchor_at"), "bag", "need").distinct()
    close = without.join(F.broadcast(by_near), ["seq", "anchor_at"])
    close = close.where(F.size(F.array_intersect("bag", "around")) >= F.col("need"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("around") - window, F.lit(0)))
    holds = F.filter(
        starts, lambda i: F.size(F.array_intersect("bag", F.slice("around", i + 1, window))) >= F.col("need")
    )
    start = F.col("around_from") + F.col("start")
    near = close.withColumn("start", F.get(holds, F.lit(0))).where("start is not null").select(
        *own,
        F.lit("near").alias("kind"),
        start.alias("first"),
        F.least(start + window, F.col("around_from") + F.size("around")).alias("until"),
    )
    return phrases.union(near)


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    anchors: int = ANCHORS,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts ``(key, text_hash, n_words)``, matches (see ``window_matches``) and ``(seq, item)``.

    There is one text row per row of ``docs``, repeated rows and null keys included; null and empty texts
    have no words and no matches.  Items without words match nothing; items of the same words are
    searched once.  Other columns are not read.
    """
    texts = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        words(F.col(text)).alias("words"),
    )
    sequences, owners = item_texts(items, item_key, item_text)
    sequences, _ = materialize(sequences, "sequences")
    total = sequences.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    lengths, matches = None, []
    for block in range(blocks):
        own = sequences.where(F.pmod(F.xxhash64("seq"), F.lit(blocks)) == block)
        terms = own.select(F.explode("words").alias("term")).distinct()
        frequency, _ = materialize(term_frequency(texts, terms), "frequency")
        windows, _ = materialize(item_windows(own, frequency, window, anchors), "windows")
        places, _ = materialize(anchor_places(windows, own, window), "anchors")
        postings, _ = materialize(positional_index(texts, places, window), "postings")
        if lengths is None:
            lengths = postings.where(F.col("term") == END).select("key", "text_hash", F.col("at").cast("long").alias("n_words"))
        matches.append(window_matches(postings, windows, places, window))
    return lengths, reduce(DataFrame.union, matches), owners


def contamination(lengths: DataFrame, matches: DataFrame, owners: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per text: hit words, items, and whether at least one word in twenty is hit.

    ``n_near`` counts the item texts that are near but have no phrase in the text.
    """
    found, _ = materialize(matches.distinct(), "matches")
    own = ["key", "text_hash"]
    exact = found.where("kind = 'phrase'")

    def covered(spans):
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            spans,
            start,
            lambda s, x: F.struct(
                (s["n"] + F.greatest(x["until"] - F.greatest(x["first"], s["end"]), F.lit(0))).alias("n"),
                F.greatest(x["until"], s["end"]).alias("end"),
            ),
        )["n"]

    span = F.struct("first", "until")
    none = F.lit(None).cast("string")

    def marks_of(df, **given):
        cells = {"span": F.when(F.lit(False), span), "item": none, "seq": none, "near": none} | given
        return df.select(*own, *[c.alias(n) for n, c in cells.items()])

    named = exact.select(*own, "seq", "first", "until").dropDuplicates([*own, "seq"]).join(owners, "seq")
    marks = (
        marks_of(exact, span=span, seq=F.col("seq"))
        .union(marks_of(named, item=F.col("item").cast("string")))
        .union(marks_of(found.where("kind = 'near'"), near=F.col("seq")))
        .groupBy(*own)
        .agg(
            covered(F.array_sort(F.collect_set("span"))).cast("long").alias("n_hit"),  # 13 spans per word at most
            F.array_sort(F.collect_set("item")).alias("items"),
            F.size(F.array_except(F.collect_set("near"), F.collect_set("seq"))).cast("long").alias("n_near"),
        )
    )
    marks = marks.withColumnsRenamed({"key": "own_key", "text_hash": "own_hash"})
    same = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("text_hash") == F.col("own_hash"))
    joined = lengths.join(marks, same, "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        "text_hash",
    )
    return joined.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "n_near",
        "text_hash",
    )
