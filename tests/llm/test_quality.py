import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulant.llm import quality


@pytest.mark.parametrize("k", [0, 1, 2, 499, 500, 1000, 2000])
def test_kth_largest_is_exact(spark, k):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), 0.25, 1e9, -1e-9]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quality.kth_largest(df, "x", k, bins=4, small=5)
    want = sorted(values, reverse=True)
    assert got == (None if k == 0 else want[k - 1] if k <= 1000 else min(values))


def judged(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))) + "." for _ in range(300)]
    bad = [" ".join([rng.choice(vocabulary)] * 30) for _ in range(30)] + ["a | b | " * 20 for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 300), None) for i in range(0, 360, 2)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"
    )
    return docs, labels


def test_selects_good_and_rejects_junk(spark):
    docs, labels = judged(spark)
    got = {r["doc_id"]: r["selected"] for r in quality.resample(docs, labels).collect()}
    assert len(got) == 360
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 360))


def test_weights_equal_brute_force(spark):
    docs, labels = judged(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    bags = [np.bincount(quality.ngrams(t), minlength=quality.BUCKETS) for _, t in rows]
    raw, target = sum(bags), sum(bags[i] for i in range(0, 300, 2))
    q = (raw + 1) / (raw + 1).sum()
    p = (target + quality.BUCKETS * q) / (target.sum() + quality.BUCKETS)
    ratios = np.log(p / q)
    got = {r["doc_id"]: r for r in quality.resample(docs, labels, k=17, effective=5).collect()}
    for (key, _), bag in zip(rows, bags):
        ratio = float((bag * ratios).sum())
        assert math.isclose(got[key]["log_ratio"], ratio, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[key]["log_weight"], 5 * ratio / (bag.sum() + quality.PRIOR_NGRAMS), abs_tol=1e-9)
    top = sorted(got.values(), key=lambda r: -r["draw"])
    assert [r["selected"] for r in top] == [True] * 17 + [False] * 343


def inclusion(log_weights, k):
    """The probability of each item to be among k drawn one after the other, by all sequences."""
    w, found = [math.exp(x) for x in log_weights], [0.0] * len(log_weights)

    def drawn(taken, chance):
        if len(taken) == k:
            for i in taken:
                found[i] += chance
            return
        left = sum(x for i, x in enumerate(w) if i not in taken)
        for i, x in enumerate(w):
            if i not in taken:
                drawn((*taken, i), chance * x / left)

    drawn((), 1.0)
    return found


def test_inclusion_frequencies_follow_the_weights(spark):
    """Over many seeds the k largest draws hold a document as often as drawing one after the other does."""
    log_weights, k, seeds = [0.0, 0.7, 1.5, -1.0, 2.5, 0.2], 3, 4000
    rows = spark.createDataFrame(list(enumerate(log_weights)), "key long, w double").crossJoin(spark.range(seeds))
    drawn = rows.withColumn("draw", F.col("w") + quality.gumbel(F.col("id").cast("int"), F.col("key")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("draw")))
    got = Counter(r["key"] for r in drawn.withColumn("rank", rank).where(F.col("rank") <= k).collect())
    for i, chance in enumerate(inclusion(log_weights, k)):
        assert abs(got[i] / seeds - chance) < 4.5 * math.sqrt(chance * (1 - chance) / seeds)


def test_noise_decides_between_like_documents(spark):
    """Of documents of one weight each seed takes others; the share is that of the labels unless given."""
    docs = spark.createDataFrame([(i, "some words of a text") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)] + [(9999, 0)], "doc_id long, quality int")
    chosen = [{r["doc_id"] for r in quality.resample(docs, labels, seed=s).where("selected").collect()} for s in (1, 2)]
    assert [len(c) for c in chosen] == [300, 300]
    assert len(chosen[0] & chosen[1]) < 260
    assert quality.resample(docs, labels, share=0.1).where("selected").count() == 40


def test_gumbel_draws_follow_the_weights(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(first + x + y for x in letters for y in letters) for first in "ab"]
    docs = spark.createDataFrame([(i, texts[i % 4 == 0]) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 4)], "doc_id long, quality int")
    got = quality.resample(docs, labels, k=1000, effective=1.0).where("selected").collect()
    assert len(got) == 1000 and 400 < sum(r["doc_id"] % 4 == 0 for r in got) < 1000  # weighted towards the target


def test_selected_rows_keep_their_columns(sample, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    wide = sample.withColumn("drawn", F.lit(1)).withColumn("drawn_", F.lit(2))
    got = quality.selected(wide, labels)
    assert got.columns == wide.columns
    want = quality.resample(sample, labels).where("selected").select("doc_id").collect()
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in want)


def test_odd_rows_and_no_labels(sample, empty, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.resample(sample, labels).collect()
    assert len(got) == len(rows) and all(r["log_weight"] == 0 and r["selected"] for r in got)
    assert quality.resample(empty, labels).collect() == []
