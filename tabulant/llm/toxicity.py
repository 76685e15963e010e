"""Toxicity by a subword-bag model: embeddings of words and their character n-grams, averaged, into a
linear softmax, trained jointly in numpy.

Every run of ``WINDOW`` words of a text is a window.  A word's vector is the average of the embeddings of its
features: the word itself and its character n-grams of 3 to 5 bytes, with the blanks around it, each
hashed into one of ``BUCKETS`` rows; a window's vector averages its words.  An unseen misspelling thus
shares most of its vector with the word it misspells.  A text is as toxic as its most toxic window,
so a long text is not diluted, and words in front of a phrase do not split it; training takes the gradient at that
window.  One dimension starts as the log-odds of the texts that hold a feature, so that the first windows chosen are
not random ones.

Fitting takes a sample of at most ``FIT_ROWS`` labelled rows of each class of at most ``MAX_FIT_BYTES``
each, drawn by a seeded hash: that is the one bounded sample, and the model's size is fixed.  Scoring reads every text whole; it
needs one number per bucket, the embedding times the difference of the two softmax rows.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSIONS = 8
WINDOW = 6
FIT_ROWS = {0: 2500, 1: 1500}
MAX_FIT_BYTES = 1 << 14
EPOCHS = 15
LEAST_TEXTS = 5
LARGEST_ODDS, FIRST_SLOPE = 3.0, 6.0
SETTLED = 0.01  # a text with a smaller error moves nothing
REFRESH = 32  # texts between two refreshes of the numbers that choose windows
SEED = 7

_BLANK = 32
_TABLE = bytes(
    b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else _BLANK for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(65 - BUCKETS.bit_length())
_ROLL = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(256, 0x5851F42D4C957F2D, np.uint64))


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of a text's features, word by word, and where each word's features start and end.

    A word is the mean of its features over ``WINDOW``, so a window is the sum of its words and a short one is not
    inflated.  A word that also stands among the ``WINDOW - 1`` words before it has no features there: in
    a window it counts once.  Vectorised over the bytes of the text.
    """
    data = np.frombuffer(b" " + text.encode().translate(_TABLE) + b" ", np.uint8)
    blank = data == _BLANK
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
    n = len(starts)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)
    marks = np.zeros(len(data), np.int64)
    marks[starts] = 1
    word = np.cumsum(marks) - 1
    wide = data.astype(np.uint64)

    # whole words: the sum of a word's bytes by powers of an odd number
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    terms = np.where(blank, np.uint64(0), wide * _POWERS[np.clip(place, 0, len(_POWERS) - 1)])
    whole = np.add.reduceat(terms, starts) * _MIX
    alike = np.argsort(whole, kind="stable")
    again = (whole[alike[1:]] == whole[alike[:-1]]) & (np.diff(alike) < WINDOW)
    counts = np.ones(n, bool)
    counts[alike[1:][again]] = False

    # character n-grams: one may start or end at a blank but holds none inside
    buckets, owners = [whole >> _SHIFT], [np.arange(n)]
    rolled, inside = wide, np.ones(len(data), bool)
    for size in range(2, max(SIZES) + 1):
        if len(data) < size:
            break
        rolled = rolled[:-1] * _ROLL + wide[size - 1 :]
        inside = inside[:-1] if size == 2 else inside[:-1] & ~blank[size - 2 : -1]
        if size in SIZES:
            at = np.flatnonzero(inside)
            buckets.append((rolled[at] + np.uint64(size)) * _MIX >> _SHIFT)
            owners.append(word[at + 1])
    owner = np.concatenate(owners)
    keep = counts[owner]
    order = np.argsort(owner[keep], kind="stable")
    owner = owner[keep][order]
    sizes = np.bincount(owner, minlength=n)
    weight = 1 / (WINDOW * sizes[owner])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(buckets)[keep][order].astype(np.int32), weight.astype(np.float32), cuts


def window_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of a text's feature values over every run of ``WINDOW`` words; over all words if there are fewer."""
    ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[cuts]
    return ends[WINDOW:] - ends[:-WINDOW] if len(ends) > WINDOW else ends[-1:]


@dataclass
class Model:
    """``weights[bucket]`` is the log-odds that a feature adds to its window's average."""

    weights: np.ndarray
    bias: float

    def logit(self, text: str) -> float:
        buckets, weight, cuts = features(text)
        if not len(buckets):
            return self.bias
        return float(window_sums(self.weights[buckets] * weight, cuts).max() + self.bias)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def _prepared(texts: list[str], labels: list[int], least_texts: int):
    """Features of all texts in two flat arrays, per text where its words start and end in them, and per class and
    bucket the number of texts.

    A feature of fewer than ``least_texts`` texts gets the weight 0: it says which text this is, not what
    kind.  A text has at most one feature per byte and n-gram size and one per word; what is reserved
    beyond the true number is never touched.
    """
    room = sum(len(SIZES) * (len(t.encode()) + 2) + len(t) // 2 + 2 for t in texts)
    buckets_of, weight_of = np.empty(room, np.int32), np.empty(room, np.float32)
    cuts_of, end, held_by = [], 0, np.zeros((2, BUCKETS), np.int32)
    for text, label in zip(texts, labels):
        buckets, weight, cuts = features(text)
        buckets_of[end : end + len(buckets)] = buckets
        weight_of[end : end + len(buckets)] = weight
        cuts_of.append(end + cuts)
        held_by[label, np.unique(buckets)] += 1
        end += len(buckets)
    rare = held_by.sum(0) < least_texts
    for low in range(0, end, 1 << 22):
        some = slice(low, min(end, low + (1 << 22)))
        weight_of[some][rare[buckets_of[some]]] = 0
    return buckets_of, weight_of, cuts_of, held_by


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.5, least_texts: int = LEAST_TEXTS) -> Model:
    """Train embeddings and softmax together by Adagrad; without both classes every text scores 0.

    The gradient is taken at a text's most toxic window so far.
    """
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = rng.uniform(-0.5, 0.5, (2, DIMENSIONS)).astype(np.float32)
    buckets_of, weight_of, cuts_of, held_by = _prepared(texts, labels, least_texts)
    # one dimension starts as the log-odds of the texts that hold a feature, shrunk where they are few
    share = (held_by + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
    known = held_by.sum(0) / (held_by.sum(0) + least_texts)
    embeddings[:, 0] = np.clip(np.log(share[1] / share[0]), -LARGEST_ODDS, LARGEST_ODDS) * known
    softmax[:, 0] = -FIRST_SLOPE / 2, FIRST_SLOPE / 2
    bias = np.zeros(2, np.float32)
    seen_e, seen_s, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full(2, 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for turn, i in enumerate(rng.permutation(len(texts))):
            if turn % REFRESH == 0:
                toxic = embeddings @ (softmax[1] - softmax[0])
            cuts = cuts_of[i]
            first, last = cuts[0], cuts[-1]
            if last > first and len(cuts) > WINDOW + 1:
                w = int(window_sums(toxic[buckets_of[first:last]] * weight_of[first:last], cuts - first).argmax())
                first, last = cuts[w], cuts[w + WINDOW]
            buckets, weight = buckets_of[first:last], weight_of[first:last]
            hidden = weight @ embeddings[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            odds = softmax @ hidden + bias
            share = np.exp(odds - odds.max())
            error = (share / share.sum()).astype(np.float32)
            error[labels[i]] -= 1
            if abs(error[0]) < SETTLED:
                continue
            if len(buckets):
                own, which = np.unique(buckets, return_inverse=True)
                grads = np.bincount(which, weight).astype(np.float32)[:, None] * (error @ softmax)
                seen_e[own] += (grads**2).mean(1)
                embeddings[own] -= step * grads / np.sqrt(seen_e[own])[:, None]
                grad = np.outer(error, hidden)
                seen_s += (grad**2).mean(1)
                softmax -= step * 0.1 * grad / np.sqrt(seen_s)[:, None]
            seen_b += error**2
            bias -= step * 0.1 * error / np.sqrt(seen_b)
    toward = softmax[1] - softmax[0]
    return Model((embeddings @ toward).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 0


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: dict = FIT_ROWS,
    max_bytes: int = MAX_FIT_BYTES,
    seed: int = SEED,
    **options,
) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Only keys that have a text of at most ``max_bytes`` are drawn, so a longer one takes nobody's place.
    Labels other than 0 and 1 and null keys are ignored; of several labels of a key the higher counts, and
    of several texts the least.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= max_bytes)
    known = known.groupBy("key").agg(F.max("label").alias("label")).join(texts.select("key").distinct(), "key", "left_semi")
    draw = [F.xxhash64(F.lit(seed), "key"), "key"]
    chosen = [known.where(F.col("label") == c).orderBy(*draw).limit(n) for c, n in rows.items()]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most the sum of rows
    sample = texts.join(chosen, "key").groupBy("key", "label").agg(F.min("text").alias("text"))  # one row per chosen key
    sample = sorted((r["key"], r["text"], r["label"]) for r in sample.collect())
    return fit([s[1] for s in sample], [s[2] for s in sample], seed=seed, **options)


def scorer(spark: SparkSession, model: Model):
    """The model as a function of a text column; a null or empty text has the score of the bias alone."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score).astype("float64")

    return lambda text: scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, score)`` per row of ``docs``, repeated rows included."""
    return docs.select(
        F.col(key).alias(key), F.col(text).alias(text), scorer(docs.sparkSession, model)(F.col(text)).alias("score")
    )
