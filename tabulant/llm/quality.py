"""Quality by importance resampling (Xie et al., Data Selection for Language Models via Importance
Resampling, 2023).

Texts are bags of hashed uni- and bigrams.  Two generative models give each bucket a probability: the
raw one counts every document, the target one a bounded sample of documents labelled good.  The
log importance weight of a document is the mean of the log ratios of its n-grams, times ``EFFECTIVE_NGRAMS``: what a
sample of so many n-grams of it would weigh.  The sum over all its n-grams would let length decide, since a
thousand n-grams that are a little less likely outweigh any junk; ``PRIOR_NGRAMS`` more of ratio one keep short
documents from being decided by a single n-gram.

A sample of k documents without replacement, each drawn with probabilities proportional to the weights of those that
are left, is the k largest of log weight plus standard Gumbel noise.  The noise is a function of the seed and the key.
k is given, or a share of all documents; by default the share of good ones among the labelled documents of the table.

Tokens are runs of letters and digits or of other signs; a token equal to the one before is the token
"same", a run of digits is "number", so that forms of junk share their n-grams.
"""

import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.sources.scratch import materialize

BUCKETS = 1 << 14
TARGET_ROWS = 8000
SMOOTHING = 1.0
PRIOR_NGRAMS = 10
EFFECTIVE_NGRAMS = 100
SEED = 3

_TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\s0-9a-z\x80-\xff]+")
_SAME, _NUMBER = np.uint64(1), np.uint64(2)
_MIX, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(65 - BUCKETS.bit_length())
_DIGITS = frozenset(b"0123456789")


def ngrams(text: str) -> np.ndarray:
    """Buckets of the uni- and bigrams of a text."""
    tokens = _TOKEN.findall(text.encode().lower())
    if not tokens:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(crc32, tokens), np.uint64, len(tokens)) + np.uint64(3)
    numbers = np.fromiter((t[0] in _DIGITS for t in tokens), bool, len(tokens))
    hashed[numbers] = _NUMBER
    kinds = hashed.copy()
    kinds[1:][hashed[1:] == hashed[:-1]] = _SAME
    pairs = kinds[:-1] * _NEXT + kinds[1:] + np.uint64(7)
    return (np.concatenate([kinds, pairs]) * _MIX >> _SHIFT).astype(np.int64)


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams per bucket over ``(text, target)``: of all rows and of target rows.

    Every task adds up its own rows; the driver gets one row per bucket.
    """

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.bincount(ngrams(text), minlength=BUCKETS)
                counts[0] += own
                if target:
                    counts[1] += own
        some = np.flatnonzero(counts[0])
        columns = [pa.array(some, pa.int32()), pa.array(counts[0][some]), pa.array(counts[1][some])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "raw", "target"])

    rows = texts.mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket")
    found = np.zeros((2, BUCKETS), np.int64)
    for r in rows.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        found[:, r["bucket"]] = r["raw"], r["target"]
    return found[0], found[1]


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability per bucket; the raw model smooths the target one."""
    q = (raw + smoothing) / (raw + smoothing).sum()
    n = target.sum()
    p = (target + smoothing * BUCKETS * q) / (n + smoothing * BUCKETS)
    return np.log(p / q)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, small: int = 4096) -> float | None:
    """The exact k-th largest value, by counting in ever narrower bins; None if ``k`` is not positive."""
    if k <= 0:
        return None
    low, high = df.agg(F.min(column), F.max(column)).first()
    inside = df.select(F.col(column).alias("x")).where("x is not null")
    while low is not None and low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("bin")
        here = inside.where((F.col("x") >= low) & (F.col("x") <= high))
        found = here.groupBy(at).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts = {r["bin"]: r for r in found.collect()}
        for b in sorted(counts, reverse=True):
            if counts[b]["n"] >= k:
                break
            k -= counts[b]["n"]
        else:
            return low
        low, high = counts[b]["low"], counts[b]["high"]
        if counts[b]["n"] <= small:
            values = inside.where((F.col("x") >= low) & (F.col("x") <= high)).orderBy(F.desc("x")).limit(k).collect()
            return values[-1]["x"]
    return high


def weights(ratios: Broadcast, text: Column) -> Column:
    """``(n_ngrams, log_ratio)`` of a text: its n-grams and the sum of their log ratios; a null one is empty."""

    @F.pandas_udf("n_ngrams bigint, log_ratio double")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        own = [ngrams(t) for t in texts]
        return pd.DataFrame({"n_ngrams": [len(b) for b in own], "log_ratio": [float(ratios.value[b].sum()) for b in own]})

    return weighed(F.coalesce(text, F.lit("")))


def gumbel(seed: Column, key: Column) -> Column:
    """Standard Gumbel noise as a function of seed and key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(seed, key), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def fit_ratios(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    target_rows: int = TARGET_ROWS, seed: int = SEED,
) -> tuple[np.ndarray, float]:
    """Log ratios per bucket over ``docs``, and the share of good documents among the labelled ones.

    Labels other than 0 and 1 are ignored; of several labels of a key the lower counts.  Without good
    labels all ratios are 0; without labels the share is 1.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("key").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, good = known.join(texts.select("key").distinct(), "key", "left_semi").agg(F.count("*"), F.sum("label")).first()
    chosen = known.where("label = 1").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(target_rows)
    chosen = F.broadcast(chosen.select("key", F.lit(True).alias("target")))  # at most target_rows rows
    raw, target = bucket_counts(texts.join(chosen, "key", "left").select("text", F.coalesce("target", F.lit(False))))
    return (log_ratios(raw, target) if target.any() else np.zeros(BUCKETS)), (good / n if n else 1.0)


def _drawn(docs, kept, labels, key, text, k, share, effective, seed, options) -> tuple[DataFrame, str, float | None]:
    """Columns ``kept`` of ``docs`` and the structure of results in a new one, stored; its name; and the least draw selected."""
    ratios, good = fit_ratios(docs, labels, key, text, seed=seed, **options)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers
    name = "drawn"
    while name in docs.columns:
        name += "_"
    own = weights(shared, F.col(text))
    log_weight = effective * F.col(name)["log_ratio"] / (F.col(name)["n_ngrams"] + PRIOR_NGRAMS)
    rows = docs.withColumn(name, own).withColumn(name, F.struct(f"{name}.*", log_weight.alias("log_weight")))
    noise = gumbel(F.lit(seed + 1), F.col(key))
    rows = rows.withColumn(name, F.struct(f"{name}.*", (F.col(name)["log_weight"] + noise).alias("draw")))
    rows, _ = materialize(rows.select(*kept, name), "draws")
    if k is None:
        k = round((good if share is None else share) * rows.count())
    return rows, name, kth_largest(rows.select(F.col(name)["draw"].alias("draw")), "draw", k)


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None,
    share: float | None = None, effective: float = EFFECTIVE_NGRAMS, seed: int = SEED, **options,
) -> DataFrame:
    """``(key, n_ngrams, log_ratio, log_weight, draw, selected)`` per row of ``docs``.

    The ``k`` largest draws are selected, and those that tie with the last; repeated rows share their draw.  A null
    text is empty, and a text without n-grams has log weight 0.  Null keys share one noise.  Texts are read whole,
    once for the models and once for the weights.  Other columns are not read; an empty table gives an empty result.
    """
    rows, name, least = _drawn(docs.select(key, text), [key], labels, key, text, k, share, effective, seed, options)
    chosen = F.lit(False) if least is None else F.col("draw") >= least
    return rows.select(key, f"{name}.*").withColumn("selected", chosen)


def selected(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None,
    share: float | None = None, effective: float = EFFECTIVE_NGRAMS, seed: int = SEED, **options,
) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, with all their columns, whatever these are called."""
    rows, name, least = _drawn(docs, docs.columns, labels, key, text, k, share, effective, seed, options)
    return rows.where(F.lit(False) if least is None else F.col(name)["draw"] >= least).drop(name)
