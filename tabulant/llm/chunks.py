"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where the masked hash is zero.
Boundaries are normalised: below the normal size a longer mask must match, above it a shorter one, so
sizes gather around the normal size.  A boundary depends on the last 32 bytes only, so an edit moves
the boundaries near it and no others.  A fingerprint is the set of the chunks' digests, each weighted
by the length of its chunk.  Containment of A in B is the length of A's chunks that B has, too, over
the length of all chunks of A.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 8, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 4
BUCKET_BYTES = 32 << 20
SEED = 9

GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS))
LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash behind every byte: the sum of ``GEAR[b] << age`` over the last 32 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums over 2, 4, .. 32 bytes
        if len(h) > step:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
    return h


def boundaries(data: bytes) -> list[int]:
    """Where the chunks end; the last end is the length."""
    n = len(data)
    if n <= MIN_SIZE:
        return [n] if n else []
    h = gear_hashes(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    ends, start = [], 0
    for at, is_strict in zip((loose + 1).tolist(), strict):
        while at - start > MAX_SIZE:
            start += MAX_SIZE
            ends.append(start)
        size = at - start
        if size >= MIN_SIZE and (is_strict or size >= NORMAL_SIZE):
            start = at
            ends.append(start)
    while n - start > MAX_SIZE:
        start += MAX_SIZE
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest of each distinct chunk and its length."""
    found, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        found[digest(data[start:end])] = end - start
        start = end
    return found


def containment(a: dict, b: dict) -> float:
    """Share of ``a`` that ``b`` holds, by length; two empty sets hold each other."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(chunks: dict) -> str:
    """One digest of the weighted set; equal texts have equal ones."""
    cells = np.array(sorted(chunks.items()), np.uint64)
    return xxhash.xxh3_128_hexdigest(cells.tobytes())


SCHEMA = pa.schema(
    [
        ("key", pa.int64()),
        ("n_chars", pa.int64()),
        ("n_chunks", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _pairs(batches):
    """Each row with the text after it in its bucket; the row that only follows comes last."""
    last = None
    for batch in batches:
        for key, text, follows in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if last is not None:
                yield *last, text
            last = None if follows else (key, text)


def _fingerprints(batches, rows_per_batch: int = 2000):
    out, after, after_chunks = [], None, None
    for key, text, following in _pairs(batches):
        data = text.encode()
        chunks = after_chunks if after is text else chunk_set(data)
        after, after_chunks = following, chunk_set(following.encode())
        n = len(text)
        quarter = n // 4
        edited = (text[: n - quarter] + following[:quarter]).encode()
        edited_chunks = chunk_set(edited)
        out.append(
            (
                key,
                n,
                len(chunks),
                hashlib.sha256(edited).hexdigest(),
                fingerprint(chunks),
                fingerprint(edited_chunks),
                containment(chunks, edited_chunks),
                containment(chunks, after_chunks),
            )
        )
        if len(out) >= rows_per_batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)


SPELLED = """key bigint, n_chars bigint, n_chunks bigint, edited_sha256 string, fingerprint string,
    edited_fingerprint string, near_edited double, near_next double"""


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs`` in the columns of ``SCHEMA``, with its key.

    Documents follow each other by ascending key, null keys first, equal keys by text; the first
    follows the last, so a single document follows itself.  A null text is empty; an empty text has no
    chunks.  Other columns are not read.  An empty table gives an empty result.

    Rows are dealt to buckets by ranges of the key.  The first row of each bucket is dealt a second time
    to the bucket before it, where it only follows, so no window spans the table and texts are
    shuffled once.  The driver holds the ends of the buckets, one number per ``bucket_bytes``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil(total / bucket_bytes))
    shares = [i / wanted for i in range(1, wanted)] or [0.5]
    cuts = np.unique(np.array(rows.agg(F.percentile_approx("key", shares, 10 * wanted)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        found = np.zeros(len(keys), np.int32)
        found[known] = np.searchsorted(cuts, keys[known].to_numpy(np.int64), side="right")
        return pd.Series(found)

    # nulls sort first; keys reach Python without nulls, so that none is rounded as a float
    bucket = F.when(F.col("key").isNull(), 0).otherwise(bucket_of(F.coalesce("key", F.lit(0))))
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("first"))
    heads = sorted((r["bucket"], r["first"]["key"]) for r in heads.collect())
    before = {head[1]: heads[i - 1][0] for i, head in enumerate(heads)}  # the first bucket's head follows the last
    targets = spark.createDataFrame(list(before.items()), "head bigint, target int")
    following = (
        rows.where(F.col("key").isNull() | F.col("key").isin([k for k in before if k is not None]))
        .groupBy("key")
        .agg(F.min("text").alias("text"))
        .join(targets, F.col("key").eqNullSafe(F.col("head")))
        .select(F.col("target").alias("bucket"), "key", "text", F.lit(True).alias("follows"))
    )
    dealt = (
        rows.select("bucket", "key", "text", F.lit(False).alias("follows"))
        .union(following)
        .repartitionById(len(cuts) + 1, "bucket")
        .sortWithinPartitions("follows", F.col("key").asc_nulls_first(), "text")
        .select("key", "text", "follows")
    )
    return dealt.mapInArrow(_fingerprints, SPELLED).withColumnRenamed("key", key)
