"""Sharding by a two-pass external shuffle.

Pass 1 scatters every record into one of many buckets by seeded hashes; a bucket is small enough
for the memory of a task.  Pass 2 reads one bucket at a time, permutes it by Fisher-Yates with a
generator seeded by the bucket and writes it.  A shard is a run of buckets.

The law is ``key``: a record's shard is the highest of one seeded hash per shard (rendezvous
hashing), so its key and the number of shards decide, and one more shard takes records only into
itself.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulant.sources.scratch import new_path

BUCKET_BYTES = 32 << 20
SEED = 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is highest; the lowest of equal ones."""
    draws = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def fisher_yates(n: int, seed: tuple) -> np.ndarray:
    """A permutation of 0..n-1: each place from the last swaps with a drawn one at or below it."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).random(max(n, 1))
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle_buckets(bucket_bytes: int, seed: int, rows_per_batch: int = 512):
    """A function for ``mapInArrow`` over partitions of one bucket each, in a fixed order of rows.

    A bucket larger than planned (rows that repeat one key) is permuted in blocks of
    ``bucket_bytes``; its rows are in hash order, so a block is a bucket of a finer scatter.
    """

    def shuffled(block, bucket, block_no, start):
        table = pa.Table.from_batches(block)
        order = fisher_yates(table.num_rows, (seed, bucket, block_no))
        for low in range(0, table.num_rows, rows_per_batch):
            part = table.take(pa.array(order[low : low + rows_per_batch])).combine_chunks()
            places = pa.array(np.arange(start + low, start + low + part.num_rows))
            yield from part.append_column("pos", places).to_batches()

    def run(batches):
        block, size, start, block_no, bucket = [], 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(batch.schema.get_field_index("bucket"))[0].as_py()
            for low in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(low, rows_per_batch)
                block.append(part)
                size += part.nbytes
                if size >= bucket_bytes * 2:
                    yield from shuffled(block, bucket, block_no, start)
                    start += sum(b.num_rows for b in block)
                    block, size, block_no = [], 0, block_no + 1
        if block:
            yield from shuffled(block, bucket, block_no, start)

    return run


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 16,
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> str:
    """Write the shuffled records ``(key, text, shard, bucket, pos)``, one parquet file per bucket.

    ``pos`` counts from 0 in its bucket; the order of a shard is ``(bucket, pos)``.  Null keys share a
    shard, null texts are kept.  Rows that repeat a key share a shard by the law.  Other columns are
    left behind, so their names cannot clash.  The path defaults to a new one in the shared folder.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_shard = max(1, math.ceil(total / (shards * bucket_bytes)))
    scatter = F.xxhash64(F.lit(seed + 1), "key", "text")
    bucket = F.col("shard") * per_shard + F.pmod(F.col("scatter"), F.lit(per_shard)).cast("int")
    dealt = (
        rows.withColumn("shard", shard_of(F.col("key"), shards, seed))
        .withColumn("scatter", scatter)
        .withColumn("bucket", bucket)
        .repartitionById(shards * per_shard, "bucket")
        .sortWithinPartitions("scatter", "key")
        .select("key", "text", "shard", "bucket")
    )
    spelled = f"key {dict(rows.dtypes)['key']}, text string, shard int, bucket int, pos bigint"
    dealt.mapInArrow(_shuffle_buckets(bucket_bytes, seed), spelled).write.option("compression", "zstd").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written records, see ``write_shards``."""
    return spark.read.parquet(path)


def with_slots(rows: DataFrame) -> DataFrame:
    """Records with their ``slot``, gapless from 0 in every shard.

    Only the columns of ``rows`` travel: select what is needed of the texts before.
    """
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "bucket").withColumn("slot", F.col("start") + F.col("pos")).drop("start", "pos", "bucket")
