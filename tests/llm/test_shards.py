import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabulant.llm import shards


def test_fisher_yates_is_a_fair_permutation():
    assert sorted(shards.fisher_yates(1000, (1, 2)).tolist()) == list(range(1000))
    assert shards.fisher_yates(1000, (1, 2)).tolist() == shards.fisher_yates(1000, (1, 2)).tolist()
    assert shards.fisher_yates(0, (1,)).tolist() == [] and shards.fisher_yates(1, (1,)).tolist() == [0]
    seen = Counter(tuple(shards.fisher_yates(3, (s,)).tolist()) for s in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def shuffled(spark, docs, **options):
    return shards.read_shards(spark, shards.write_shards(docs, **options))


def test_round_trip_and_slots(spark, sample, rows):
    for bucket_bytes in (10_000, shards.BUCKET_BYTES):
        got = shards.with_slots(shuffled(spark, sample, bucket_bytes=bucket_bytes)).collect()
        assert Counter((r["key"], r["text"]) for r in got) == Counter(r[:2] for r in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_order_does_not_depend_on_partitions(spark, sample):
    a, b = (
        sorted((str(r["key"]), str(r["text"]), r["shard"], r["slot"]) for r in shards.with_slots(shuffled(spark, df, bucket_bytes=50_000)).collect())
        for df in (sample, sample.repartition(7))
    )
    assert a == b


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20000).select(shards.shard_of(F.col("id"), 16).alias("a"), shards.shard_of(F.col("id"), 17).alias("b"))
    got = Counter(map(tuple, ids.collect()))
    assert all(a == b or b == 16 for a, b in got)
    sizes = Counter()
    for (a, _), n in got.items():
        sizes[a] += n
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.15 * 20000 / 16


def test_hot_rows_are_cut_into_blocks(spark):
    docs = spark.createDataFrame([(1, "x" * 1000)] * 3000 + [(i, "y") for i in range(100)], "doc_id long, text string")
    got = shards.with_slots(shuffled(spark, docs, bucket_bytes=100_000)).collect()
    assert len(got) == 3100
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_empty_table(spark, empty):
    assert shards.with_slots(shuffled(spark, empty)).collect() == []


def test_crc_of_the_query(spark, sample):
    got = sample.select("text", F.crc32(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert all(r["c"] == zlib.crc32((r["text"] or "").encode()) for r in got)
