import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulant.operators import sampling


def place(salt, i):
    return int(hashlib.md5(f"{salt}:{i}".encode()).hexdigest()[:8], 16), i


def keys(df, name="id"):
    return sorted(r[0] for r in df.select(name).collect())


@pytest.mark.parametrize("n, p", [(20, 0.2), (1000, 0.1), (777, 0.5)])
def test_split_is_exact_and_follows_the_hash(spark, n, p):
    train, valid = sampling.validation_split(spark.range(n), p, ["id"], seed=3)
    want = sorted(range(n), key=lambda i: place("3:split", i))[: math.floor(p * n)]
    assert keys(valid) == sorted(want)
    assert keys(train) == sorted(set(range(n)) - set(want))


@pytest.mark.parametrize("n, p", [(9, 0.1), (10, 1.0)])
def test_split_refuses_an_empty_side(spark, n, p):
    with pytest.raises(ValueError, match="empty"):
        sampling.validation_split(spark.range(n), p, ["id"])


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_results_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(2000).repartition(partitions)
    _, valid = sampling.validation_split(df, 0.1, ["id"])
    batches = sampling.assign_batches(df, ["id"], 64)
    total = valid.agg(F.sum("id")).first()[0], batches.agg(F.sum(F.expr("id * batch * (pos + 1)"))).first()[0]
    if not hasattr(test_results_do_not_depend_on_partitions, "seen"):
        test_results_do_not_depend_on_partitions.seen = total
    assert total == test_results_do_not_depend_on_partitions.seen


def test_stratified_sample_rounds_half_to_even(spark):
    # classes of 10, 11, 30, 50, 1000 rows and one of nulls
    sizes = {"ten": 10, "eleven": 11, "thirty": 30, "fifty": 50, "many": 1000, None: 100}
    rows, at = [], 0
    for name, size in sizes.items():
        rows += [(at + i, name) for i in range(size)]
        at += size
    df = spark.createDataFrame(rows, "id bigint, label string")
    sample = sampling.stratified_sample(df, "label", ["id"])
    found = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    # round(0.5) = 0, round(0.55) = 1, round(1.5) = 2, round(2.5) = 2
    assert found == {"eleven": 1, "thirty": 2, "fifty": 2, "many": 50, None: 5}
    many = [i for i, name in rows if name == "many"]
    want = sorted(many, key=lambda i: place("0:stratum", i))[:50]
    assert keys(sample.where("label = 'many'")) == sorted(want)


@pytest.mark.parametrize("cells", ["id", "id % 5", "1"])
@pytest.mark.parametrize("keys_", ["id % 4", "cast(null as bigint)", "if(id % 3 = 0, 7, id)"])
def test_split_is_exact_among_repeated_keys(spark, keys_, cells):
    """Also where rows of one key, or rows that are equal in every column, straddle the cut."""
    df = spark.range(1000).selectExpr(f"{keys_} as k", f"cast({cells} as bigint) as x").repartition(5)
    for p in (0.1, 0.37):
        train, valid = sampling.validation_split(df, p, ["k"], seed=1)
        assert (train.count(), valid.count()) == (1000 - math.floor(p * 1000), math.floor(p * 1000))
        both = Counter(map(tuple, train.collect())) + Counter(map(tuple, valid.collect()))
        assert both == Counter(map(tuple, df.collect()))
        again = sampling.validation_split(df.repartition(2), p, ["k"], seed=1)[1]
        assert Counter(map(tuple, again.collect())) == Counter(map(tuple, valid.collect()))


@pytest.mark.parametrize("max_levels", [2, 1000])
def test_sample_is_exact_among_repeated_keys(spark, max_levels):
    """Broadcast or shuffled, with one key per class, a few, or equal rows."""
    df = spark.range(3000).selectExpr(
        "case when id < 2000 then 'big' when id < 2600 then 'equal' when id < 2990 then null else 'few' end as c",
        "id % 3 as k", "if(id between 2000 and 2599, 0, id) as x",
    )
    got = sampling.stratified_sample(df, "c", ["k"], 0.05, max_levels=max_levels)
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"big": 100, "equal": 30, None: 20}
    assert not Counter(map(tuple, got.collect())) - Counter(map(tuple, df.collect()))


def test_many_classes(spark):
    df = spark.range(40_000).selectExpr("id div 20 as c", "id")
    got = sampling.stratified_sample(df, "c", ["id"], 0.05)
    assert got.count() == 2000 and got.select("c").distinct().count() == 2000


def test_batches_are_full_but_the_last(spark):
    out = sampling.assign_batches(spark.range(1000), ["id"], 64, epoch=1)
    sizes = [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [64] * 15 + [40]
    order = [r.id for r in out.orderBy("batch", "pos").collect()]
    assert order == sorted(range(1000), key=lambda i: place("0:batch:1", i))


def test_epochs_shuffle_anew(spark):
    first = sampling.assign_batches(spark.range(300), ["id"], 32, epoch=0).orderBy("id").collect()
    second = sampling.assign_batches(spark.range(300), ["id"], 32, epoch=1).orderBy("id").collect()
    assert first != second


def test_row_key_with_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 64)
    # a third of the table is one row, repeated
    df = spark.range(1500).select(F.expr("if(id < 500, 0, id)").alias("x"), F.expr("if(id % 2 = 0, null, 'b')").alias("c"))
    keyed = sampling.with_row_key(df)
    assert keyed.count() == 1500
    assert keyed.select("row_key").distinct().count() == 1500
    assert keyed.drop("row_key").exceptAll(df).count() == 0
    again = sampling.with_row_key(df.repartition(7))
    assert keys(again, "row_key") == keys(keyed, "row_key")
