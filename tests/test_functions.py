import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.functions import draws, vectors


def test_draws_match_hashlib(spark):
    text = hashlib.md5(b"7:cell:0:42:3").hexdigest()
    row = (
        spark.range(42, 43)
        .select(draws.digest(7, "cell", 0, F.col("id"), F.lit(3)).alias("d"))
        .select("d", draws.word(F.col("d"), 1).alias("w"), draws.uniform(F.col("d")).alias("u"))
        .first()
    )
    assert row.d == text
    assert row.w == int(text[8:16], 16)
    assert row.u == int(text[:8], 16) / 2**32


def test_l2_normalize_and_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()]
    assert out[0] == pytest.approx([0.6, 0.8])
    assert out[1] == [0.0, 0.0]


def test_softmax_is_stable_and_first_level_wins_ties(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([0.0, 1.0, 2.0],)], "z array<double>")
    p = df.select(vectors.softmax(F.col("z")).alias("p"))
    rows = p.select("p", vectors.argmax_label(F.col("p"), ["a", "b", "c"]).alias("l")).collect()
    assert rows[0].p == pytest.approx([0.5, 0.5, 0.0])
    assert rows[0].l == "a"
    e = np.exp([0.0, 1.0, 2.0])
    assert rows[1].p == pytest.approx(list(e / e.sum()))
    assert rows[1].l == "c"


def test_normalize_sum_of_zeros_is_uniform(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    assert df.select(vectors.normalize_sum(F.col("v"))).first()[0] == [0.25] * 4


def test_chance_agrees_with_uniform(spark):
    d = draws.digest("x", F.col("id"))
    for rate in (0.0, 0.25, 0.6, 1.0):
        off = spark.range(500).where(draws.chance(d, rate) != (draws.uniform(d) < F.lit(rate)))
        assert off.count() == 0


def test_composite_keys_do_not_collide(spark):
    from tabulant.functions.draws import row_key

    rows = [("a:b", "c"), ("a", "b:c"), (None, "a"), ("a", None), ("\\N", "a"), ("a\\", "b"), ("a", "\\:b"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_key(["x", "y"]).alias("k")).distinct().count() == len(rows)
    assert [r[0] for r in spark.createDataFrame([(7,)], "x int").select(row_key(["x"])).collect()] == ["7"]
