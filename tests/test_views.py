import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.operators import contrast, sampling, views
from tabulant.plans import network


@pytest.fixture(scope="module")
def batched(spark):
    rows = spark.range(500).select("id", F.array(*[(F.col("id") * 10 + j).cast("double") for j in range(4)]).alias("features"))
    return sampling.assign_batches(rows, ["id"], 64).cache()


def test_donors_come_from_the_same_column_and_batch(batched):
    rows = views.corrupt(batched, ["id"]).collect()
    assert len(rows) == 500
    members = {}
    for r in rows:
        members.setdefault(r.batch, set()).add(r.id)
    for r in rows:
        for j, value in enumerate(r.corrupted):
            donor, column = divmod(int(value), 10)
            assert column == j
            assert donor in members[r.batch]


def test_mask_rate_and_agreement_with_the_view(batched):
    masked = views.corruption_mask(batched, ["id"]).select("id", "mask")
    rows = views.corrupt(batched, ["id"]).join(masked, "id").collect()
    hit = np.array([r["mask"] for r in rows])
    changed = np.array([r.features for r in rows]) != np.array([r.corrupted for r in rows])
    assert abs(hit.mean() - 0.6) < 0.05
    assert not (changed & ~hit).any()


def test_odd_keys_change_only_masked_cells(spark):
    """Composite keys, colons, backslashes and nulls are spelled alike by the mask and the view."""
    parts = ["a", "a:b", "b", ":", "\\", "\\N", None, ""]
    pairs = [(x, y) for x in parts for y in parts]
    rows = [(x, y, i, [float(10 * i + j) for j in range(4)]) for i, (x, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "x string, y string, pos int, features array<double>").withColumn("batch", F.lit(0))
    masked = {r["pos"]: r["mask"] for r in views.corruption_mask(df, ["x", "y"]).collect()}
    assert len({tuple(m) for m in masked.values()}) > 10
    for r in views.corrupt(df, ["x", "y"]).collect():
        changed = [a != b for a, b in zip(r["features"], r["corrupted"])]
        assert all(hit or not c for hit, c in zip(masked[r["pos"]], changed))
        assert r["features"] != r["corrupted"] or sum(masked[r["pos"]]) < 4
    single = views.corrupt(df, ["x"]).where("x is null").count()
    assert single == len(parts)


@pytest.mark.parametrize("rate", [0.0, 1.0])
def test_extreme_rates(batched, rate):
    rows = views.corrupt(batched, ["id"], rate=rate).collect()
    same = np.mean([a == b for r in rows for a, b in zip(r.features, r.corrupted)])
    assert same == 1.0 if rate == 0 else same < 0.1


def test_other_columns_ride_along(batched):
    out = views.corrupt(batched.withColumn("label", F.col("id") % 3), ["id"])
    assert out.where("label != id % 3").count() == 0


def test_batch_similarity_against_the_full_matrix(batched):
    pairs = views.corrupt(batched, ["id"])
    found = contrast.batch_similarity(pairs, "id", "features", "corrupted").where("batch = 2").collect()
    rows = sorted(pairs.where("batch = 2").collect(), key=lambda r: r.id)
    z = np.array([r.features for r in rows] + [r.corrupted for r in rows])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    s = z @ z.T / 0.5
    n = len(rows)
    by = {(r.id, r.view): r for r in found}
    for i, r in enumerate(rows):
        for view in (0, 1):
            a = i + view * n
            others = np.delete(s[a], a)
            positive = s[a, (a + n) % (2 * n)]
            got = by[r.id, view]
            assert got.positive == pytest.approx(positive)
            assert got.nearest == pytest.approx(others.max())
            assert got.average == pytest.approx(others.mean())
            assert got.loss == pytest.approx(np.log(np.exp(others).sum()) - positive)


def test_loss_per_batch(batched):
    pairs = views.corrupt(batched, ["id"])
    loss = contrast.nt_xent_loss(pairs, "id", "features", "corrupted").orderBy("batch").collect()
    assert [r.views for r in loss] == [128] * 7 + [104]
    rows = sorted(pairs.where("batch = 0").collect(), key=lambda r: r.id)
    u = np.array([r.features for r in rows] + [r.corrupted for r in rows])
    assert loss[0].loss == pytest.approx(network.nt_xent(u, 0.5)[1].mean())
