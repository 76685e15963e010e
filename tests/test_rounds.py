import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.functions.draws import WORD
from tabulant.plans import network, rounds
from tabulant.plans.network import Contrastive, dense_stack, named_views
from tests.conftest import u

LAYERS = [*dense_stack("encoder", 4, 8, 2, 0.0), *dense_stack("projection", 8, 8, 2, 0.0)]


def objective():
    return Contrastive(LAYERS, 1e-3, 0.6, 0.5)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(i), [u("r", i, j) * 4 - 2 for j in range(4)]) for i in range(301)]
    return spark.createDataFrame(data, "key string, features array<double>").cache()


def test_one_shard_is_the_sequential_loop(rows):
    state, history = rounds.train(rows, objective(), n=301, epochs=2, batch_size=50, seed=5, shards=1)

    goal = objective()
    want = goal.net.initial(np.random.default_rng(5))
    lots = rows.select("key", F.xxhash64(F.lit(5), "key").alias("lot"), "features").collect()
    data = np.array([r.features for r in sorted(lots, key=lambda r: r.lot)], np.float32)
    for epoch in range(2):
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([5, epoch, 0, 0])))
        x = data[rng.permutation(301)]
        params = named_views(want["theta"], goal.net.shapes)
        stats = named_views(want["stats"], goal.net.buffers)
        gradient, want["scratch"] = np.empty_like(want["theta"]), np.empty_like(want["theta"])
        losses = []
        # six batches of 50; the single row left over joins the last
        for a, b in [(0, 50), (50, 100), (100, 150), (150, 200), (200, 250), (250, 301)]:
            losses.append(goal.step(params, stats, named_views(gradient, goal.net.shapes), x[a:b], None, rng) * (b - a))
            network.adam(want, gradient, goal.rate)
        assert history[epoch]["rows"] == 301
        assert history[epoch]["loss"] == pytest.approx(sum(losses) / 301, rel=1e-6)
    assert state["t"] == want["t"] == 12
    assert state["theta"] == pytest.approx(want["theta"], abs=1e-6)
    assert state["stats"] == pytest.approx(want["stats"], abs=1e-6)


def test_rows_of_one_lot_are_ordered_by_their_cells():
    rng = np.random.default_rng(0)
    lots = np.array([5, 3, 5, 5, 9, 3])
    cells = np.arange(12.0).reshape(6, 2) % 5
    for _ in range(20):
        mixed = rng.permutation(6)
        a = rounds.shuffled(lots, cells, np.random.default_rng(1))
        b = rounds.shuffled(lots[mixed], cells[mixed], np.random.default_rng(1))
        assert (cells[a] == cells[mixed][b]).all() and (lots[a] == lots[mixed][b]).all()


def test_epochs_take_uniform_orders():
    """Over many epochs every row is about as often at every place."""
    lots = np.arange(20)[::-1].copy()
    places = np.zeros((20, 20))
    for epoch in range(2000):
        order = rounds.shuffled(lots, lots[:, None], np.random.Generator(np.random.Philox(np.random.SeedSequence([1, epoch, 0, 0]))))
        places[order, np.arange(20)] += 1
    assert (places.sum(1) == 2000).all() and abs(places - 100).max() < 50


def test_an_epoch_neither_sorts_nor_draws(rows, monkeypatch):
    plans = []
    run = rounds.run_round

    def spied(dealt, *args):
        plans.append(dealt._jdf.queryExecution().executedPlan().toString())
        return run(dealt, *args)

    monkeypatch.setattr(rounds, "run_round", spied)
    rounds.train(rows, objective(), n=301, epochs=3, batch_size=16, seed=1, shards=2, local_steps=3)
    assert len(plans) == 12 and not any("Sort" in p or "md5" in p or "Window" in p for p in plans)


@pytest.mark.parametrize("labelled", [True, False])
def test_a_dealt_shard_is_few_records(rows, monkeypatch, labelled):
    """What an epoch reads again are records of many rows, and no row, lot or label is lost in them."""
    monkeypatch.setattr(rounds, "PACK", 16)
    seen, run = [], rounds.run_round

    def spied(dealt, *args):
        seen.append(dealt.toArrow())
        return run(dealt, *args)

    monkeypatch.setattr(rounds, "run_round", spied)
    goal = network.Supervised(network.classifier_stack(4, 8, 3, 0.0), 1e-3) if labelled else objective()
    some = rows.withColumn("label", F.col("key").cast("int") % 3) if labelled else rows
    _, history = rounds.train(some, goal, n=301, epochs=2, batch_size=16, seed=1, shards=2)
    assert [h["rows"] for h in history] == [301, 301]
    assert all(t.num_rows <= 301 // 16 + 4 and sum(t["rows"].to_pylist()) == 301 for t in seen)
    lots, x = (rounds.unpacked(seen[0], *c) for c in (("lots", np.int64), ("features", np.float32)))
    y = rounds.unpacked(seen[0], "labels", np.int64)
    want = {r[0]: (r.features, r.label if labelled else None) for r in some.select(F.xxhash64(F.lit(1), "key"), "*").collect()}
    assert lots[:, 0].tolist() != sorted(want) and set(lots[:, 0].tolist()) == set(want)
    for i, lot in enumerate(lots[:, 0].tolist()):
        assert x[i] == pytest.approx(np.array(want[lot][0], np.float32)) and (y is None or y[i, 0] == want[lot][1])
    assert (y is None) == (not labelled)


def test_only_slices_with_lone_rows_reach_the_driver(spark, monkeypatch):
    seen = []
    found = rounds.partners
    monkeypatch.setattr(rounds, "partners", lambda counts, shards: seen.append(counts) or found(counts, shards))
    table = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.array(F.col("id") * 1.0, F.lit(2.0), F.lit(0.0), F.lit(1.0)).alias("features"))
    _, history = rounds.train(table, objective(), n=4000, epochs=1, batch_size=16, seed=1, shards=2, local_steps=8)
    assert history[0]["rows"] == 4000 and seen == [{}]


def test_layout_of_the_input_does_not_matter(rows):
    states = [
        rounds.train(rows.repartition(p), objective(), n=301, epochs=1, batch_size=32, seed=1, shards=3)[0]
        for p in (1, 4, 13)
    ]
    for other in states[1:]:
        assert (states[0]["theta"] == other["theta"]).all()


def test_rounds_split_an_epoch_and_see_every_row(rows):
    state, history = rounds.train(
        rows, objective(), n=301, epochs=2, batch_size=16, seed=1, shards=2, local_steps=3
    )
    assert rounds.plan_rounds(301, 16, 2, 3) == 4
    assert [h["rows"] for h in history] == [301, 301]
    assert np.isfinite(state["theta"]).all()


def test_average_weighs_by_rows():
    a, b = np.array([1.0, 2.0], np.float32), np.array([4.0, 8.0], np.float32)
    found = [
        {"state": a.tobytes(), "rows": 1, "loss": 2.0, "steps": 3},
        {"state": b.tobytes(), "rows": 2, "loss": 4.0, "steps": 5},
    ]
    flat, n, loss, steps = rounds.average(found)
    assert flat == pytest.approx([3.0, 6.0])
    assert (n, loss, steps) == (3, 6.0, 5)


def test_the_size_of_a_piece_does_not_matter(rows, monkeypatch):
    whole, _ = rounds.train(rows, objective(), n=301, epochs=1, batch_size=8, seed=1, shards=9)
    monkeypatch.setattr(rounds, "PIECE", 7)
    cut, _ = rounds.train(rows, objective(), n=301, epochs=1, batch_size=8, seed=1, shards=9)
    assert (cut["theta"] == whole["theta"]).all() and (cut["stats"] == whole["stats"]).all()


@pytest.mark.parametrize("n, shards", [(2, 4), (3, 32), (40, 32), (301, 4)])
def test_every_row_is_trained_on(rows, n, shards):
    some = rows.where(F.col("key").cast("int") < n)
    _, history = rounds.train(some, objective(), n=n, epochs=1, batch_size=8, seed=0, shards=shards)
    assert history[0]["rows"] == n


def test_more_shards_stay_near_the_sequential_loss(spark):
    data = [(str(i), [float(i % 3 == j) * 4 + u("c", i, j) for j in range(4)]) for i in range(2000)]
    table = spark.createDataFrame(data, "key string, features array<double>").cache()
    losses = [
        rounds.train(table, objective(), n=2000, epochs=4, batch_size=32, seed=2, shards=s)[1][-1]["loss"] for s in (1, 4)
    ]
    assert losses[1] == pytest.approx(losses[0], rel=0.1)


def test_scratch_is_removed(spark, rows):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rounds.train(rows, objective(), n=301, epochs=2, batch_size=64, seed=0)
    assert set(os.listdir(folder)) == before


def test_a_single_row_cannot_be_trained_on(rows):
    with pytest.raises(ValueError, match="two rows"):
        rounds.train(rows.where(F.col("key") == "7"), objective(), n=1, epochs=1, batch_size=8, seed=0)


def test_shards_are_even(rows):
    from tabulant.functions.draws import draw

    lots = [r[0] for r in rows.select(draw(0, "shard", F.col("key"))).collect()]
    assert all(0 <= lot < WORD for lot in lots)
    sizes = np.bincount(np.array(lots) % 4)
    assert sizes.min() > 50


@pytest.mark.parametrize("n", [2_000, 33_000])
def test_tables_of_any_size_take_the_same_shards(spark, n):
    cells = [F.rand(j).alias(str(j)) for j in range(4)]
    table = spark.range(n).select(F.col("id").cast("string").alias("key"), F.array(*[c for c in cells]).alias("features"))
    state, history = rounds.train(table, objective(), n=n, epochs=1, batch_size=256, seed=0)
    assert history[0]["rows"] == n
    # the longest shard decides the number of steps: about a fourth of the batches at every size
    assert state["t"] == pytest.approx(n / 256 / rounds.SHARDS, rel=0.1, abs=1)
