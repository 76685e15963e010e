"""Figures that must not grow with the table, or no faster than it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import tabulant as tb
from tabulant.plans import boosting, classifier, heads, rounds
from tabulant.plans.network import Contrastive, Net, dense_stack, named_views


def test_large_tables_take_more_shards_before_more_rounds():
    assert [rounds.plan_shards(n, 256, 256) for n in (2, 15_000, 262_144)] == [rounds.SHARDS] * 3
    assert rounds.plan_shards(1_500_000, 256, 256) == 23
    assert rounds.plan_rounds(1_500_000, 256, 23, 256) == 1
    assert rounds.plan_shards(10**9, 256, 256) == rounds.MOST_SHARDS
    # six times the rows, at most six times the rounds, whose states pass through the driver
    few, many = (rounds.plan_rounds(n, 256, rounds.plan_shards(n, 256, 256), 256) for n in (9_000_000, 54_000_000))
    assert (few, many) == (3, 18)


def test_rows_are_dealt_once(spark, monkeypatch):
    """Every epoch dealt all rows anew when there were several rounds."""
    dealt = []
    deal = rounds.deal
    monkeypatch.setattr(rounds, "deal", lambda rows, shards: dealt.append(shards) or deal(rows, shards))
    table = spark.range(200).select(F.col("id").cast("string").alias("key"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("features"))
    objective = Contrastive(dense_stack("encoder", 2, 4, 2, 0.0), 1e-3, 0.6, 0.5)
    _, history = rounds.train(table, objective, n=200, epochs=3, batch_size=16, seed=1, shards=2, local_steps=2)
    assert [h["rows"] for h in history] == [200] * 3 and dealt == [2] * rounds.plan_rounds(200, 16, 2, 2)


def test_packed_features_come_back(spark):
    rows = spark.range(50).select(F.lit(0).alias("shard"), F.col("id").alias("lot"), F.array(F.col("id") * 0.5, F.lit(3.0)).cast("array<float>").alias("features"))
    table = rounds.deal(rows, 1).toArrow().sort_by("lot")
    assert (rounds.unspelled(table["features"]) == np.column_stack([np.arange(50) * 0.5, np.full(50, 3.0)])).all()
    assert (rounds.unspelled(table.slice(7, 9)["features"])[:, 0] == np.arange(7, 16) * 0.5).all()


def test_steps_share_arrays_but_not_results():
    """Two steps of one network give what two fresh networks give."""
    rng = np.random.default_rng(0)
    layers = dense_stack("encoder", 3, 5, 3, 0.0)
    shared, xs = Net(layers), rng.normal(size=(2, 8, 3)).astype(np.float32)
    theta = shared.initial(rng)["theta"]

    def gradient(net, x):
        state = net.initial(rng)
        params, stats = named_views(theta, net.shapes), named_views(state["stats"], net.buffers)
        grads = np.zeros_like(theta)
        out, cache = net.forward(params, stats, x.copy(), True, rng, views=2)
        net.backward(params, cache, np.ones_like(out), named_views(grads, net.shapes))
        return grads

    for x in xs:
        assert (gradient(shared, x) == gradient(Net(layers), x)).all()


def latent_rows(spark, n=60):
    cells = F.array(*[F.col("id") * (i + 1) % 7 * 1.0 for i in range(4)])
    return spark.range(n).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 % 3).cast("int").alias("label"), cells.alias("latent"))


def test_planes_are_fitted_one_at_a_time_on_rows_kept_once(spark, monkeypatch):
    """The wide rows were persisted next to the blocks that every concurrent fit persists itself."""
    kept, running, most = [], [], []
    fit = heads.LinearSVC.fit

    def spied(self, rows):
        kept.append(rows.storageLevel)
        running.append(1)
        most.append(len(running))
        try:
            return fit(self, rows)
        finally:
            running.pop()

    monkeypatch.setattr(heads.LinearSVC, "fit", spied)
    heads.SvmHead.fit(latent_rows(spark).cache(), 3, 0, width=8, iterations=5)
    assert most == [1, 1, 1] and not any(level.useMemory or level.useDisk for level in kept)


def test_a_tree_is_evaluated_once_on_each_row(spark, monkeypatch):
    """Every level evaluated all trees so far."""
    sent = []
    level = boosting._level
    monkeypatch.setattr(boosting, "_level", lambda stored, growing, *rest: sent.append(growing["feature"].ndim) or level(stored, growing, *rest))
    trees, history = boosting.fit_boost(latent_rows(spark), 3, rounds=2, depth=2)
    assert sent and set(sent) == {2}  # the trees that grow, none of the rounds before
    assert len(history) == 3 and history[0] > history[1] > history[2]


def test_a_spark_classifier_reads_the_stored_rows(spark, monkeypatch):
    """The vectors were persisted next to the form that the classifier itself keeps."""
    kept, fit = [], heads.RandomForestClassifier.fit
    monkeypatch.setattr(heads.RandomForestClassifier, "fit", lambda self, rows: kept.append(rows.storageLevel) or fit(self, rows))
    forest = heads.SparkHead.fit(heads.ESTIMATORS["Random Forest"](3, 8, 2), latent_rows(spark), 3, 0)
    assert len(kept) == 1 and not kept[0].useMemory and not kept[0].useDisk
    assert forest.score(latent_rows(spark), "latent").where(F.size("probability") == 3).count() == 60


def test_a_classifier_stores_what_the_encoder_reads(spark, clusters, encoder, monkeypatch):
    """Latent rows (256 floats by default) were stored; a tree reads them twice."""
    stored, write = [], classifier.materialize
    monkeypatch.setattr(classifier, "materialize", lambda df, name: stored.append((out := write(df, name))[0].select(F.max(F.size(df.columns[-1]))).first()[0]) or out)
    model = tb.LatentClassifier(encoder=encoder, kind="C50", labelCol="label", keyCols=["id"]).fit(clusters)
    assert stored == [encoder.prep.width] and encoder.prep.width < encoder.shape["hidden"]
    want = {r[0]: r[1] for r in encoder.transform(clusters).select("id", "latent").collect()}
    inputs = clusters.select("id", encoder.prepared().alias("inputs"))
    for r in inputs.select("id", encoder.encode_prepared(spark, F.col("inputs")).alias("latent")).collect():
        assert np.allclose(r.latent, want[r.id], atol=1e-6)
    assert model.transform(clusters).where("prediction = label").count() > 570


def test_the_child_of_fewer_rows_is_counted():
    """Every level added up the histograms of all rows; the other child's are those of the node less the counted ones."""
    rng = np.random.default_rng(0)
    n, width, bins = 5000, 3, 16
    cells, g, h = rng.integers(0, bins, (n, width)).astype(np.uint8), rng.integers(-boosting.UNIT, boosting.UNIT, (n, 1)), rng.integers(1, boosting.UNIT // 2, (n, 1))
    rows = pa.RecordBatch.from_arrays([boosting.spell(x) for x in (cells, g.astype(np.int32), h.astype(np.int32))], names=["bins", "g", "h"])
    growing = {k: v[0] for k, v in boosting.empty_trees(1, 1, 2).items()}
    growing["feature"][0, 0], growing["split"][0, 0] = 1, 3

    class Shared:
        value = growing

    def counted(side, level):
        out = pa.Table.from_batches(boosting._histograms(Shared, np.array(side), level, bins, width)(iter([rows])))
        return out, np.frombuffer(out["sums"][0].as_py(), np.int64).reshape(boosting.TOGETHER, 3, bins)

    def want(own):
        return [[np.bincount(cells[own, j], w[own], bins) for w in (g[:, 0], h[:, 0], np.ones(n))] for j in range(width)]

    left = cells[:, 1] <= 3
    root, whole = counted([[0]], 0)
    few, part = counted([[0]], 1)
    assert (whole[:width] == want(np.ones(n, bool))).all() and (part[:width] == want(left)).all()
    above = pa.RecordBatch.from_arrays([root["cell"].combine_chunks(), pa.array([True]), root["sums"].combine_chunks()], names=["cell", "whole", "sums"])
    (splits,) = boosting._best_splits(np.array([[0]]), 1, width, bins, 1.0, 1.0, True)(iter([*few.to_batches(), above]))
    assert splits.column("node").to_pylist() == [0, 1] and splits.column("n").to_pylist() == [left.sum(), n - left.sum()]
    other = np.frombuffer(splits.column("sums")[1].as_py(), np.int64).reshape(boosting.TOGETHER, 3, bins)
    assert (other[:width] == want(~left)).all()
