import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tabulant as tb
from tabulant.plans.network import Net

SMALL = dict(hidden=8, depth=2)


def fit(df, **options):
    given = dict(exclude_columns=["id", "target"], key_columns=["id"], batch_size=8, **SMALL)
    return tb.fit_extractor(df, **{**given, **options})


def latents(df):
    return [r.latent for r in df.orderBy("id").collect()]


def test_defaults_of_the_architecture(mixed):
    model = tb.fit_extractor(mixed, exclude_columns=["id", "target"], key_columns=["id"], batch_size=8)
    assert model.shape == {"hidden": 256, "depth": 4, "dropout": 0.0, "in_dim": 5}
    assert model.param_count == 256 * 5 + 199_168
    out = model.transform(mixed)
    assert out.columns == [*mixed.columns, "latent"]
    assert {len(v) for v in latents(out)} == {256}
    # only the encoder is kept
    assert all(name.startswith("encoder") for name in model.weights)


def test_loss_falls_on_clusters_and_clusters_separate(clusters, encoder):
    losses = [h["loss"] for h in encoder.history]
    assert losses[-1] < losses[0]
    # rows that look all alike would lose log(2 * 64 - 1) each
    assert losses[-1] < np.log(127) - 0.5
    rows = encoder.transform(clusters).select("label", "latent").collect()
    z = np.array([r.latent for r in rows])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    same = np.equal.outer([r.label for r in rows], [r.label for r in rows])
    sims = z @ z.T
    assert sims[same].mean() > sims[~same].mean() + 0.3


def test_validation_split_and_loss(mixed):
    model = fit(mixed, create_validation=True, validation_proportion=0.2, n_epochs=2)
    assert [(h["rows"], h["valid_rows"]) for h in model.history] == [(16, 4), (16, 4)]
    assert all(h["valid_loss"] > 0 for h in model.history)


def test_empty_validation_is_refused(mixed):
    with pytest.raises(ValueError, match="empty"):
        fit(mixed.limit(9), create_validation=True, validation_proportion=0.1)


def test_save_load_and_kind_check(spark, mixed, tmp_path):
    path = str(tmp_path / "encoder")
    model = fit(mixed, save_path=path)
    loaded = tb.ContrastiveEncoderModel.load(path)
    assert latents(loaded.transform(mixed)) == latents(model.transform(mixed))
    assert loaded.history == model.history
    assert latents(tb.extract_features(mixed, path, key_columns=["id"])) == latents(model.transform(mixed))
    with pytest.raises(ValueError, match="classifier"):
        tb.LatentClassifierModel.load(path)
    with pytest.raises(Exception, match="(?i)exist"):
        model.save(path)
    model.write().overwrite().save(path)


def test_wrong_inputs(mixed):
    with pytest.raises(ValueError, match="not supported"):
        fit(mixed, pretraining_type="VIME")
    with pytest.raises(TypeError):
        tb.extract_features(mixed, 42)
    model = fit(mixed)
    with pytest.raises(ValueError, match="label column"):
        tb.extract_features(mixed, model, want_labels=True)
    with pytest.raises(ValueError, match="cannot be excluded"):
        tb.extract_features(mixed, model, exclude_columns=["num1"])
    with pytest.raises(ValueError, match="already has"):
        model.transform(mixed.withColumn("latent", F.lit(1)))


def test_labels_stay_with_their_rows(mixed):
    out = tb.extract_features(mixed, fit(mixed), want_labels=True, label_column="target", key_columns=["id"])
    assert out.columns == ["id", "target", "latent"]
    assert out.select("id", "target").exceptAll(mixed.select("id", "target")).count() == 0


def test_forward_equals_numpy(mixed, encoder, clusters):
    prepared = encoder.prep.transform(clusters).orderBy("id").select("features").collect()
    x = np.array([r.features for r in prepared], np.float64)
    weights = {k: v.astype(np.float64) for k, v in encoder.weights.items()}
    want, _ = Net(encoder.layers).forward(weights, weights, x)
    double = encoder.set_output(precision="double").transform(clusters)
    assert np.allclose(latents(double), want, atol=1e-10)
    assert np.allclose(latents(encoder.transform(clusters)), want, atol=1e-4)


def test_any_size_can_be_scored(mixed):
    model = fit(mixed)
    assert model.transform(mixed.where("id = 3")).count() == 1
    one, every = latents(model.transform(mixed.where("id = 3"))), latents(model.transform(mixed))
    assert np.allclose(one, every[3:4], atol=1e-6)
    assert model.transform(mixed.where("id < 0")).collect() == []


def test_wide_output(mixed):
    model = fit(mixed, wide=True)
    out = model.transform(mixed)
    assert out.columns == ["id", "target", *[f"extracted_dim_{i}" for i in range(1, 9)]]
    assert out.count() == 20
    narrow = latents(model.set_output(wide=False).transform(mixed))
    assert [list(r[2:]) for r in out.orderBy("id").collect()] == narrow
    with pytest.raises(ValueError, match="another prefix"):
        model.transform(mixed.withColumn("extracted_dim_3", F.lit(0)))


def test_without_keys_duplicates_train_and_layout_is_irrelevant(spark, mixed):
    rows = mixed.select("num1", "cat1").where("id < 5")
    rows = rows.unionByName(rows).unionByName(rows)
    a = tb.fit_extractor(rows, batch_size=4, **SMALL)
    b = tb.fit_extractor(rows.repartition(7), batch_size=4, **SMALL)
    assert a.history[0]["rows"] == 15
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)


def test_tail_of_one_row(mixed):
    # 17 rows in batches of 8: the last batch takes the odd row
    assert fit(mixed.where("id < 17")).history[0]["rows"] == 17
    with pytest.raises(ValueError, match="two rows"):
        fit(mixed.where("id < 1"))


def test_single_feature_column(mixed):
    model = fit(mixed, terms=["num1"])
    assert model.shape["in_dim"] == 1
    assert model.transform(mixed.select("id", "num1")).count() == 20


def test_scan_is_narrow_and_filters_are_pushed(spark, mixed, tmp_path):
    path = str(tmp_path / "rows")
    mixed.withColumn("unused", F.lit("x")).write.parquet(path)
    model = fit(mixed)
    df = model.transform(spark.read.parquet(path)).where("id > 5").select("id", "latent")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan
    assert "unused" not in plan
    assert "target" not in plan


def test_a_fitted_model_scores_a_stream(spark, mixed, tmp_path):
    source = str(tmp_path / "in")
    mixed.repartition(3).write.parquet(source)
    model = fit(mixed)
    stream = spark.readStream.schema(mixed.schema).parquet(source)
    query = (
        model.transform(stream)
        .select("id", "latent")
        .writeStream.format("memory")
        .queryName("scored")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination(120)
    finally:
        query.stop()
    scored = spark.table("scored")
    assert scored.count() == 20
    assert scored.schema["latent"].dataType == T.ArrayType(T.FloatType())


def test_inference_batches_change_nothing(clusters, encoder):
    import tabulant as tb

    whole = {r["id"]: r["latent"] for r in tb.extract_features(clusters, encoder, key_columns=["id"]).collect()}
    cut = {r["id"]: r["latent"] for r in tb.extract_features(clusters, encoder, key_columns=["id"], batch_size=7).collect()}
    assert whole.keys() == cut.keys()
    assert all(np.allclose(whole[k], cut[k], atol=1e-5) for k in whole)


def test_extraction_from_prepared_columns(clusters, encoder):
    """Without preprocessing the table's own columns are the inputs; prepared ones give the same latent rows."""
    import tabulant as tb

    width = encoder.shape["in_dim"]
    ready = encoder.prep.transform(clusters)
    ready = ready.select("id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(width)])
    found = tb.extract_features(ready, encoder, key_columns=["id"], preprocess=False, want_labels=True, label_column="label")
    assert found.columns == ["id", "label", "latent"]
    got = {r["id"]: r["latent"] for r in found.collect()}
    want = {r["id"]: r["latent"] for r in tb.extract_features(clusters, encoder, key_columns=["id"]).collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    again = tb.extract_features(ready, encoder, exclude_columns=["id", "label"], preprocess=False)
    assert again.columns == ["latent"] and again.count() == len(want)
    with pytest.raises(ValueError, match="takes"):
        tb.extract_features(ready, encoder, preprocess=False)
