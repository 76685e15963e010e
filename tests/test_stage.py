import pytest
from pyspark.ml import PipelineModel

import tabulant as tb
from tabulant.operators.columns import all_numeric

SMALL = dict(epochs=1, batchSize=8, keyCols=["id"], hidden=8, depth=2)


def stage(**more):
    return tb.ExtractLatent(terms=[all_numeric("id", "target")], **{**SMALL, **more})


def test_fit_and_apply(mixed):
    model = tb.StagedPipeline(stages=[stage()]).fit(mixed)
    out = model.transform(mixed)
    assert model.stages[0].columns == ["num1", "num2"]
    assert out.columns == ["id", "cat1", "target", *[f"extracted_dim_{i}" for i in range(1, 9)]]
    assert out.count() == mixed.count()


def test_defaults():
    s = tb.ExtractLatent()
    assert s.getOrDefault("epochs") == 150
    assert s.getOrDefault("batchSize") == 256
    assert s.getOrDefault("preprocess") is False
    assert s.getOrDefault("skip") is False


def test_fit_at_the_default_epochs(clusters):
    """All 150 epochs run, and the loss falls."""
    terms = [f"x{j}" for j in range(6)]
    s = tb.ExtractLatent(terms=terms, keyCols=["id"], hidden=16, depth=2, numShards=1, learningRate=3e-3)
    history = s.fit(clusters.where("id < 120")).encoder.history
    losses = [h["loss"] for h in history]
    assert len(losses) == 150 and all(h["rows"] == 120 for h in history)
    assert sum(losses[-10:]) < 0.95 * sum(losses[:10])


def test_parameters_reach_the_trainer(mixed):
    more = dict(batchSizeInference=7, localSteps=3, corruptionRate=0.3, temperature=0.2, maxLevels=9)
    s = stage(**more)
    assert all(s.getOrDefault(k) == v for k, v in more.items())
    model = s.fit(mixed)
    assert model.encoder.getOrDefault("batchSizeInference") == 7
    assert model.transform(mixed).count() == mixed.count()


def test_tidy_before_and_after(spark, mixed):
    s = tb.ExtractLatent(terms=["num1", "num2"], stageId="latent_7", **SMALL)
    before = s.tidy(spark).collect()
    after = s.fit(mixed).tidy(spark).collect()
    assert [tuple(r) for r in before] == [("num1", "latent_7"), ("num2", "latent_7")]
    assert before == after


def test_repr(mixed):
    s = tb.ExtractLatent(terms=["num1"], **SMALL)
    assert repr(s) == "Latent feature extraction with SCARF: num1"
    assert repr(s.fit(mixed)) == "Latent feature extraction with SCARF: num1 | Trained"


def test_skip_applies_while_fitting_only(mixed):
    after = tb.ExtractLatent(terms=["extracted_dim_1", "extracted_dim_2"], prefix="second_", **SMALL)
    model = tb.StagedPipeline(stages=[stage(skip=True)]).fit(mixed)
    assert model.transform(mixed).columns == mixed.columns
    # the second stage was fitted on the first one's output
    both = tb.StagedPipeline(stages=[stage(skip=True), after]).fit(mixed)
    assert both.stages[1].columns == ["extracted_dim_1", "extracted_dim_2"]


def test_two_stages_need_two_prefixes(mixed):
    first = tb.ExtractLatent(terms=["num1"], **SMALL)
    second = tb.ExtractLatent(terms=["num2"], **SMALL)
    with pytest.raises(ValueError, match="another prefix"):
        tb.StagedPipeline(stages=[first, second]).fit(mixed).transform(mixed)


def test_text_columns_must_be_prepared_first(mixed):
    with pytest.raises(ValueError, match="cat1"):
        tb.ExtractLatent(terms=["cat1"], **SMALL).fit(mixed)


def test_persistence_in_a_pipeline(mixed, tmp_path):
    model = tb.StagedPipeline(stages=[stage(skip=False, stageId="s")]).fit(mixed)
    model.write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.stages[0].columns == ["num1", "num2"]
    assert again.transform(mixed).orderBy("id").collect() == model.transform(mixed).orderBy("id").collect()
