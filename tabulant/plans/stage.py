"""Latent extraction as a pipeline stage."""

import uuid

from pyspark import keyword_only
from pyspark.ml import Model, Pipeline
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame, SparkSession

from tabulant.operators.columns import all_numeric, resolve
from tabulant.plans.encoder import ContrastiveEncoder, ContrastiveEncoderModel, param
from tabulant.sources.store import Stored

TITLE = "Latent feature extraction with SCARF"


def describe(terms, trained: bool) -> str:
    return f"{TITLE}: {', '.join(terms)}{' | Trained' if trained else ''}"


def tidy(spark: SparkSession, terms, stage_id: str) -> DataFrame:
    return spark.createDataFrame([(t, stage_id) for t in terms], "terms string, id string")


class ExtractLatent(ContrastiveEncoder):
    """Replace the selected columns by their latent dimensions.

    The columns are taken as they are: earlier stages prepare them.  With ``skip`` the
    stage is applied while a ``StagedPipeline`` is fitted, but not to new data.
    """

    skip = param("skip", "do not apply to new data", TypeConverters.toBoolean)
    stageId = param("stageId", "name of the stage", TypeConverters.toString)
    batchSizeInference = param("batchSizeInference", "rows of one forward pass, 0: an Arrow batch", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        terms=(all_numeric(),),
        keyCols=(),
        createValidation=False,
        validationProportion=0.1,
        batchSize=256,
        epochs=150,
        skip=False,
        stageId=None,
        seed=0,
        numShards=None,
        hidden=256,
        depth=4,
        projectionDepth=2,
        learningRate=1e-4,
        prefix="extracted_dim_",
        batchSizeInference=0,
        localSteps=None,
        corruptionRate=None,
        temperature=None,
        maxLevels=None,
    ):
        own = ("skip", "stageId", "batchSizeInference")
        given = {k: v for k, v in self._input_kwargs.items() if k not in own}
        given = {"terms": terms, "epochs": epochs, **given}
        super().__init__(**given, preprocess=False, wide=True)
        self._setDefault(skip=False, stageId=f"extract_latent_{uuid.uuid4().hex[:5]}", batchSizeInference=0)
        self._set(batchSizeInference=batchSizeInference)
        self._set(**{k: v for k, v in {"skip": skip or None, "stageId": stageId}.items() if v is not None})

    def __repr__(self):
        return describe(self.getOrDefault("terms"), False)

    def tidy(self, spark: SparkSession) -> DataFrame:
        """The selected terms as declared, with the stage's id."""
        return tidy(spark, self.getOrDefault("terms"), self.getOrDefault("stageId"))

    def _fit(self, dataset):
        terms = resolve(dataset.schema, self.getOrDefault("terms"))
        encoder = super()._fit(dataset).set_output(batchSizeInference=self.getOrDefault("batchSizeInference"))
        model = ExtractLatentModel(encoder, terms)
        return model._set(skip=self.getOrDefault("skip"), stageId=self.getOrDefault("stageId"))


class ExtractLatentModel(Model, Stored):
    kind = "latent extraction stage"

    skip = param("skip", "do not apply to new data", TypeConverters.toBoolean)
    stageId = param("stageId", "name of the stage", TypeConverters.toString)

    def __init__(self, encoder: ContrastiveEncoderModel, columns, fitting: bool = True):
        super().__init__()
        self._setDefault(skip=False)
        self.encoder, self.columns, self.fitting = encoder, list(columns), fitting

    def __repr__(self):
        return describe(self.columns, True)

    def tidy(self, spark: SparkSession) -> DataFrame:
        """The columns the stage was fitted on, with its id."""
        return tidy(spark, self.columns, self.getOrDefault("stageId"))

    def _transform(self, dataset):
        if self.getOrDefault("skip") and not self.fitting:
            return dataset
        return self.encoder.transform(dataset)

    def _content(self):
        return {"columns": self.columns}

    def _save_parts(self, path, spark):
        self.encoder.save(f"{path}/encoder")

    @classmethod
    def _from_parts(cls, content, path, spark):
        encoder = ContrastiveEncoderModel.load(f"{path}/encoder")
        return cls(encoder, content["columns"], fitting=False)


class StagedPipeline(Pipeline):
    """A ``Pipeline`` whose fitted stages know that fitting is over."""

    def _fit(self, dataset):
        model = super()._fit(dataset)
        for stage in model.stages:
            if isinstance(stage, ExtractLatentModel):
                stage.fitting = False
        return model
