"""The contrastive encoder as a Spark ML Estimator and Model."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.functions.draws import row_key
from tabulant.operators.contrast import TEMPERATURE
from tabulant.operators.prep import MAX_LEVELS, UNKNOWN, TabularPrep, TabularPrepModel
from tabulant.operators.sampling import assign_batches, validation_split, with_row_key
from tabulant.operators.views import RATE
from tabulant.plans.network import Contrastive, Net, dense_stack, lists_of, named_views, rows_of
from tabulant.plans.rounds import LOCAL_STEPS, SHARDS, train
from tabulant.sources.scratch import discard, materialize
from tabulant.sources.store import Stored, load_weights, save_weights

LEARNING_RATE = 1e-4
PASS_ROWS = 512  # rows of one forward pass unless the caller says otherwise: its layers stay in the processor's cache


def param(name: str, doc: str, convert=None):
    return Param(Params._dummy(), name, doc, convert)


def encoder_layers(in_dim: int, hidden: int = 256, depth: int = 4, dropout: float = 0.0):
    return dense_stack("encoder", in_dim, hidden, depth, dropout)


def projection_layers(in_dim: int, hidden: int = 256, depth: int = 2, dropout: float = 0.0):
    return dense_stack("projection", in_dim, hidden, depth, dropout)


def forward_udf(spark, layers, weights: dict, precision: str = "float", link=None, batch_size: int = 0):
    """Evaluation-mode forward as an Arrow UDF from a feature array to an array.

    ``batch_size`` bounds the rows of one pass; 0 takes ``PASS_ROWS``.  Only the feature column crosses to Python; the other columns, column pruning and
    filters stay with Catalyst.
    """
    dtype = np.float32 if precision == "float" else np.float64
    shared = spark.sparkContext.broadcast({k: v.astype(dtype) for k, v in weights.items()})
    net = Net(layers)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        for batch in batches:
            if len(batch) == 0:
                yield pa.array([], pa.list_(pa.from_numpy_dtype(dtype)))
                continue
            x, outs = rows_of(batch, dtype), None
            size = batch_size or PASS_ROWS
            for low in range(0, len(x), size):
                out, _ = net.forward(weights, weights, x[low : low + size])
                out = out if link is None else link(out)
                if outs is None:
                    outs = np.empty((len(x), out.shape[1]), out.dtype)
                outs[low : low + size] = out
            yield lists_of(outs)

    element = T.FloatType() if precision == "float" else T.DoubleType()
    return F.arrow_udf(score, returnType=T.ArrayType(element))


def keyed(df: DataFrame, key_cols) -> tuple[DataFrame, list[str], list[str]]:
    """The table, its key columns and the columns to leave out of the features."""
    if key_cols:
        return df, list(key_cols), []
    return with_row_key(df, "__row_key"), ["__row_key"], ["__row_key"]


class ContrastiveEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Train an encoder whose latent rows agree with those of their corrupted views."""

    exclude = param("exclude", "columns that are not features", TypeConverters.toListString)
    terms = param("terms", "feature columns or selectors", TypeConverters.toListString)
    keyCols = param("keyCols", "columns that identify a row", TypeConverters.toListString)
    preprocess = param("preprocess", "fit and apply prep", TypeConverters.toBoolean)
    nullPolicy = param("nullPolicy", "error or impute_median", TypeConverters.toString)
    unknown = param("unknown", "name of the unseen level", TypeConverters.toString)
    maxLevels = param("maxLevels", "levels allowed per column", TypeConverters.toInt)
    createValidation = param("createValidation", "hold out rows", TypeConverters.toBoolean)
    validationProportion = param("validationProportion", "share held out", TypeConverters.toFloat)
    batchSize = param("batchSize", "rows per training batch", TypeConverters.toInt)
    epochs = param("epochs", "passes over the rows", TypeConverters.toInt)
    hidden = param("hidden", "width of encoder and projection", TypeConverters.toInt)
    depth = param("depth", "linear layers of the encoder", TypeConverters.toInt)
    projectionDepth = param("projectionDepth", "linear layers of the projection", TypeConverters.toInt)
    dropout = param("dropout", "dropout rate", TypeConverters.toFloat)
    learningRate = param("learningRate", "Adam step size", TypeConverters.toFloat)
    corruptionRate = param("corruptionRate", "share of cells replaced", TypeConverters.toFloat)
    temperature = param("temperature", "NT-Xent temperature", TypeConverters.toFloat)
    seed = param("seed", "seed of every draw", TypeConverters.toInt)
    numShards = param("numShards", "parallel shards; unless set, from 4 to 48 by the number of rows", TypeConverters.toInt)
    localSteps = param("localSteps", "most batches between two averages", TypeConverters.toInt)
    wide = param("wide", "replace inputs by extracted_dim_1..H", TypeConverters.toBoolean)
    prefix = param("prefix", "prefix of the wide columns", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        exclude=(),
        terms=None,
        keyCols=(),
        preprocess=True,
        nullPolicy="error",
        unknown=UNKNOWN,
        maxLevels=MAX_LEVELS,
        createValidation=False,
        validationProportion=0.1,
        batchSize=256,
        epochs=1,
        hidden=256,
        depth=4,
        projectionDepth=2,
        dropout=0.0,
        learningRate=LEARNING_RATE,
        corruptionRate=RATE,
        temperature=TEMPERATURE,
        seed=0,
        numShards=SHARDS,
        localSteps=LOCAL_STEPS,
        wide=False,
        prefix="extracted_dim_",
    ):
        super().__init__()
        defaults = dict(
            exclude=[], keyCols=[], preprocess=True, nullPolicy="error", unknown=UNKNOWN, maxLevels=MAX_LEVELS,
            createValidation=False, validationProportion=0.1, batchSize=256, epochs=1,
            hidden=256, depth=4, projectionDepth=2, dropout=0.0, learningRate=LEARNING_RATE,
            corruptionRate=RATE, temperature=TEMPERATURE, seed=0, numShards=SHARDS, localSteps=LOCAL_STEPS,
            wide=False, prefix="extracted_dim_",
        )
        self._setDefault(**defaults)
        given = {k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _fit(self, dataset):
        get = self.getOrDefault
        df, keys, derived = keyed(dataset, get("keyCols"))
        train_df, valid_df = df, None
        if get("createValidation"):
            train_df, valid_df = validation_split(df, get("validationProportion"), keys, get("seed"))
        prep = TabularPrep(
            exclude=[*get("exclude"), *derived],
            terms=get("terms") if self.isSet("terms") else None,
            preprocess=get("preprocess"),
            nullPolicy=get("nullPolicy"),
            unknown=get("unknown"),
            maxLevels=get("maxLevels"),
        ).fit(train_df)

        layers = encoder_layers(prep.width, get("hidden"), get("depth"), get("dropout"))
        projection = projection_layers(get("hidden"), get("hidden"), get("projectionDepth"), get("dropout"))
        objective = Contrastive(
            [*layers, *projection], get("learningRate"), get("corruptionRate"), get("temperature")
        )
        ready = lambda rows: rows.select(row_key(keys).alias("key"), prep.vector().alias("features"))
        n = prep.rows_seen
        if n is None:
            n = train_df.count()
        if n < 2:
            raise ValueError("training needs at least two rows")
        valid, path = None, None
        try:
            if valid_df is not None:
                batched = assign_batches(ready(valid_df), ["key"], get("batchSize"), get("seed"))
                valid, path = materialize(batched, "validation") if get("epochs") > 1 else (batched, None)

            def after_epoch(state, epoch):
                if valid is None:
                    return {}
                row = validation_loss(valid, objective, state, get("seed"), epoch).first()
                return {"valid_rows": row["rows"], "valid_loss": row["loss"]}

            state, history = train(
                ready(train_df),
                objective,
                n=n,
                epochs=get("epochs"),
                batch_size=get("batchSize"),
                seed=get("seed"),
                shards=get("numShards") if self.isSet("numShards") else None,
                local_steps=get("localSteps"),
                after_epoch=after_epoch,
            )
        finally:
            discard(dataset.sparkSession, path)
        shape = {k: get(k) for k in ("hidden", "depth", "dropout")}
        shape["in_dim"] = prep.width
        # the projection has served its purpose; only the encoder is kept
        model = ContrastiveEncoderModel(prep, shape, objective.net.export(state, "encoder"), history)
        model._set(wide=get("wide"), prefix=get("prefix"))
        return model


def validation_loss(batched: DataFrame, objective, state, seed: int, epoch: int) -> DataFrame:
    """Mean NT-Xent over held-out batches, evaluation mode, one row."""
    shared = batched.sparkSession.sparkContext.broadcast(state)

    def measure(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        net = objective.net
        params = named_views(shared.value["theta"], net.shapes)
        stats = named_views(shared.value["stats"], net.buffers)
        rng = np.random.Generator(
            np.random.Philox(np.random.SeedSequence([seed, epoch, table["batch"][0].as_py()]))
        )
        x = rows_of(table["features"], np.float32)
        loss = objective.evaluate(params, stats, x, rng)
        return pa.table({"rows": pa.array([len(x)], pa.int64()), "loss": [float(loss.mean())]})

    losses = (
        batched.select("batch", "pos", "features")
        .groupBy("batch")
        .applyInArrow(measure, "rows bigint, loss double")
    )
    return losses.agg(
        F.sum("rows").alias("rows"), (F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("loss")
    )


class ContrastiveEncoderModel(Model, Stored):
    """Adds ``latent`` (or wide columns) to any DataFrame with the training columns."""

    kind = "contrastive encoder"

    outputCol = param("outputCol", "name of the latent column", TypeConverters.toString)
    wide = param("wide", "replace inputs by one column per dimension", TypeConverters.toBoolean)
    prefix = param("prefix", "prefix of the wide columns", TypeConverters.toString)
    precision = param("precision", "float or double", TypeConverters.toString)
    batchSizeInference = param("batchSizeInference", "rows of one forward pass, 0: PASS_ROWS", TypeConverters.toInt)

    def __init__(self, prep: TabularPrepModel, shape: dict, weights: dict, history=()):
        super().__init__()
        self._setDefault(outputCol="latent", wide=False, prefix="extracted_dim_", precision="float", batchSizeInference=0)
        self.prep, self.shape, self.weights, self.history = prep, shape, weights, list(history)

    def set_output(self, **params) -> "ContrastiveEncoderModel":
        """A copy with other output settings: outputCol, wide, prefix, precision, batchSizeInference."""
        return self.copy()._set(**params)

    @property
    def layers(self):
        return encoder_layers(**self.shape)

    @property
    def param_count(self) -> int:
        """Trainable parameters; running statistics are not counted."""
        return sum(int(np.prod(s)) for s in Net(self.layers).shapes.values())

    def encode(self, spark, batch_size=None, inputs=None):
        """The latent array as an expression over the input columns.

        ``batch_size`` bounds the rows of one forward pass.  ``inputs`` names columns that are prepared already
        and replace the fitted preparation.
        """
        score = self._score(spark, batch_size)
        if inputs is None:
            return score(self.prep.vector())
        if len(inputs) != self.shape["in_dim"]:
            raise ValueError(f"the encoder takes {self.shape['in_dim']} columns, not {len(inputs)}: {list(inputs)}")
        return score(F.array(*[F.col(c).cast("double") for c in inputs]))

    def _score(self, spark, batch_size=None):
        given = self.getOrDefault("batchSizeInference") if batch_size is None else batch_size
        return forward_udf(spark, self.layers, self.weights, self.getOrDefault("precision"), batch_size=given)

    def prepared(self):
        """The encoder's input, an expression over the input columns in the precision of a forward pass."""
        return self.prep.vector().cast(f"array<{self.getOrDefault('precision')}>")

    def encode_prepared(self, spark, column):
        """The latent array of ``prepared`` rows."""
        return self._score(spark)(column)

    def _transform(self, dataset):
        name = self.getOrDefault("outputCol")
        latent = self.encode(dataset.sparkSession).alias(name)
        if not self.getOrDefault("wide"):
            if name in dataset.columns:
                raise ValueError(f"the table already has a column {name!r}")
            return dataset.select("*", latent)
        rest = [c for c in dataset.columns if c not in self.prep.input_columns]
        dims = [f"{self.getOrDefault('prefix')}{i + 1}" for i in range(self.shape["hidden"])]
        if set(rest) & set(dims):
            raise ValueError("the table already has extracted columns; choose another prefix")
        return dataset.select(*rest, latent.alias("__latent")).select(
            *rest, *[F.col("__latent")[i].alias(d) for i, d in enumerate(dims)]
        )

    def _content(self):
        return {"shape": self.shape, "prep": self.prep.fitted, "history": self.history}

    def _save_parts(self, path, spark):
        save_weights(spark, self.weights, f"{path}/weights")

    @classmethod
    def _from_parts(cls, content, path, spark):
        weights = load_weights(spark, f"{path}/weights")
        return cls(TabularPrepModel(content["prep"]), content["shape"], weights, content["history"])
