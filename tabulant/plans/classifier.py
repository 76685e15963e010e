"""Classification on latent features as a Spark ML Estimator and Model."""

import warnings

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import TypeConverters
from pyspark.sql import functions as F

from tabulant.functions.draws import row_key
from tabulant.functions.vectors import argmax_label
from tabulant.operators import evaluate
from tabulant.operators.neighbours import BLOCK_ROWS, CHUNK_ROWS, PIVOTS
from tabulant.operators.prep import MAX_LEVELS
from tabulant.operators.sampling import stratified_sample
from tabulant.plans.boosting import BINS, DEPTH, ROUNDS, GradientHead
from tabulant.plans.encoder import ContrastiveEncoderModel, keyed, param
from tabulant.plans.forest import ForestHead
from tabulant.plans.heads import (
    FOREST_TREES,
    FOURIER_FEATURES,
    HEADS,
    KINDS,
    MAX_BINS,
    MAX_DEPTH,
    NEIGHBOURS,
    SVM_ITERATIONS,
    KnnHead,
    MlpHead,
    SparkHead,
    SvmHead,
)
from tabulant.plans.rounds import LOCAL_STEPS, SHARDS
from tabulant.plans.tree import LEAST, TreeHead
from tabulant.sources.scratch import discard, materialize
from tabulant.sources.store import Stored

LATENT = "__latent"
SMALL_FRACTION = 0.05


def check_choice(kind, classifier) -> None:
    """``MLP`` first, then a classifier object, then a known name."""
    if kind == "MLP" or classifier is not None:
        return
    if kind is None:
        raise ValueError("choose a classifier: give a kind or a Spark ML classifier")
    if kind not in KINDS:
        raise ValueError(f"classifier {kind!r} is not supported; use one of {KINDS} or a Spark ML classifier")


class LatentClassifier(Estimator):
    """Fit a classifier on the latent rows of an encoder, or on an array column."""

    labelCol = param("labelCol", "column with the class", TypeConverters.toString)
    featuresCol = param("featuresCol", "array column, if there is no encoder", TypeConverters.toString)
    keyCols = param("keyCols", "columns that identify a row", TypeConverters.toListString)
    numClasses = param("numClasses", "expected number of classes", TypeConverters.toInt)
    epochs = param("epochs", "passes over the rows (MLP)", TypeConverters.toInt)
    dropout = param("dropout", "dropout rate (MLP)", TypeConverters.toFloat)
    batchSize = param("batchSize", "rows per batch (MLP)", TypeConverters.toInt)
    numShards = param("numShards", "parallel shards (MLP); unless set, from 4 to 48 by the number of rows", TypeConverters.toInt)
    localSteps = param("localSteps", "most batches between two averages (MLP)", TypeConverters.toInt)
    neighbours = param("neighbours", "k (KNN)", TypeConverters.toInt)
    blockRows = param("blockRows", "training rows per block, more in a large table (KNN)", TypeConverters.toInt)
    chunkRows = param("chunkRows", "queries per chunk, more in a large table (KNN)", TypeConverters.toInt)
    pivots = param("pivots", "cells of training rows (KNN)", TypeConverters.toInt)
    maxDepth = param("maxDepth", "levels of a tree (Random Forest, C50)", TypeConverters.toInt)
    maxBins = param("maxBins", "thresholds tried per feature (trees)", TypeConverters.toInt)
    trees = param("trees", "trees of the forest (Random Forest)", TypeConverters.toInt)
    leastRows = param("leastRows", "rows on either side of a split (C50)", TypeConverters.toInt)
    boostRounds = param("boostRounds", "rounds of boosting (XGB)", TypeConverters.toInt)
    boostBins = param("boostBins", "thresholds tried per feature and one more (XGB)", TypeConverters.toInt)
    boostDepth = param("boostDepth", "levels of a boosted tree (XGB)", TypeConverters.toInt)
    fourierFeatures = param("fourierFeatures", "random features (SVM)", TypeConverters.toInt)
    iterations = param("iterations", "most iterations of a plane (SVM); a warning says if they run out", TypeConverters.toInt)
    maxLevels = param("maxLevels", "most classes", TypeConverters.toInt)
    levels = param("levels", "classes in their order; by default those found, sorted", TypeConverters.toListString)
    small = param("small", "train on 5 percent of every class", TypeConverters.toBoolean)
    seed = param("seed", "seed of every draw", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        encoder=None,
        kind=None,
        classifier=None,
        labelCol=None,
        featuresCol=None,
        keyCols=(),
        numClasses=None,
        epochs=50,
        dropout=0.2,
        batchSize=256,
        numShards=SHARDS,
        localSteps=LOCAL_STEPS,
        neighbours=NEIGHBOURS,
        blockRows=BLOCK_ROWS,
        chunkRows=CHUNK_ROWS,
        pivots=PIVOTS,
        maxDepth=MAX_DEPTH,
        maxBins=MAX_BINS,
        trees=FOREST_TREES,
        leastRows=LEAST,
        boostRounds=ROUNDS,
        boostDepth=DEPTH,
        boostBins=BINS,
        fourierFeatures=FOURIER_FEATURES,
        iterations=SVM_ITERATIONS,
        maxLevels=MAX_LEVELS,
        levels=None,
        small=False,
        seed=0,
    ):
        super().__init__()
        check_choice(kind, classifier)
        if labelCol is None:
            raise ValueError("name the label column")
        if (encoder is None) == (featuresCol is None):
            raise ValueError("give either an encoder or a features column")
        self._setDefault(
            keyCols=[], epochs=50, dropout=0.2, batchSize=256, numShards=SHARDS, localSteps=LOCAL_STEPS,
            neighbours=NEIGHBOURS, blockRows=BLOCK_ROWS, chunkRows=CHUNK_ROWS, pivots=PIVOTS,
            maxDepth=MAX_DEPTH, maxBins=MAX_BINS, trees=FOREST_TREES,
            leastRows=LEAST, boostRounds=ROUNDS, boostDepth=DEPTH, boostBins=BINS, fourierFeatures=FOURIER_FEATURES,
            iterations=SVM_ITERATIONS, maxLevels=MAX_LEVELS, small=False, seed=0,
        )
        given = {k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()}
        self.encoder, self.choice, self.classifier = encoder, kind, classifier
        own = {k: v for k, v in given.items() if k not in ("encoder", "kind", "classifier")}
        self._set(**{k: v for k, v in own.items() if v is not None})

    def _fit(self, dataset):
        get = self.getOrDefault
        spark, label = dataset.sparkSession, get("labelCol")
        df, keys, _ = keyed(dataset, get("keyCols"))
        if get("small"):
            df = stratified_sample(
                df.where(F.col(label).isNotNull()), label, keys, SMALL_FRACTION, get("seed"), get("maxLevels")
            )
        counts, missing = evaluate.label_counts(df, label, get("maxLevels"))
        if missing:
            warnings.warn(f"{missing} rows without a label are left out", stacklevel=2)
            df = df.where(F.col(label).isNotNull())
        levels = list(get("levels")) if self.isSet("levels") else list(counts)
        unknown = set(counts) - set(levels)
        if unknown:
            raise ValueError(f"{label!r} holds {sorted(unknown)[:5]}, which are not among the levels")
        if self.isSet("numClasses") and get("numClasses") != len(levels):
            raise ValueError(f"{get('numClasses')} classes expected, {len(levels)} found in {label!r}")
        if len(levels) < 2:
            raise ValueError(f"{label!r} holds a single class")

        # every head reads the rows several times; an encoder's inputs are stored, many times smaller than the latent rows,
        # which are computed again wherever a head reads them
        rows = df.select(
            row_key(keys).alias("key"),
            evaluate.label_index(F.col(label), levels).alias("label"),
            self.encoder.prepared().alias("inputs") if self.encoder else F.col(get("featuresCol")).alias("latent"),
        )
        rows, path = materialize(rows, "latent")
        if self.encoder:
            rows = rows.select("key", "label", self.encoder.encode_prepared(spark, F.col("inputs")).alias("latent"))
        try:
            head = self._fit_head(rows, len(levels), sum(counts.values()))
        finally:
            discard(spark, path)
        model = LatentClassifierModel(self.encoder, head, levels)
        model._set(labelCol=label)
        if self.isSet("featuresCol"):
            model._set(featuresCol=get("featuresCol"))
        return model

    def _fit_head(self, rows, classes, n):
        get, seed = self.getOrDefault, self.getOrDefault("seed")
        if self.choice == "MLP":
            return MlpHead.fit(
                rows,
                rows.select(F.size("latent")).first()[0],
                classes,
                n,
                epochs=get("epochs"),
                dropout=get("dropout"),
                batch_size=get("batchSize"),
                seed=seed,
                shards=get("numShards") if self.isSet("numShards") else None,
                local_steps=get("localSteps"),
            )
        if self.classifier is not None:
            return SparkHead.fit(self.classifier, rows, classes, seed)
        if self.choice == "Random Forest":
            return ForestHead.fit(rows, classes, trees=get("trees"), depth=get("maxDepth"), bins=min(get("maxBins"), 256), seed=seed)
        if self.choice == "XGB":
            shape = dict(rounds=get("boostRounds"), depth=get("boostDepth"), bins=get("boostBins"))
            return GradientHead.fit(rows, classes, **shape)
        if self.choice == "C50":
            return TreeHead.fit(rows, classes, depth=get("maxDepth"), bins=min(get("maxBins"), 256), least=get("leastRows"))
        if self.choice == "SVM":
            return SvmHead.fit(rows, classes, seed, get("fourierFeatures"), get("iterations"))
        sizes = (get(p) for p in ("blockRows", "chunkRows", "pivots"))
        return KnnHead.fit(rows, classes, get("neighbours"), seed, get("keyCols"), *sizes)


class LatentClassifierModel(Model, Stored):
    """Adds ``prediction`` and ``probability`` (in level order)."""

    kind = "latent classifier"

    labelCol = param("labelCol", "column with the class, only needed to evaluate", TypeConverters.toString)
    featuresCol = param("featuresCol", "array column, if there is no encoder", TypeConverters.toString)

    def __init__(self, encoder: ContrastiveEncoderModel | None, head, levels):
        super().__init__()
        self.encoder, self.head, self.levels = encoder, head, list(levels)

    def _transform(self, dataset):
        for name in ("prediction", "probability"):
            if name in dataset.columns:
                raise ValueError(f"the table already has a column {name!r}")
        if self.encoder is not None:
            latent = self.encoder.encode(dataset.sparkSession)
        else:
            latent = F.col(self.getOrDefault("featuresCol"))
        if isinstance(self.head, KnnHead):
            rows, keys, _ = keyed(dataset, self.head.key_cols)
            scored = self.head.score(rows.withColumn(LATENT, latent), LATENT, keys)
        else:
            scored = self.head.score(dataset.withColumn(LATENT, latent), LATENT)
        return scored.select(
            *dataset.columns,
            argmax_label(F.col("probability"), self.levels).alias("prediction"),
            "probability",
        )

    def confusion_matrix(self, predictions):
        return evaluate.confusion_matrix(predictions, "prediction", self.getOrDefault("labelCol"), self.levels)

    def accuracy(self, predictions):
        return evaluate.accuracy(predictions, "prediction", self.getOrDefault("labelCol"), self.levels)

    def classification_report(self, predictions):
        return evaluate.classification_report(
            predictions, "prediction", self.getOrDefault("labelCol"), self.levels
        )

    def _content(self):
        return {"levels": self.levels, "head": self.head.content(), "encoder": self.encoder is not None}

    def _save_parts(self, path, spark):
        self.head.save(f"{path}/head", spark)
        if self.encoder is not None:
            self.encoder.save(f"{path}/encoder")

    @classmethod
    def _from_parts(cls, content, path, spark):
        head = HEADS[content["head"]["head"]].load(content["head"], f"{path}/head", spark)
        encoder = ContrastiveEncoderModel.load(f"{path}/encoder") if content["encoder"] else None
        return cls(encoder, head, content["levels"])
