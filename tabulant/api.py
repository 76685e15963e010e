"""The four entry points as plain functions over DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.plans.classifier import LatentClassifier, LatentClassifierModel, check_choice
from tabulant.plans.encoder import ContrastiveEncoder, ContrastiveEncoderModel


def check_objective(pretraining_type: str) -> None:
    if pretraining_type.upper() != "SCARF":
        raise ValueError(f"pretraining type {pretraining_type!r} is not supported; use 'SCARF'")


def as_encoder(model) -> ContrastiveEncoderModel:
    """A fitted encoder given as a model or as the path of a saved one."""
    if isinstance(model, str):
        return ContrastiveEncoderModel.load(model)
    if isinstance(model, ContrastiveEncoderModel):
        return model
    raise TypeError("expected a fitted encoder or the path of a saved one")


def as_classifier(model) -> LatentClassifierModel:
    if isinstance(model, str):
        return LatentClassifierModel.load(model)
    if isinstance(model, LatentClassifierModel):
        return model
    raise TypeError("expected a fitted classifier or the path of a saved one")


def check_excluded(encoder: ContrastiveEncoderModel, exclude_columns) -> None:
    """The encoder reads its own columns only, so excluding others needs no work."""
    clash = set(exclude_columns or ()) & set(encoder.prep.input_columns)
    if clash:
        raise ValueError(f"the encoder was trained on {sorted(clash)}, which cannot be excluded")


def fit_extractor(
    dataframe_train: DataFrame,
    pretraining_type: str = "SCARF",
    exclude_columns=None,
    create_validation: bool = False,
    validation_proportion: float = 0.1,
    batch_size: int = 256,
    n_epochs: int = 1,
    save_path: str | None = None,
    preprocess: bool = True,
    key_columns=None,
    seed: int = 0,
    **options,
) -> ContrastiveEncoderModel:
    """Train an encoder; ``save_path`` also stores it.  ``options`` go to ContrastiveEncoder."""
    check_objective(pretraining_type)
    model = ContrastiveEncoder(
        exclude=list(exclude_columns or []),
        createValidation=create_validation,
        validationProportion=validation_proportion,
        batchSize=batch_size,
        epochs=n_epochs,
        preprocess=preprocess,
        keyCols=list(key_columns or []),
        seed=seed,
        **options,
    ).fit(dataframe_train)
    if save_path is not None:
        model.save(save_path)
    return model


def extract_features(
    dataframe: DataFrame,
    pretrained_model,
    pretraining_type: str = "SCARF",
    exclude_columns=None,
    want_labels: bool = False,
    label_column: str | None = None,
    batch_size: int | None = None,
    preprocess: bool = True,
    key_columns=None,
) -> DataFrame:
    """The ``latent`` column of every row, with its key and label columns next to it.

    ``batch_size`` bounds the rows of one forward pass (None: an Arrow batch); it changes no result.  Without
    ``preprocess`` the encoder's own preparation is left out: the columns of the table that are neither excluded, key nor
    label are the inputs, in their order, and there must be as many as the encoder was trained on.
    """
    if want_labels and label_column is None:
        raise ValueError("labels are wanted, so name the label column")
    check_objective(pretraining_type)
    encoder = as_encoder(pretrained_model)
    kept = [*(key_columns or ()), *([label_column] if want_labels else [])]
    if preprocess:
        check_excluded(encoder, exclude_columns)
        inputs = None
    else:
        away = {*(exclude_columns or ()), *kept, *([label_column] if label_column else [])}
        inputs = [c for c in dataframe.columns if c not in away]
    latent = encoder.encode(dataframe.sparkSession, batch_size, inputs)
    return dataframe.select(*kept, latent.alias(encoder.getOrDefault("outputCol")))


def train_classifier_on_extracted_features(
    df_train: DataFrame,
    pretrained_model,
    pretraining_type: str = "SCARF",
    label_column: str | None = None,
    num_classes: int | None = None,
    exclude_columns=None,
    classifier=None,
    classification_model_type: str | None = None,
    n_epochs: int = 50,
    dropout: float = 0.2,
    doitsmall: bool = False,
    save_path: str | None = None,
    key_columns=None,
    seed: int = 0,
    **options,
) -> LatentClassifierModel:
    """Fit a head on the latent rows of ``df_train``; ``save_path`` also stores it."""
    check_choice(classification_model_type, classifier)
    check_objective(pretraining_type)
    encoder = as_encoder(pretrained_model)
    check_excluded(encoder, exclude_columns)
    model = LatentClassifier(
        encoder=encoder,
        kind=classification_model_type,
        classifier=classifier,
        labelCol=label_column,
        numClasses=num_classes,
        epochs=n_epochs,
        dropout=dropout,
        small=doitsmall,
        keyCols=list(key_columns or []),
        seed=seed,
        **options,
    ).fit(df_train)
    if save_path is not None:
        model.save(save_path)
    return model


def downstream_prediction(
    df_test: DataFrame,
    pretrained_model=None,
    pretraining_type: str = "SCARF",
    label_column: str | None = None,
    classification_model=None,
    exclude_columns=None,
    return_classification_report: bool = False,
):
    """Predictions and probabilities, and on request the report as a second DataFrame.

    The classifier brings its encoder; ``pretrained_model`` replaces it in this call only, the model that
    was passed stays as it is.  ``label_column`` names the true class in ``df_test`` if its name differs
    from the one trained on; it is only needed for the report.
    """
    check_objective(pretraining_type)
    model = as_classifier(classification_model).copy()
    if pretrained_model is not None:
        model.encoder = as_encoder(pretrained_model)
    if model.encoder is not None:
        check_excluded(model.encoder, exclude_columns)
    if label_column is not None:
        model._set(labelCol=label_column)
    if return_classification_report and model.getOrDefault("labelCol") not in df_test.columns:
        raise ValueError(f"the table has no column {model.getOrDefault('labelCol')!r} to report on")
    predictions = model.transform(df_test)
    if return_classification_report:
        return predictions, model.classification_report(predictions)
    return predictions


def probability_columns(predictions: DataFrame, levels, prefix: str = "prob_") -> DataFrame:
    """One column per class instead of the probability array."""
    rest = [c for c in predictions.columns if c != "probability"]
    return predictions.select(
        *rest, *[F.col("probability")[i].alias(f"{prefix}{v}") for i, v in enumerate(levels)]
    )
