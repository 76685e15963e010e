"""Self-supervised representation learning on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors receive the few NumPy helpers inside the pickled tasks, so the
# package need not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tabulant.api import (  # noqa: E402
    downstream_prediction,
    extract_features,
    fit_extractor,
    train_classifier_on_extracted_features,
)
from tabulant.plans.classifier import LatentClassifier, LatentClassifierModel  # noqa: E402
from tabulant.plans.encoder import ContrastiveEncoder, ContrastiveEncoderModel  # noqa: E402
from tabulant.plans.stage import ExtractLatent, ExtractLatentModel, StagedPipeline  # noqa: E402

__all__ = [
    "ContrastiveEncoder",
    "ContrastiveEncoderModel",
    "ExtractLatent",
    "ExtractLatentModel",
    "LatentClassifier",
    "LatentClassifierModel",
    "StagedPipeline",
    "downstream_prediction",
    "extract_features",
    "fit_extractor",
    "train_classifier_on_extracted_features",
]
