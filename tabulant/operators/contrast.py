"""NT-Xent over the two views of every row, batch by batch.

A batch is bounded by its size, so its similarity matrix is one matrix product in the
task that holds the batch; only per-row results leave it, never pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.plans.network import nt_xent, rows_of

TEMPERATURE = 0.5


def batch_similarity(
    pairs: DataFrame, key: str, left: str, right: str, temperature: float = TEMPERATURE
) -> DataFrame:
    """Two rows per input row (``view`` 0 and 1), compared with all others of its batch.

    ``positive`` is the cosine / temperature with the row's other view, ``nearest`` and
    ``average`` are taken over all vectors but itself, ``loss`` is the NT-Xent term.
    """
    schema = T.StructType(
        [
            T.StructField("batch", pairs.schema["batch"].dataType),
            T.StructField(key, pairs.schema[key].dataType),
            T.StructField("view", T.IntegerType()),
            T.StructField("positive", T.DoubleType()),
            T.StructField("nearest", T.DoubleType()),
            T.StructField("average", T.DoubleType()),
            T.StructField("loss", T.DoubleType()),
        ]
    )

    def compare(table: pa.Table) -> pa.Table:
        z = np.concatenate([rows_of(table[left]), rows_of(table[right])])
        n = table.num_rows
        sims, loss, positive = nt_xent(z, temperature)
        others = np.where(np.isneginf(sims), 0.0, sims)
        twice = lambda column: pa.chunked_array(column.chunks * 2, type=column.type)
        return pa.table(
            {
                "batch": twice(table["batch"]),
                key: twice(table[key]),
                "view": pa.array(np.repeat([0, 1], n), pa.int32()),
                "positive": positive,
                "nearest": sims.max(axis=1),
                "average": others.sum(axis=1) / (2 * n - 1),
                "loss": loss,
            }
        )

    return pairs.select("batch", key, left, right).groupBy("batch").applyInArrow(compare, schema)


def nt_xent_loss(
    pairs: DataFrame, key: str, left: str, right: str, temperature: float = TEMPERATURE
) -> DataFrame:
    """Mean loss per batch."""
    rows = batch_similarity(pairs, key, left, right, temperature)
    return rows.groupBy("batch").agg(F.avg("loss").alias("loss"), F.count("*").alias("views"))
