"""Label encoding and evaluation of predictions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.operators.prep import MAX_LEVELS
from tabulant.sources.scratch import materialize


def label_counts(df: DataFrame, label: str, max_levels: int = MAX_LEVELS) -> tuple[dict[str, int], int]:
    """Rows per label in the labels' native order, as strings, and rows without a label."""
    names = df.select(label, F.col(label).cast("string").alias("__level"))
    found = names.groupBy(label, "__level").agg(F.count(F.lit(1)).alias("__n")).limit(max_levels + 2).collect()
    known = [row for row in found if row[label] is not None]
    if len(known) > max_levels:
        raise ValueError(f"{label!r} has more than {max_levels} classes")
    if not known:
        raise ValueError(f"{label!r} holds no labels")
    levels = {row["__level"]: row["__n"] for row in sorted(known, key=lambda row: row[label])}
    return levels, sum(row["__n"] for row in found if row[label] is None)


def label_levels(df: DataFrame, label: str, max_levels: int = MAX_LEVELS) -> list[str]:
    """Distinct labels in their native order, as strings; null is no level."""
    return list(label_counts(df, label, max_levels)[0])


def label_index(label: Column, levels) -> Column:
    """Position of a label in the training levels, from 0; unseen labels become null."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), label.cast("string"))
    return F.when(place > 0, (place - 1).cast("int"))


def confusion_matrix(df: DataFrame, predicted: str, real: str, levels) -> DataFrame:
    """``(predicted, real, n)`` for every pair of levels, zeros included.

    Rows whose true label is not a training level drop out: they are counted under -1, which is no
    cell of the grid.  A filter instead would be pushed below the prediction and evaluate it
    twice.  The rows are counted by a partial aggregate; the grid has one row per pair of levels.
    """
    names = F.array(*[F.lit(v) for v in levels])
    k = len(levels)
    cell = label_index(F.col(predicted), levels) * k + label_index(F.col(real), levels)
    counts = df.select(F.coalesce(cell.cast("bigint"), F.lit(-1)).alias("id")).groupBy("id").count()
    grid = df.sparkSession.range(k * k).join(counts, "id", "left")
    return grid.select(
        F.get(names, F.expr(f"cast(id div {k} as int)")).alias("predicted"),
        F.get(names, F.expr(f"cast(id % {k} as int)")).alias("real"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("n"),
    )


def accuracy(df: DataFrame, predicted: str, real: str, levels) -> DataFrame:
    """Rows with a known true label, hits among them and the accuracy in percent."""
    truth = label_index(F.col(real), levels)
    hit = (label_index(F.col(predicted), levels) == truth).cast("bigint")
    counted = df.where(truth.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    return counted.select(
        "n",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.round(F.try_divide("hits", "n") * 100, 2).alias("accuracy"),
    )


def classification_report(df: DataFrame, predicted: str, real: str, levels) -> DataFrame:
    """The confusion matrix with the overall accuracy (percent) on every row.

    Runs the predictions once and stores the matrix, one row per pair of levels, because it is read
    twice: for its cells and for the accuracy.
    """
    matrix, _ = materialize(confusion_matrix(df, predicted, real, levels), "confusion")
    hits = F.sum(F.expr("if(predicted = real, n, 0)"))
    share = F.try_divide(hits, F.sum("n")) * 100
    whole = matrix.agg(F.round(share, 2).alias("accuracy"))  # one row
    return matrix.join(F.broadcast(whole))
