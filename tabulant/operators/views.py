"""Corrupted views: random cells replaced by values of other rows of the batch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions.draws import chance, row_key, word
from tabulant.functions.vectors import bind

RATE = 0.6
KEY = "__key"


def row_prefix(key: Column, seed: int, epoch: int) -> Column:
    return F.concat(F.lit(f"{seed}:cell:{epoch}:"), key, F.lit(":"))


def cell_digest(prefix: Column, feature: Column) -> Column:
    return F.md5(F.concat(prefix, feature.cast("string")))


def corruption_mask(df: DataFrame, key_cols, rate: float = RATE, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add ``mask array<boolean>``: each cell of ``features`` is hit with probability ``rate``."""

    def mask(prefix: Column) -> Column:
        return F.transform("features", lambda _, j: chance(cell_digest(prefix, j), rate))

    return df.select("*", bind(row_prefix(row_key(key_cols), seed, epoch), mask).alias("mask"))


def corrupt(batched: DataFrame, key_cols, rate: float = RATE, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add ``corrupted``: ``features`` with the masked cells taken from donors.

    The donor of a cell is drawn uniformly from the rows of the same ``batch`` (its own
    row included).  A batch is bounded, so its rows are gathered once and the donors
    read from there; the cells are never exploded or joined.
    """
    carried = [c for c in batched.columns if c not in ("batch", "pos", "features")]
    # the key is spelled before the gather, like that of the mask
    member = F.struct("pos", "features", *carried, row_key(key_cols).alias(KEY))
    batches = batched.groupBy("batch").agg(F.sort_array(F.collect_list(member)).alias("rows"))
    rows = F.col("rows")

    def view(row: Column) -> Column:
        def cells(prefix: Column) -> Column:
            return F.transform(row["features"], lambda x, j: bind(cell_digest(prefix, j), lambda d: cell(d, x, j)))

        def cell(drawn: Column, value: Column, j: Column) -> Column:
            donor = F.get(rows, (word(drawn, 1) % F.size(rows)).cast("int"))
            return F.when(chance(drawn, rate), F.get(donor["features"], j)).otherwise(value)

        corrupted = bind(row_prefix(row[KEY], seed, epoch), cells)
        fields = [row[c].alias(c) for c in ("pos", "features", *carried)]
        return F.struct(*fields, corrupted.alias("corrupted"))

    return batches.select("batch", F.inline(F.transform(rows, view)))
