"""Exact samples, splits and batches by the rank of a seeded hash.

A row's rank is its place when all rows are sorted by (hash, key).  A histogram over
the first four hex digits of the hash (at most 65,536 counts) finds the hash range that
holds a wanted rank; only the keys of that range are counted and sorted, and yield the exact cut.
A sample is then a plain filter against the cut: one scan, no shuffle of the table, and
no operator ranks a whole table, or a whole class, in one task.

Keys may repeat.  If the cut falls among rows of one key, these are cut again, by a digest of the whole row that
stands for the key; and if it falls among rows that are equal in every column, they are counted and the wanted number
of copies is made on each side.  ``with_row_key`` derives a key for tables that have none.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulant.functions.draws import order, row_key
from tabulant.operators.prep import MAX_LEVELS
from tabulant.sources.scratch import materialize

HASH, RANGE, CLASS, OF = "__hash", "__range", "__class", "__of"
CHUNK = 10_000


def hashed(df: DataFrame, key_cols, *salt) -> DataFrame:
    """Add the 32-bit hash of the key (8 hex digits) and its range (the first 4)."""
    h = order(*salt, row_key(key_cols))
    return df.select("*", h.alias(HASH)).withColumn(RANGE, F.substring(HASH, 1, 4))


def cut_ranges(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per class: the hash range in which the quota is reached and how much it still owes."""
    counts = rows.groupBy(CLASS, RANGE).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(CLASS).orderBy(RANGE)
    placed = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    placed = placed.join(quotas.withColumnRenamed(CLASS, OF), F.col(CLASS).eqNullSafe(F.col(OF)))
    return placed.where("before < quota and quota <= before + n").select(
        OF, F.col(RANGE).alias("cut"), (F.col("quota") - F.col("before")).alias("owed")
    )


def find_cuts(rows: DataFrame, key_cols, quotas: DataFrame) -> DataFrame:
    """Per class of ``rows`` the place at which its quota is reached: ``(OF, at, taken, there)``.

    ``taken`` of the ``there`` rows at the place ``at`` belong to the sample, and all at lower places.  Keys are counted
    before they are ranked, so a key that repeats however often is one row.
    """
    ranges = cut_ranges(rows, quotas)
    edge = rows.join(ranges, F.col(CLASS).eqNullSafe(F.col(OF)) & (F.col(RANGE) == F.col("cut")))
    counted = edge.groupBy(OF, "owed", place(key_cols).alias("at")).agg(F.count(F.lit(1)).alias("there"))
    before = F.sum("there").over(Window.partitionBy(OF).orderBy("at")) - F.col("there")
    reached = counted.withColumn("before", before).where("before < owed and owed <= before + there")
    return reached.select(OF, "at", (F.col("owed") - F.col("before")).alias("taken"), "there")


def place(key_cols) -> Column:
    """What rows are sorted by."""
    return F.struct(F.col(HASH), *[F.col(c) for c in key_cols])


def row_draw(columns) -> Column:
    """A digest of the whole row, alike for equal rows only."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def cut_at(rows: DataFrame, columns, key_cols, quotas: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``held`` (in the sample or not), and how many copies of rows that a cut divides go to either side.

    ``rows`` has ``columns`` and ``CLASS``, ``HASH`` and ``RANGE``; ``quotas`` one row per class.  Rows that equal each
    other and straddle a cut are not among the first table: the second has them once, with the numbers ``inside`` and
    ``outside``.  At most ``limit`` classes are broadcast, more are joined by shuffling.
    """
    spark = rows.sparkSession
    keys = rows.select(CLASS, HASH, RANGE, *key_cols)
    cuts, _ = materialize(find_cuts(keys, key_cols, quotas), "cuts")
    same = F.col(CLASS).eqNullSafe(F.col(OF))

    def with_cuts(found):
        # one row per class
        small = limit is not None and found.limit(limit + 1).count() <= limit
        return rows.join(F.broadcast(found) if small else found, same, "left")

    within = place(key_cols) == F.col("at")
    below = F.coalesce(place(key_cols) < F.col("at"), F.lit(False))
    divided = cuts.where("taken < there")
    if divided.isEmpty():
        joined = with_cuts(cuts).withColumn("held", below | F.coalesce(within, F.lit(False)))
        return joined.select(*columns, "held"), spark.createDataFrame([], rows.select(*columns).schema).limit(0)
    # rows of one key: cut again by their digests
    again = rows.join(divided, same & (place(key_cols) == F.col("at"))).select(OF, "taken", *columns)
    again = again.select(F.col(OF).alias(CLASS), "taken", row_draw(columns).alias(HASH)).withColumn(RANGE, F.substring(HASH, 1, 4))
    owed = divided.select(F.col(OF).alias(CLASS), F.col("taken").alias("quota"))
    finer = find_cuts(again, [], owed).select(F.col(OF), F.col(f"at.{HASH}").alias("draw_at"), F.col("taken").alias("draw_taken"), F.col("there").alias("draw_there"))
    cuts = cuts.withColumnRenamed(OF, "of_").join(finer, F.col("of_").eqNullSafe(F.col(OF)), "left").drop(OF).withColumnRenamed("of_", OF)
    cuts, _ = materialize(cuts, "cuts")
    joined = with_cuts(cuts).withColumn("draw", F.when(F.coalesce(within & F.col("draw_at").isNotNull(), F.lit(False)), row_draw(columns)))
    finer_held = F.when(F.col("draw").isNull(), within).otherwise(F.col("draw") <= F.col("draw_at"))
    straddles = F.coalesce((F.col("draw") == F.col("draw_at")) & (F.col("draw_taken") < F.col("draw_there")), F.lit(False))
    joined = joined.withColumn("held", below | F.coalesce(finer_held, F.lit(False)))
    copies = joined.where(straddles).groupBy(*columns, "draw_taken").agg(F.count(F.lit(1)).alias("there"))
    copies = copies.select(*columns, F.col("draw_taken").alias("inside"), (F.col("there") - F.col("draw_taken")).alias("outside"))
    return joined.where(~straddles).select(*columns, "held"), copies


def repeated(rows: DataFrame, columns, times: str) -> DataFrame:
    """Each row as often as ``times`` says, in chunks, so that no row is expanded in one place."""
    if times not in rows.columns:
        return rows
    chunks = rows.where(F.col(times) > 0).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.expr(f"({times} - 1) div {CHUNK}"))))
    left = F.least(F.lit(CHUNK), F.col(times) - F.col("__chunk") * CHUNK)
    return chunks.repartition("__chunk", *columns).select(*columns, F.explode(F.sequence(F.lit(1), left.cast("int")))).drop("col")


def validation_split(
    df: DataFrame, proportion: float, key_cols, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) with exactly ``floor(proportion * n)`` validation rows, whether keys repeat or not.

    Two small jobs over the key columns find the cut; both sides are filters.
    """
    rows = hashed(df, key_cols, seed, "split").withColumn(CLASS, F.lit(0))
    total = df.count()
    quota = math.floor(total * float(proportion))
    if not 0 < quota < total:
        raise ValueError(f"a split at {proportion} leaves one side empty")
    quotas = df.sparkSession.range(1).select(F.lit(0).alias(CLASS), F.lit(quota).cast("bigint").alias("quota"))
    dealt, copies = cut_at(rows, df.columns, key_cols, quotas, 1)
    sides = []
    for held, times in ((~F.col("held"), "outside"), (F.col("held"), "inside")):
        side = dealt.where(held).select(*df.columns)
        sides.append(side.union(repeated(copies, df.columns, times)) if times in copies.columns else side)
    return tuple(sides)


def stratified_sample(
    df: DataFrame, label: str, key_cols, fraction: float = 0.05, seed: int = 0, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """``round(fraction * n)`` rows of every class, ties to even, as in a grouped sample; keys may repeat.

    Only the keys of one hash range per class are ranked, so a class that holds most of the table costs no more than
    the others.  The cuts are a table of one row per class, broadcast up to ``max_levels`` classes.
    """
    rows = hashed(df, key_cols, seed, "stratum").withColumn(CLASS, F.col(label))
    quota = F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("bigint")
    quotas = rows.groupBy(CLASS).agg(quota.alias("quota"))
    dealt, copies = cut_at(rows, df.columns, key_cols, quotas, max_levels)
    sample = dealt.where("held").select(*df.columns)
    return sample.union(repeated(copies, df.columns, "inside")) if "inside" in copies.columns else sample


def hash_rank(df: DataFrame, key_cols, *salt) -> DataFrame:
    """Add ``rank`` (from 0): the row's place in hash order over the whole table."""
    rows = hashed(df, key_cols, *salt)
    counts = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        F.col(RANGE).alias("__start"),
        (F.sum("n").over(Window.orderBy(RANGE)) - F.col("n")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy(RANGE).orderBy(HASH, *key_cols))
    ranked = rows.withColumn("__within", within)
    # at most 65,536 ranges, so the broadcast is bounded
    joined = ranked.join(F.broadcast(starts), F.col(RANGE) == F.col("__start"))
    return joined.select(*df.columns, (F.col("before") + F.col("__within") - 1).alias("rank"))


def assign_batches(
    df: DataFrame, key_cols, batch_size: int = 256, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """Shuffled mini-batches: adds ``batch`` and ``pos``; only the last batch may be short."""
    ranked = hash_rank(df, key_cols, seed, "batch", epoch)
    return ranked.select(
        *df.columns,
        F.expr(f"rank div {batch_size}").alias("batch"),
        (F.col("rank") % batch_size).cast("int").alias("pos"),
    )


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a key made of the whole row and a copy number.

    Equal rows are counted and expanded again in bounded chunks, so even a row that
    makes up a third of the table is never gathered in one place.
    """
    cols = df.columns
    row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    # a fixed number of partitions: they are tiny now but not once they are expanded
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (
        counted.select(
            "*", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {CHUNK}"))).alias("__chunk")
        )
        .repartition(parts, "__chunk", *cols)
        .withColumn("__row", row)
    )
    first = F.col("__chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("__n")) - 1
    copies = chunks.select(*cols, "__row", F.explode(F.sequence(first, last)).alias("__copy"))
    return copies.select(*cols, key_of(F.col("__row"), F.col("__copy")).alias(name))


def key_of(row: Column, copy: Column) -> Column:
    return F.md5(F.concat_ws("#", row, copy.cast("string")))
