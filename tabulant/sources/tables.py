"""Reading the input tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table.

    ``spread`` suits work that costs more than reading: a file that cannot be split
    into as many partitions as there are cores is dealt out to all of them.  Tables of
    many files are left as they are, so a large input is never shuffled for it.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
