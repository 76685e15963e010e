"""The extraction queries on rows of their own."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture
def orders(spark, tmp_path):
    rows = spark.range(40).select(
        (F.col("id") % 30).alias("o_orderkey"),  # some keys come twice
        (F.col("id") % 7).alias("o_custkey"),
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        (F.col("id") * 1.5).alias("o_totalprice"),
        F.current_timestamp().alias("o_orderdate"),
        F.when(F.col("id") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"),
    )
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_prepared_extraction_joins_nothing(spark, orders, monkeypatch):
    """A join of latent rows was broadcast through the driver."""
    monkeypatch.setattr(entry, "trained_encoder", entry.fixed_encoder)
    found = entry.extract_prepared(spark, orders)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.collect() == [(40, 0)]
