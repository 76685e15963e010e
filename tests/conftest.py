import hashlib

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def u(*parts) -> float:
    """A number in [0, 1) fixed by its name."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@pytest.fixture(scope="session")
def mixed(spark):
    """20 rows: two numbers, a category and a 0/1 target."""
    rows = [(i, u("n1", i) * 2 - 1, u("n2", i), "ab"[u("c", i) > 0.5], int(u("t", i) > 0.5)) for i in range(20)]
    return spark.createDataFrame(rows, "id bigint, num1 double, num2 double, cat1 string, target int").cache()


@pytest.fixture(scope="session")
def clusters(spark):
    """Three planted clusters of 200 rows: six numbers and a category that mostly agrees."""
    centres = [(0, 0, 0, 0, 0, 0), (4, 4, 0, 0, -4, 2), (-4, 0, 4, 4, 0, -2)]
    rows = []
    for i in range(600):
        c = i % 3
        cells = [centres[c][j] + u("x", i, j) - u("y", i, j) for j in range(6)]
        rows.append((i, *cells, "red green blue".split()[c] if u("k", i) < 0.9 else "red", f"class{c}"))
    names = ", ".join(f"x{j} double" for j in range(6))
    return spark.createDataFrame(rows, f"id bigint, {names}, colour string, label string").cache()


@pytest.fixture(scope="session")
def encoder(clusters):
    """A small encoder trained for a few epochs on the clusters, without their label."""
    import tabulant as tb

    return tb.fit_extractor(
        clusters,
        exclude_columns=["id", "label"],
        key_columns=["id"],
        batch_size=64,
        n_epochs=8,
        hidden=16,
        depth=3,
        learningRate=5e-3,
    )
