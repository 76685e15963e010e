import random
import statistics

import pytest

from tabulant.operators import quantiles


@pytest.mark.parametrize("sketch", [8, 64, 8192])
@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4001])
def test_medians_at_any_size_of_sketch(spark, monkeypatch, sketch, n):
    """Many scans or one: exact, for smooth, repeated, heavy and nearly equal values."""
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "ERROR", 0.3 if sketch == 8 else 0.1 if sketch == 64 else quantiles.ERROR)
    rng = random.Random(n)
    makers = [
        lambda: rng.gauss(0, 1), lambda: float(rng.randrange(5)), lambda: 7.0 if rng.random() < 0.7 else rng.uniform(-1e300, 1e300),
        lambda: 1.0 + rng.randrange(9) * 2.0**-52, lambda: None if rng.random() < 0.3 and n > 9 else rng.expovariate(1),
        lambda: float("nan") if rng.random() < 0.3 and n > 9 else rng.random(),
    ]
    rows = [tuple(make() for make in makers) for _ in range(n)]
    names = [f"c{j}" for j in range(len(makers))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = quantiles.medians(df, names)
    for j, name in enumerate(names):
        values = [r[j] for r in rows if r[j] is not None and r[j] == r[j]]
        assert got[name] == pytest.approx(statistics.median(values), rel=1e-15)


def test_two_scans_for_many_columns(spark, monkeypatch):
    scans = []
    agg = type(spark.range(1)).agg
    monkeypatch.setattr(type(spark.range(1)), "agg", lambda self, *a: scans.append(1) or agg(self, *a))
    df = spark.range(200_000).selectExpr(*[f"(id * {j + 7}) % 100003 * 1.0 as c{j}" for j in range(20)])
    got = quantiles.medians(df, df.columns)
    assert len(scans) <= 2
    for j in (0, 19):
        assert got[f"c{j}"] == statistics.median((i * (j + 7)) % 100003 for i in range(200_000))


def test_refused(spark):
    with pytest.raises(ValueError, match="no values"):
        quantiles.medians(spark.sql("select cast(null as double) x"), ["x"])
    with pytest.raises(ValueError, match="infinite"):
        quantiles.medians(spark.sql("select double('inf') x union all select 1.0"), ["x"])
    assert quantiles.medians(spark.range(3), []) == {}
