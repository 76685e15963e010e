import statistics

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabulant.operators import columns, prep
from tabulant.operators.quantiles import medians


def features(df):
    return [r.features for r in df.orderBy("id").collect()]


def test_matrix_layout_and_values(mixed):
    model = prep.TabularPrep(exclude=["id", "target", "absent"]).fit(mixed)
    assert model.feature_names == ["num1", "num2", "cat1_a", "cat1_b", "cat1_unknown"]
    rows = mixed.orderBy("id").collect()
    got = features(model.transform(mixed))
    mean, sd = statistics.mean(r.num1 for r in rows), statistics.stdev(r.num1 for r in rows)
    assert [g[0] for g in got] == pytest.approx([(r.num1 - mean) / sd for r in rows])
    assert [g[2:] for g in got] == [[float(r.cat1 == "a"), float(r.cat1 == "b"), 0.0] for r in rows]


def test_extra_columns_are_tolerated_and_unseen_levels_mapped(spark, mixed):
    model = prep.TabularPrep(exclude=["id", "target"]).fit(mixed)
    new = mixed.withColumn("cat1", F.lit("zzz")).withColumn("more", F.lit(1))
    assert all(g[2:] == [0.0, 0.0, 1.0] for g in features(model.transform(new)))


def test_long_level_lists_use_the_array_form(spark):
    df = spark.range(300).select("id", F.format_string("v%03d", F.col("id")).alias("c"), F.lit(2).alias("n"))
    model = prep.TabularPrep(exclude=["id"]).fit(df)
    assert model.width == 302
    got = features(model.transform(df))
    assert all(g[0] == 0.0 and g[1 + i] == 1.0 and sum(g) == 1.0 for i, g in enumerate(got))
    unseen = spark.createDataFrame([(0, "other", 2)], "id bigint, c string, n int")
    assert features(model.transform(unseen))[0][-1] == 1.0


def test_too_many_levels_are_refused(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 20 levels"):
        prep.TabularPrep(maxLevels=20).fit(df)
    assert prep.TabularPrep(maxLevels=30).fit(df).width == 31


def test_boolean_is_cast_but_not_scaled(spark):
    df = spark.createDataFrame([(0, True, 1.0), (1, False, 2.0)], "id bigint, b boolean, x double")
    got = features(prep.TabularPrep(exclude=["id"]).fit(df).transform(df))
    assert [g[0] for g in got] == [1.0, 0.0]


def test_timestamps_are_refused(spark):
    df = spark.range(3).select("id", F.current_timestamp().alias("ts"))
    with pytest.raises(ValueError, match="ts"):
        prep.TabularPrep().fit(df)


def test_constant_column_is_only_centred(spark):
    df = spark.range(4).select("id", F.lit(5.0).alias("x"))
    assert features(prep.TabularPrep(exclude=["id"]).fit(df).transform(df)) == [[0.0]] * 4


def test_literal_unknown_level_collides(spark):
    df = spark.createDataFrame([("unknown",), ("a",)], "c string")
    with pytest.raises(ValueError, match="another name"):
        prep.TabularPrep().fit(df)
    assert prep.TabularPrep(unknown="other").fit(df).feature_names == ["c_a", "c_unknown", "c_other"]


@pytest.mark.parametrize("bad", ["cast(null as double)", "double('NaN')"])
def test_null_policies(spark, bad):
    df = spark.range(5).select("id", F.expr(f"if(id = 2, {bad}, id * 1.0D)").alias("x"))
    with pytest.raises(ValueError, match="null values in"):
        prep.TabularPrep(exclude=["id"]).fit(df)
    model = prep.TabularPrep(exclude=["id"], nullPolicy="impute_median").fit(df)
    # the median of 0, 1, 3, 4 is 2
    sd = statistics.stdev([0, 1, 2, 3, 4])
    assert [g[0] for g in features(model.transform(df))] == pytest.approx([(v - 2.0) / sd for v in range(5)])


def test_null_category_is_refused_at_fit_and_at_transform(spark, mixed):
    holes = mixed.withColumn("cat1", F.expr("if(id = 3, null, cat1)"))
    with pytest.raises(ValueError, match="cat1"):
        prep.TabularPrep(exclude=["id", "target"]).fit(holes)
    model = prep.TabularPrep(exclude=["id", "target"]).fit(mixed)
    with pytest.raises(Exception, match="null value in column 'cat1'"):
        model.transform(holes).collect()


def test_bypass_assembles_numbers_only(mixed):
    model = prep.TabularPrep(terms=["num1", "num2"], preprocess=False).fit(mixed)
    rows = mixed.orderBy("id").collect()
    assert features(model.transform(mixed)) == [[r.num1, r.num2] for r in rows]
    with pytest.raises(ValueError, match="cat1"):
        prep.TabularPrep(terms=["cat1"], preprocess=False).fit(mixed)


def test_single_column(mixed):
    assert prep.TabularPrep(terms=["num1"]).fit(mixed).width == 1


def test_stages_chain_in_the_other_order_and_persist(spark, mixed, tmp_path):
    numbers = columns.all_numeric("id", "target")
    chain = Pipeline(
        stages=[
            columns.DropColumns(columns=["absent"]),
            prep.NovelLevels(),
            prep.OneHot(),
            prep.ZeroVariance(terms=[numbers]),
            prep.Standardize(terms=[numbers]),
        ]
    )
    model = chain.fit(mixed)
    out = model.transform(mixed)
    # the unknown column is constant in training and therefore dropped; one-hot columns are scaled
    assert out.columns == ["id", "num1", "num2", "target", "cat1_a", "cat1_b"]
    stats = out.agg(F.avg("cat1_a").alias("m"), F.stddev_samp("cat1_a").alias("s")).first()
    assert (stats.m, stats.s) == pytest.approx((0.0, 1.0), abs=1e-12)
    model.write().save(str(tmp_path / "chain"))
    again = PipelineModel.load(str(tmp_path / "chain")).transform(mixed)
    assert again.orderBy("id").collect() == out.orderBy("id").collect()


def test_zero_variance_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, "b", None)], "x double, c string, e double")
    terms = [columns.all_numeric(), columns.all_nominal()]
    assert prep.ZeroVariance(terms=terms).fit(df).transform(df).columns == ["c"]


def test_selectors(mixed):
    assert columns.resolve(mixed.schema, [columns.all_numeric("id")]) == ["num1", "num2", "target"]
    assert columns.resolve(mixed.schema, [columns.all_nominal(), "num2"]) == ["cat1", "num2"]
    with pytest.raises(ValueError, match="no column named"):
        columns.resolve(mixed.schema, ["nope"])
    with pytest.raises(ValueError, match="no column was selected"):
        columns.resolve(mixed.schema, [columns.all_nominal("cat1")])


def test_medians_are_exact(spark):
    odd = spark.range(0, 10_001, 1, 7).select(((F.col("id") * 7919) % 10_007).cast("double").alias("x"))
    values = [r.x for r in odd.collect()]
    assert medians(odd, ["x"])["x"] == statistics.median(values)
    even = odd.limit(10_000)
    assert medians(even, ["x"])["x"] == statistics.median(r.x for r in even.collect())


def test_medians_with_a_heavy_value_and_wide_range(spark):
    df = spark.range(1000).select(
        F.expr("case when id < 400 then 7.25D when id = 999 then 1e300 else id / 3.0D end").alias("x"),
        F.expr("if(id % 3 = 0, null, -id * 1e-9)").alias("y"),
    )
    rows = df.collect()
    got = medians(df, ["x", "y"])
    assert got["x"] == statistics.median(r.x for r in rows)
    assert got["y"] == pytest.approx(statistics.median(float(r.y) for r in rows if r.y is not None), rel=1e-15)


def test_infinite_values_are_refused(spark):
    good = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    for value in (float("inf"), float("-inf")):
        bad = good.union(spark.createDataFrame([(value,)], "x double"))
        with pytest.raises(ValueError, match="infinite"):
            prep.TabularPrep().fit(bad)
        with pytest.raises(Exception, match="infinite value in column 'x'"):
            prep.TabularPrep().fit(good).transform(bad).collect()
        with pytest.raises(Exception, match="infinite value in column 'x'"):
            prep.TabularPrep(preprocess=False).fit(good).transform(bad).collect()


def test_staged_one_hot_refuses_null_categories_and_repeated_names(spark):
    df = spark.createDataFrame([("p", 1), ("q", 2)], "c string, n int")
    model = prep.OneHot(terms=["c"]).fit(df)
    with pytest.raises(Exception, match="null value in column 'c'"):
        model.transform(spark.createDataFrame([(None, 1)], "c string, n int")).collect()
    clash = spark.createDataFrame([("b_c", "x")], "a string, a_b string")
    with pytest.raises(ValueError, match="a_b_c"):
        prep.OneHot(terms=["a", "a_b"]).fit(clash.replace("x", "c"))
    with pytest.raises(ValueError, match="more than 1 levels"):
        prep.OneHot(terms=["c"], maxLevels=1).fit(df)
