"""Table preparation: fitted column transforms, each a pure projection.

The stages can be chained in any order in a ``Pipeline``.  ``TabularPrep`` is the
usual chain (unknown level, z-score, one-hot) fitted in two jobs, one over the
numeric and one over the nominal columns, and applied as a single ``select``.
"""

import math
from collections import Counter

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.operators.columns import (
    all_nominal,
    all_numeric,
    exclude,
    is_boolean,
    is_nominal,
    is_numeric,
    resolve,
)
from tabulant.operators.quantiles import medians

UNKNOWN = "unknown"
MAX_LEVELS = 10_000
SPELLED_LEVELS = 64


# -- fitting ---------------------------------------------------------------


def as_number(name: str):
    """A column as double, NaN counted as null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def fit_moments(df: DataFrame, cols) -> dict[str, dict]:
    """Rows, nulls, mean, sample sd, min and max of every column in one aggregate."""
    if not cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(cols):
        value = as_number(name)
        aggs += [
            F.count(value).alias(f"count_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"sd_{i}"),
            F.min(value).alias(f"min_{i}"),
            F.max(value).alias(f"max_{i}"),
        ]
    row = df.agg(*aggs).first()
    endless = [name for i, name in enumerate(cols) if math.inf in (row[f"max_{i}"], -(row[f"min_{i}"] or 0.0))]
    if endless:
        raise ValueError(f"infinite values in {endless}")
    return {
        name: {
            "rows": row["rows"],
            "nulls": row["rows"] - row[f"count_{i}"],
            "mean": row[f"mean_{i}"],
            "sd": row[f"sd_{i}"],
            "min": row[f"min_{i}"],
            "max": row[f"max_{i}"],
        }
        for i, name in enumerate(cols)
    }


def known_levels(df: DataFrame, name: str) -> list[str] | None:
    """Levels that an earlier stage left in the column's metadata."""
    return df.schema[name].metadata.get("levels")


def fit_levels(df: DataFrame, cols, max_levels: int = MAX_LEVELS, nulls: bool = True) -> dict[str, list[str]]:
    """Sorted distinct values per column; more than ``max_levels`` is an error.

    A level becomes a model input, so the list must be finite and is checked
    before it reaches the driver.  Nulls are no level; ``nulls=False`` refuses them.
    """
    if not cols:
        return {}
    cells = F.array(
        *[F.struct(F.lit(i).alias("c"), F.col(n).cast("string").alias("v")) for i, n in enumerate(cols)]
    )
    # one value more than allowed, and a null, per column still fit under the limit
    found = df.select(F.inline(cells)).distinct().limit((max_levels + 2) * len(cols)).collect()
    bad = [cols[r.c] for r in found if r.v is None]
    if bad and not nulls:
        raise ValueError(f"null values in {sorted(bad)}")
    levels = {}
    for i, name in enumerate(cols):
        levels[name] = sorted(r.v for r in found if r.c == i and r.v is not None)
        if len(levels[name]) > max_levels:
            raise ValueError(f"column {name!r} has more than {max_levels} levels")
    return levels


# -- expressions -----------------------------------------------------------


def checked(value, name: str):
    """``value``, or a run-time error where it is null or infinite."""
    message = F.lit(f"null value in column {name!r}")
    endless = F.raise_error(F.lit(f"infinite value in column {name!r}")).cast("double")
    known = F.when(F.abs(value) == F.lit(math.inf), endless).otherwise(value)
    return F.coalesce(known, F.raise_error(message).cast("double"))


def present(name: str):
    """The category as a string, or a run-time error where it is null."""
    message = F.lit(f"null value in column {name!r}")
    return F.coalesce(F.col(name).cast("string"), F.raise_error(message).cast("string"))


def zscore(value, moments: dict):
    """Centred and scaled by the training sd; a constant column is only centred."""
    return (value - F.lit(moments["mean"])) / F.lit(moments["sd"] or 1.0)


def novel_level(name: str, levels, unknown: str = UNKNOWN):
    """The value if it is a training level, ``unknown`` otherwise; null stays null."""
    value = F.col(name).cast("string")
    return F.when(value.isNull() | value.isin(list(levels)), value).otherwise(F.lit(unknown))


def one_hot_name(name: str, level: str) -> str:
    return f"{name}_{level}"


def one_hot(value, levels) -> list:
    return [F.when(value == F.lit(level), 1.0).otherwise(0.0) for level in levels]


def one_hot_cells(name: str, levels) -> list:
    """0/1 cells for the levels and, last, for an unseen value; null is an error."""
    value = F.col(name).cast("string")
    novel = F.when(value.isin(list(levels)), 0.0).when(value.isNotNull(), 1.0)
    return [*one_hot(value, levels), checked(novel, name)]


def one_hot_array(name: str, levels):
    """The same as an array expression, for level lists too long to spell out."""
    value = F.col(name).cast("string")
    known = F.array(*[F.lit(v) for v in levels])
    cells = F.transform(known, lambda level: F.when(value == level, 1.0).otherwise(0.0))
    novel = F.when(F.array_contains(known, value), 0.0).when(value.isNotNull(), 1.0)
    return F.concat(cells, F.array(checked(novel, name)))


# -- stages ----------------------------------------------------------------


class _Terms(Params):
    terms = Param(Params._dummy(), "terms", "column names and selectors", TypeConverters.toListString)

    def _columns(self, df: DataFrame) -> list[str]:
        return resolve(df.schema, self.getOrDefault(self.terms))


class _Fitted(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose whole state is one small JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted values, keyed by column")

    def __init__(self, state=None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    @property
    def fitted(self) -> dict:
        return self.getOrDefault(self.state)


class _Stage(Estimator, _Terms, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator whose only parameter is the choice of columns."""

    default = (all_numeric(),)

    @keyword_only
    def __init__(self, *, terms=None):
        super().__init__()
        self._set(terms=list(terms or self.default))


class NovelLevels(Estimator, _Terms, DefaultParamsReadable, DefaultParamsWritable):
    """Fix the level lists of nominal columns and add a level for unseen values."""

    unknown = Param(Params._dummy(), "unknown", "name of the new level", TypeConverters.toString)
    maxLevels = Param(Params._dummy(), "maxLevels", "levels allowed per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, terms=(all_nominal(),), unknown=UNKNOWN, maxLevels=MAX_LEVELS):
        super().__init__()
        self._set(terms=list(terms), unknown=unknown, maxLevels=maxLevels)

    def _fit(self, dataset):
        unknown = self.getOrDefault(self.unknown)
        levels = fit_levels(dataset, self._columns(dataset), self.getOrDefault(self.maxLevels))
        refuse_collision(levels, unknown)
        return NovelLevelsModel({"unknown": unknown, "levels": levels})


def refuse_collision(levels: dict, unknown: str) -> None:
    for name, values in levels.items():
        if unknown in values:
            raise ValueError(f"column {name!r} already has a level {unknown!r}; choose another name")


class NovelLevelsModel(_Fitted):
    def _transform(self, dataset):
        unknown = self.fitted["unknown"]
        mapped = {
            name: novel_level(name, levels, unknown).alias(name, metadata={"levels": [*levels, unknown]})
            for name, levels in self.fitted["levels"].items()
        }
        return dataset.select(*[mapped.get(c, F.col(c)) for c in dataset.columns])


class Standardize(_Stage):
    """Z-score of numeric columns with the training mean and sample sd."""

    def _fit(self, dataset):
        return StandardizeModel(fit_moments(dataset, self._columns(dataset)))


class StandardizeModel(_Fitted):
    def _transform(self, dataset):
        scaled = {
            name: zscore(F.col(name).cast("double"), m).alias(name) for name, m in self.fitted.items()
        }
        return dataset.select(*[scaled.get(c, F.col(c)) for c in dataset.columns])


class OneHot(_Stage):
    """One 0/1 column per level, appended after the other columns; a null category is an error."""

    default = (all_nominal(),)
    maxLevels = Param(Params._dummy(), "maxLevels", "levels allowed per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, terms=None, maxLevels=MAX_LEVELS):
        super().__init__(terms=terms)
        self._set(maxLevels=maxLevels)

    def _fit(self, dataset):
        cols = self._columns(dataset)
        levels = {c: known_levels(dataset, c) for c in cols}
        levels.update(fit_levels(dataset, [c for c in cols if levels[c] is None], self.getOrDefault("maxLevels")))
        names = [one_hot_name(c, v) for c in cols for v in levels[c]] + [c for c in dataset.columns if c not in cols]
        twice = sorted(n for n, times in Counter(names).items() if times > 1)
        if twice:
            raise ValueError(f"one-hot columns would repeat the names {twice[:5]}; rename the input columns")
        return OneHotModel(levels)


class OneHotModel(_Fitted):
    def _transform(self, dataset):
        rest = [c for c in dataset.columns if c not in self.fitted]
        hot = [
            value.alias(one_hot_name(name, level))
            for name, levels in self.fitted.items()
            for level, value in zip(levels, one_hot(present(name), levels))
        ]
        return dataset.select(*rest, *hot)


class ZeroVariance(_Stage):
    """Drop columns that hold a single value; nulls are not counted."""

    def _fit(self, dataset):
        cols = self._columns(dataset)
        bounds = []
        for i, name in enumerate(cols):
            value = as_number(name) if is_numeric(dataset.schema[name]) else F.col(name)
            bounds.append(F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias(str(i)))
        row = dataset.agg(*bounds).first()
        return ZeroVarianceModel({"drop": [name for i, name in enumerate(cols) if row[str(i)]]})


class ZeroVarianceModel(_Fitted):
    def _transform(self, dataset):
        return dataset.drop(*self.fitted["drop"])


class MedianImpute(_Stage):
    """Replace nulls and NaNs of numeric columns by the exact training median."""

    def _fit(self, dataset):
        return MedianImputeModel(medians(dataset, self._columns(dataset)))


class MedianImputeModel(_Fitted):
    def _transform(self, dataset):
        filled = {
            name: F.coalesce(as_number(name), F.lit(m)).alias(name) for name, m in self.fitted.items()
        }
        return dataset.select(*[filled.get(c, F.col(c)) for c in dataset.columns])


# -- the usual chain, fused ------------------------------------------------


class TabularPrep(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Unknown level, z-score, one-hot and assembly into ``features array<double>``.

    Numeric and boolean columns keep their order, one-hot columns follow.  With
    ``preprocess=False`` the given numeric columns are only assembled.
    """

    exclude = Param(Params._dummy(), "exclude", "columns that are not features", TypeConverters.toListString)
    terms = Param(Params._dummy(), "terms", "feature columns or selectors", TypeConverters.toListString)
    preprocess = Param(Params._dummy(), "preprocess", "fit and apply prep", TypeConverters.toBoolean)
    nullPolicy = Param(Params._dummy(), "nullPolicy", "error or impute_median", TypeConverters.toString)
    unknown = Param(Params._dummy(), "unknown", "name of the unseen level", TypeConverters.toString)
    maxLevels = Param(Params._dummy(), "maxLevels", "levels allowed per column", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        exclude=(),
        terms=None,
        preprocess=True,
        nullPolicy="error",
        unknown=UNKNOWN,
        maxLevels=MAX_LEVELS,
    ):
        super().__init__()
        self._set(
            exclude=list(exclude or ()),
            preprocess=preprocess,
            nullPolicy=nullPolicy,
            unknown=unknown,
            maxLevels=maxLevels,
        )
        if terms is not None:
            self._set(terms=list(terms))
        if nullPolicy not in ("error", "impute_median"):
            raise ValueError(f"unknown null policy {nullPolicy!r}")

    def _fit(self, dataset):
        df = exclude(dataset, self.getOrDefault(self.exclude))
        names = resolve(df.schema, self.getOrDefault(self.terms)) if self.isSet(self.terms) else df.columns
        fields = [df.schema[n] for n in names]
        preprocess = self.getOrDefault(self.preprocess)
        for f in fields:
            if not (is_numeric(f) or is_boolean(f) or (preprocess and is_nominal(f))):
                raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} is not a feature")

        numeric = [f.name for f in fields if is_numeric(f)]
        plain = [f.name for f in fields if not is_nominal(f)]
        nominal = [f.name for f in fields if is_nominal(f)]
        policy, unknown = self.getOrDefault(self.nullPolicy), self.getOrDefault(self.unknown)
        state = {"plain": plain, "moments": {}, "levels": {}, "fill": {}, "unknown": unknown}
        if preprocess:
            moments = fit_moments(df, numeric)
            missing = [n for n, m in moments.items() if m["nulls"]]
            if policy == "impute_median":
                state["fill"] = medians(df, numeric)
                if missing:
                    moments = fit_moments(MedianImputeModel(state["fill"]).transform(df), numeric)
            elif missing:
                raise ValueError(f"null values in {missing}; impute first or set nullPolicy")
            state["moments"] = moments
            state["levels"] = fit_levels(df, nominal, self.getOrDefault(self.maxLevels), nulls=False)
            refuse_collision(state["levels"], unknown)
        return TabularPrepModel(state)


class TabularPrepModel(_Fitted):
    @property
    def input_columns(self) -> list[str]:
        return [*self.fitted["plain"], *self.fitted["levels"]]

    @property
    def feature_names(self) -> list[str]:
        unknown = self.fitted["unknown"]
        return [
            *self.fitted["plain"],
            *[one_hot_name(n, v) for n, levels in self.fitted["levels"].items() for v in [*levels, unknown]],
        ]

    @property
    def width(self) -> int:
        return len(self.feature_names)

    @property
    def rows_seen(self) -> int | None:
        """Training rows, if they were counted along with the moments."""
        return next((m["rows"] for m in self.fitted["moments"].values()), None)

    def vector(self):
        """The feature array as one expression over the input columns."""
        state = self.fitted
        cells = []
        for name in state["plain"]:
            value = as_number(name)
            if name in state["fill"]:
                value = F.coalesce(value, F.lit(state["fill"][name]))
            value = checked(value, name)
            cells.append(zscore(value, state["moments"][name]) if name in state["moments"] else value)
        arrays = []
        for name, levels in state["levels"].items():
            if len(levels) <= SPELLED_LEVELS:
                cells += one_hot_cells(name, levels)
            else:
                arrays += [F.array(*cells)] if cells else []
                arrays.append(one_hot_array(name, levels))
                cells = []
        arrays += [F.array(*cells)] if cells else []
        return F.concat(*arrays) if len(arrays) > 1 else arrays[0]

    def _transform(self, dataset):
        if "features" in dataset.columns:
            raise ValueError("the table already has a column 'features'")
        return dataset.select("*", self.vector().alias("features"))
