"""Choosing columns by name, type or exclusion."""

import json

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_nominal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_boolean(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.BooleanType)


SELECTORS = {"all_numeric": is_numeric, "all_nominal": is_nominal}


def all_numeric(*but: str) -> str:
    """Selector: every numeric column, except those listed."""
    return "all_numeric" + json.dumps(but)


def all_nominal(*but: str) -> str:
    """Selector: every string column, except those listed."""
    return "all_nominal" + json.dumps(but)


def resolve(schema: T.StructType, terms) -> list[str]:
    """Column names for a mix of names and selectors, in schema order per term."""
    chosen: list[str] = []
    for term in terms:
        name, bracket, but = term.partition("[")
        if bracket and name in SELECTORS:
            skipped = json.loads(bracket + but)
            found = [f.name for f in schema if SELECTORS[name](f) and f.name not in skipped]
        elif term in schema.names:
            found = [term]
        else:
            raise ValueError(f"no column named {term!r}")
        chosen += [name for name in found if name not in chosen]
    if not chosen:
        raise ValueError("no column was selected")
    return chosen


def exclude(df: DataFrame, columns) -> DataFrame:
    """Drop the named columns; names that do not exist are ignored."""
    return df.drop(*(columns or ()))


def select_numeric(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*resolve(df.schema, [all_numeric(*but)]))


class DropColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Column removal as a pipeline stage."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return exclude(dataset, self.getOrDefault(self.columns))
