"""Whole-table column work: names, nulls, one function over many columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from geoscore.functions.geo import finite


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case identifiers; repeats get the first of _2, _3 and so on that no other column has."""
    seen: dict[str, int] = {}
    used: set[str] = set()
    names = []
    for raw in df.columns:
        name = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", r"\1\3_\2\4", raw.replace("%", "percent"))
        name = re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower() or "x"
        name = "x" + name if name[0].isdigit() else name
        new = name
        while new in used:
            seen[name] = seen.get(name, 1) + 1
            new = f"{name}_{seen[name]}"
        used.add(new)
        names.append(new)
    return df.toDF(*names)


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """One function over many columns, in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def fill_null(df: DataFrame, values: Mapping[str, float | int | str]) -> DataFrame:
    return df.fillna(dict(values))


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return across(df, floating if cols is None else cols, finite)


def known(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with NaN and infinities of the named columns turned to NULL; columns that cannot hold them stay."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return across(df, [c for c in dict.fromkeys(cols) if c in floating], finite)


def any_null_flag(df: DataFrame, cols: Sequence[str], name: str = "is_na") -> DataFrame:
    """1 where any of the columns is NULL."""
    return df.withColumn(name, reduce(or_, [F.col(c).isNull() for c in cols]).cast("int"))


def expand_struct(df: DataFrame, struct: Column) -> DataFrame:
    """Fields of a multi-valued expression as columns of the same row."""
    return df.withColumn("_s", struct).select(*df.columns, "_s.*")
