"""Functions of trees as columns, called over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def over_batches(f: Callable, kind: DataType) -> Callable[..., Column]:
    """A function of columns that gives f of their values; batches travel as Arrow arrays, not row by row."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*values) for values in zip(*(c.to_pylist() for c in columns))], arrow)

    return run
