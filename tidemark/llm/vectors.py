"""Vectors of a table, made ready for numpy inside tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, VECTOR = "vec_id", "embedding"


def _sound(v: Column, zero: bool) -> Column:
    inf = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return v.isNotNull() & (F.size(v) > 0) & finite & (F.lit(True) if zero else F.exists(v, lambda x: x != 0))


def sound_vectors(table: DataFrame, id: str = ID, vector: str = VECTOR, zero: bool = True) -> tuple[DataFrame, int, int]:
    """(id, v) of the rows whose vector is not null and has neither null nor non-finite entries, its length, and the number of rows.

    All have one length, the commonest (of equally common ones the longest); rows of other lengths are left out. Without
    ``zero`` the vectors of zeros alone are left out as well. Other columns do not matter. The length is 0 if there is no row.
    """
    kind = dict(table.dtypes)[vector]
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = table.select(F.col(id).alias("id"), v.alias("v")).filter(_sound(F.col("v"), zero))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (common.d, common.n) if common else (0, 0)
    return rows.filter(F.size("v") == d), d, n


def matrix(column, d: int):
    """The rows of an Arrow list column as a float64 matrix of width ``d``."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
