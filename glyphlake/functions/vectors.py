"""Column functions on dense vectors (P1-P9): distance, product, normalisation, sparsity, flattening and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_float(v: Column) -> Column:
    """The vector as 32-bit floats, as descriptors are stored."""
    return v.cast("array<float>")


def as_double(v: Column) -> Column:
    """The vector in double precision, as all arithmetic is done."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of an array of doubles, 0 for an empty one."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (no root)."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x * y))).otherwise(0.0)


def l2_norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalize(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors divided by their length; a zero vector stays as it is."""
    scaled = F.transform(vec, lambda x: x / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0))
    return df.withColumn("_norm", l2_norm(F.col(vec))).withColumn(vec, scaled).drop("_norm")


def dense_to_sparse(df: DataFrame, vec: str = "vec", *keep: str) -> DataFrame:
    """(keep..., idx, value) of the non-zero entries."""
    return df.select(*keep, F.posexplode(vec).alias("idx", "value")).where("value <> 0")


def flatten_rows(df: DataFrame, key: str, order: str, vec: str = "vec") -> DataFrame:
    """P5: (key, flat): the rows of each key's matrix after one another, by ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vec).alias("v"))))
    return df.groupBy(key).agg(F.flatten(F.transform(rows, lambda r: r["v"])).alias("flat"))


def reshape(v: Column, width: int) -> Column:
    """Array of rows of ``width`` entries; what is left over at the end is dropped, as whole rows only are formed."""
    n = F.floor(F.size(v) / F.lit(width)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * width + 1, F.lit(width)))
    return F.when(n > 0, rows).otherwise(F.array().cast("array<array<double>>"))


def explode_rows(df: DataFrame, matrix: str, *keep: str) -> DataFrame:
    """(keep..., row_id, row): one row per vector of a nested matrix."""
    return df.select(*keep, F.posexplode(matrix).alias("row_id", "row"))


def concat_rows(*parts: DataFrame) -> DataFrame:
    """Matrices below one another: (part, ...) with the position of the part each row came from."""
    out = None
    for k, part in enumerate(parts):
        one = part.withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to concatenate")
    return out
