"""Embeddings as vectors of integers, for the operators that compute in integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components are below this, so that squared distances of 64 components fit a long.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, dims: int, others: dict[str, str] | None = None) -> DataFrame:
    """(id long, v array<long>, others): the vectors with exactly ``dims`` components, none null or non-finite, each as floor(scale * x).

    ``others`` maps names of the result to further columns. A component that is not below LIMIT once scaled stops the job
    with an error that says so: its distances would not fit the result.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"), *[F.col(f"`{c}`").alias(name) for name, c in (others or {}).items()])
    good = rows.filter((F.size("x") == dims) & F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    floor = lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("bigint"))
    return good.select("id", F.transform("x", floor).alias("v"), *(others or {}))
