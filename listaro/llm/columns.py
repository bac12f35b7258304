"""Column names that can't clash with those an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """(the columns of ``df`` but ``without`` as c_0, c_1, ..., those names by the old ones)."""
    new = {c: f"c_{i}" for i, c in enumerate(df.columns) if c not in without}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), new


def restored(df: DataFrame, new: dict[str, str], *added) -> DataFrame:
    """The numbered columns under their old names, then ``added``."""
    return df.select(*[F.col(n).alias(c) for c, n in new.items()], *added)
