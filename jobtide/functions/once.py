"""Costly columns that are used by several filters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, kept: list[str], *computed: Column) -> DataFrame:
    """``kept`` columns plus ``computed`` ones, each evaluated once per row.

    A filter over a plain projection is moved below it with copies of the expressions it
    tests, and filters share no subexpressions. The one-element explode keeps a filter
    above it, while the projection below still shares common parts.
    """
    projected = df.select(*kept, *computed)
    names = [c for c in projected.columns if c not in kept]
    packed = projected.select(*kept, F.explode(F.array(F.struct(*names))).alias("_once"))
    return packed.select(*kept, "_once.*")
