"""Keeping a table's own columns through an operator whose results may share their names."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_kept(docs: DataFrame, text: str, judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``docs`` for which ``judge`` gives ``keep``, with the columns of ``docs``."""
    aside = numbered(docs, text)
    return restored(judge(aside).filter(keep), docs, text)


def numbered(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with columns other than ``kept`` renamed out of the way."""
    return docs.select(*[F.col(f"`{c}`") if c in kept else F.col(f"`{c}`").alias(f"_kept_{i}")
                         for i, c in enumerate(docs.columns)])


def restored(result: DataFrame, docs: DataFrame, *kept: str) -> DataFrame:
    return result.select(*[F.col(f"`{c}`") if c in kept else F.col(f"_kept_{i}").alias(c)
                           for i, c in enumerate(docs.columns)])
