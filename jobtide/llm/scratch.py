"""Tables written between steps, in the folder that all executors share."""

from pyspark.sql import DataFrame

from jobtide.session import fresh_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["fresh_path", "stored"]
