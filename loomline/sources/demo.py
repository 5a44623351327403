"""Generated rows for trying a pipeline out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def users(spark: SparkSession, rows: int = 10) -> DataFrame:
    """(id, name): ``User-1`` and so on."""
    return spark.range(1, rows + 1).select("id", F.concat(F.lit("User-"), F.col("id").cast("string")).alias("name"))


def documents(spark: SparkSession, rows: int = 10) -> DataFrame:
    """(id, content): ``Document-1`` and so on."""
    return spark.range(1, rows + 1).select("id", F.concat(F.lit("Document-"), F.col("id").cast("string")).alias("content"))
