"""The write-ahead log: JSON lines of rows that are not in a segment yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.sources.parse import COMPACT
from logstrata.schema import LOG_LINE


def parse_wal(lines: DataFrame, value: str = "value") -> DataFrame:
    """(t, s, l, m, bad): every line that is not blank; bad holds the text of one that is no complete record."""
    x = lines.select(F.col(value).alias("v")).filter(F.trim("v") != "").withColumn("r", F.from_json("v", COMPACT))
    whole = F.col("r.t").isNotNull() & F.col("r.s").isNotNull() & F.col("r.l").isNotNull() & F.col("r.m").isNotNull()
    return x.select(*(F.when(whole, F.col(f"r.{c}")).alias(c) for c in "tslm"), F.when(~F.coalesce(whole, F.lit(False)), F.col("v")).alias("bad"))


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """The complete records of a write-ahead log; a missing file is an empty one, bad lines are skipped."""
    try:
        return parse_wal(spark.read.text(path)).filter("bad is null").drop("bad")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG_LINE)
