"""Generators of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The messages of the plain generator.
MESSAGES = (
    "User login successful",
    "Connection timeout after 3000ms",
    "Query executed in 45ms",
    "Cache miss for key user:12345",
    "Payment processed: $99.99",
    "Health check passed",
    "ERROR: null pointer exception at line 42",
    "WARN: retry attempt 3/3",
    "Config reloaded successfully",
)
#: Patterns of the varied generator as (service, level, pattern).
VARIED = (
    ("nginx", "I", "GET /api/v1/items/%d 200 %dms"),
    ("nginx", "W", "slow request /api/v1/search/%d took %dms"),
    ("auth", "I", "User %d logged in after %d attempts"),
    ("auth", "E", "login failed for user %d: code %d"),
    ("payment", "I", "payment %d settled in %dms"),
    ("payment", "E", "ERROR: payment %d declined, retry in %ds"),
    ("db", "I", "query %d returned %d rows"),
    ("db", "W", "WARN: lock wait on table %d for %dms"),
    ("cache", "D", "evicted key %d after %ds"),
    ("gateway", "E", "upstream %d unreachable after %dms"),
    ("order", "I", "order %d shipped from depot %d"),
)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def generate_lines(spark: SparkSession, count: int, base_t: int, service: str = "app") -> DataFrame:
    """(seq, t, s, l, m): the messages in turn, 100 ms apart, each with its number."""
    m = _pick(list(MESSAGES), F.col("id") % len(MESSAGES))
    level = F.when(m.contains("ERROR"), "E").when(m.contains("WARN"), "W").otherwise("I")
    return spark.range(count).select(
        F.col("id").alias("seq"), (F.lit(base_t) + F.col("id") * 100).alias("t"), F.lit(service).alias("s"), level.alias("l"),
        F.concat(m, F.lit(" [seq="), F.col("id").cast("string"), F.lit("]")).alias("m"),
    )


def generate_varied(spark: SparkSession, count: int, base_t: int, burst: bool = False, seed: int = 42) -> DataFrame:
    """(seq, t, s, l, m) from many patterns with jittered times; a burst packs the middle fifth four times as densely."""
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(n))
    which = draw(1, len(VARIED))
    column = lambda k: _pick([v[k] for v in VARIED], which)
    step = F.lit(10)
    t = i * step + draw(2, 5)
    if burst:
        lo, hi = count * 4 // 10, count * 6 // 10
        t = F.when(i < lo, t).when(i < hi, lo * step + (i - lo) * 2 + draw(2, 2)).otherwise(lo * step + (hi - lo) * 2 + (i - hi) * step + draw(2, 5))
    return spark.range(count).select(
        i.alias("seq"), (F.lit(base_t) + t).alias("t"), column(0).alias("s"), column(1).alias("l"),
        F.replace(F.regexp_replace(F.regexp_replace(column(2), "^([^%]*)%d", F.concat(F.lit("$1"), draw(3, 100_000).cast("string"))), "%d", draw(4, 5000).cast("string")), F.lit("%%"), F.lit("%")).alias("m"),
    )


def to_json_lines(df: DataFrame) -> DataFrame:
    """(value): compact JSON, one line per row."""
    return df.select(F.to_json(F.struct("t", "s", "l", "m")).alias("value"))
