"""Per-key results when a handful of keys hold most rows.

Every state kept per key is algebraic (counts, minimum, maximum), so Spark's partial aggregation combines each input
partition in a bounded hash table that falls back to sorting and spilling, and only one compact state per key and
partition is shuffled.  A key with a third of all rows costs one row per input partition in the shuffle, not a third of
the table; nothing is salted because nothing per-row is ever moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the four levels.
LEVEL_ALIASES = {
    "D": ("D", "DEBUG"),
    "I": ("I", "INFO"),
    "W": ("W", "WARN", "WARNING"),
    "E": ("E", "ERR", "ERROR"),
}


def canonical_level(level: Column) -> Column:
    """D, I, W or E for a known spelling without regard to case, null for anything else."""
    out = F.lit(None).cast("string")
    up = F.upper(F.trim(level))
    for code, names in LEVEL_ALIASES.items():
        out = F.when(up.isin(*names), code).otherwise(out)
    return out


def key_summary(df: DataFrame, key: Column, level: Column | None = None, time: Column | None = None) -> DataFrame:
    """One row per key: n_rows, n_debug, n_info, n_warn, n_error, n_other_level, first_t, last_t.

    Null is a key like any other and its rows are counted under it; nulls in level count as n_other_level, nulls in time
    are ignored by first_t and last_t (both null if a key has no time).  An empty input gives no rows.  Other columns of
    df, whatever their names, are not read.
    """
    slim = df.select(
        key.alias("key"),
        (canonical_level(level) if level is not None else F.lit(None).cast("string")).alias("lvl"),
        (time if time is not None else F.lit(None)).cast("long").alias("t"),
    )
    named = {"D": "n_debug", "I": "n_info", "W": "n_warn", "E": "n_error"}
    return slim.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count(F.when(F.col("lvl") == c, 1)).alias(n) for c, n in named.items()),
        F.count(F.when(F.col("lvl").isNull(), 1)).alias("n_other_level"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def hot_keys(df: DataFrame, key: Column, share: float = 0.04) -> DataFrame:
    """Keys that hold at least `share` of all rows: (key string, n_rows).

    All rows count towards the total, also those whose key is null; null itself is not listed.  A tie at exactly the
    share is listed.  The total is one count of the table (Parquet answers it from its footers); the test is exact for
    shares of at most four decimals because it compares integers.
    """
    total = df.count()
    return (
        key_summary(df, key)
        .filter(F.col("key").isNotNull() & (F.col("n_rows") * 10_000 >= F.lit(round(share * 10_000) * total)))
        .select(F.col("key").cast("string").alias("key"), "n_rows")
    )
