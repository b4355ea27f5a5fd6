"""Answers from metadata alone: ranges, existence, lower bounds, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.scalars import LEVEL_BITS
from logstrata.operators.hotkeys import LEVEL_ALIASES
from logstrata.operators.search import overlaps
from logstrata.operators.segments import keyword_possible
from logstrata.operators.templates import literal_contains


def query_range(segments: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Segments that meet the range, newest first; equal ones by id."""
    return segments.filter(overlaps(start, end)).orderBy(F.desc("max_ts"), "segment_id")


def query_by_id(segments: DataFrame, segment_id: int) -> DataFrame:
    return segments.filter(F.col("segment_id") == segment_id)


def stats(segments: DataFrame) -> DataFrame:
    """One row: segment_count, line_count, min_ts, max_ts; without segments the times are null and the counts 0."""
    return segments.agg(
        F.count(F.lit(1)).alias("segment_count"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("line_count"),
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
    )


def level_alias(keyword: str) -> str | None:
    return next((c for c, names in LEVEL_ALIASES.items() if keyword.upper() in names), None)


def has_level(code: str | None) -> Column:
    return F.lit(False) if code is None else F.col("level_mask").bitwiseAND(1 << LEVEL_BITS[code]) != 0


def may_exist(segments: DataFrame, start: int | None, end: int | None, keyword: str) -> DataFrame:
    """One row (may_exist): false only if no row in the range has the keyword as a substring or as a level's name.

    segments needs min_ts, max_ts, level_mask and trigrams; a segment whose trigrams are null is unknown and may hold
    anything.
    """
    possible = F.col("trigrams").isNull() | keyword_possible(keyword) | has_level(level_alias(keyword))
    return segments.filter(overlaps(start, end)).agg(F.coalesce(F.bool_or(possible), F.lit(False)).alias("may_exist"))


def count_at_least(segments: DataFrame, templates: DataFrame, start: int | None, end: int | None, keyword: str) -> DataFrame:
    """One row (at_least): a lower bound of the rows in the range that hold the keyword or are of the level it names.

    Only segments that lie wholly in the range count: each with the rows of its templates one of whose literals holds the
    keyword, or with one row if that is more and its levels include the named one.
    """
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("min_ts") >= start)
    if end is not None:
        inside = inside & (F.col("max_ts") <= end)
    sure = templates.filter(literal_contains(keyword)).groupBy("segment_id").agg(F.sum("row_count").alias("sure"))
    per = segments.filter(inside).join(sure, "segment_id", "left")
    bound = F.greatest(F.coalesce("sure", F.lit(0)), has_level(level_alias(keyword)).cast("long"))
    return per.agg(F.coalesce(F.sum(bound), F.lit(0)).alias("at_least"))


def compression_ratio(original: Column, stored: Column) -> Column:
    """original / stored, 0 if nothing is stored."""
    return F.when(stored == 0, F.lit(0.0)).otherwise(original / stored)
