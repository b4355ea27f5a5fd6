"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: A log line: epoch milliseconds, service, level, message.
LOG_LINE = T.StructType(
    [T.StructField("t", T.LongType()), T.StructField("s", T.StringType()), T.StructField("l", T.StringType()), T.StructField("m", T.StringType())]
)
LOG_COLUMNS = ("t", "s", "l", "m")
PARTS = "array<struct<is_param: boolean, text: string>>"
PARAMS = "array<struct<ptype: string, value: string>>"


class StoreError(ValueError):
    """Base of the store's errors."""


class InvalidInput(StoreError):
    """An argument that is not what the call needs, such as a time that is no number."""


class CorruptSegment(StoreError):
    """A segment whose files cannot be read."""
