"""Time range, keyword and limit over log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.operators.hotkeys import LEVEL_ALIASES

FIELDS = ("s", "l", "m")


def in_range(start: int | None, end: int | None, t: str = "t") -> Column:
    """start <= t <= end, both ends inclusive; None leaves an end open."""
    out = F.lit(True)
    if start is not None:
        out = F.col(t) >= start
    if end is not None:
        out = (F.col(t) <= end) if start is None else F.col(t).between(start, end)
    return out


def has_keyword(keyword: str, fields: tuple[str, ...] = FIELDS) -> Column:
    """A case-sensitive substring of any field; the empty keyword matches every row."""
    out = F.lit(not keyword)
    for f in fields if keyword else ():
        out = F.col(f).contains(keyword) if f == fields[0] else out | F.col(f).contains(keyword)
    return out


def level_matches(name: str, l: str = "l") -> Column:  # noqa: E741
    """Whether a level is meant by a name or alias such as WARNING, err or I; an unknown name matches nothing."""
    code = next((c for c, names in LEVEL_ALIASES.items() if name.upper() in names), None)
    return F.col(l) == code if code else F.lit(False)


def overlaps(start: int | None, end: int | None) -> Column:
    """Whether a segment's or chunk's [min_ts, max_ts] meets the range."""
    out = F.lit(True)
    if start is not None:
        out = F.col("max_ts") >= start
    if end is not None:
        out = out & (F.col("min_ts") <= end)
    return out


def search(
    logs: DataFrame, start: int | None = None, end: int | None = None, keyword: str = "", limit: int | None = 100, order: str = "scan",
    segments: DataFrame | None = None,
) -> DataFrame:
    """Rows of (segment_id, seq, t, s, l, m) in a time range that hold a keyword, newest first.

    order='scan' takes the first `limit` rows in the order in which a store is scanned (segments by newest time, then
    their rows as appended) and then sorts them; order='latest' takes the newest rows.  Both keep only `limit` rows per
    task on the way.  segments gives (segment_id, max_ts); without it, it is aggregated from the logs.
    """
    hits = logs.filter(in_range(start, end) & has_keyword(keyword))
    if order == "latest":
        out = hits.orderBy(F.desc("t"), "segment_id", "seq")
        return out if limit is None else out.limit(limit)
    if order != "scan":
        raise ValueError("order must be 'scan' or 'latest'")
    newest = (segments if segments is not None else logs.groupBy("segment_id").agg(F.max("t").alias("max_ts"))).select("segment_id", F.col("max_ts").alias("mx"))
    placed = hits.join(newest, "segment_id")
    if limit is not None:
        placed = placed.orderBy(F.desc("mx"), "segment_id", "seq").limit(limit)
    return placed.orderBy(F.desc("t"), F.desc("mx"), "segment_id", "seq").drop("mx")
