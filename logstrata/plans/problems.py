"""Queries of the general data-processing problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.operators import entries, hotkeys, timestamps
from logstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tables = (("log_lines", "service"), ("template_records", "pat_id"))
    found = [
        hotkeys.hot_keys(table(spark, d, t), F.col(c)).select(F.lit(t).alias("tbl"), F.col("key").alias("hot_key")) for t, c in tables
    ]
    return found[0].unionByName(found[1])


def p2_services(spark: SparkSession, d: str) -> DataFrame:
    """Rows, levels and range of arrival of every service."""
    found = hotkeys.key_summary(table(spark, d, "log_lines"), F.col("service"), F.col("level"), F.col("recv_t"))
    return found.withColumnsRenamed({"first_t": "first_arrival", "last_t": "last_arrival"})


def p2_service_times(spark: SparkSession, d: str) -> DataFrame:
    """Rows, levels and time range of every service, by the instants that the lines themselves give."""
    lines, sources = table(spark, d, "log_lines"), table(spark, d, "log_sources").select(F.col("stream_id").alias("source"), "zone")
    keep = {c: F.col(c) for c in ("service", "level")}
    timed = timestamps.line_instants(lines, sources, F.col("ts"), F.col("stream_id"), F.col("recv_t"), keep)
    return hotkeys.key_summary(timed, F.col("service"), F.col("level"), F.col("t"))


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, levels and time range of every template, the instants of its records being restored from the differences."""
    records = table(spark, d, "template_records").select("segment_id", "original_idx", "ts_delta", "pat_id", "level")
    timed = timestamps.restored(records, F.col("segment_id"), F.col("original_idx"), F.col("ts_delta"))
    return hotkeys.key_summary(timed, F.col("pat_id"), F.col("level"), F.col("t"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "log_lines").filter(~F.col("ts").rlike(r"^[0-9]{13}\z"))
    sources = table(spark, d, "log_sources").select(F.col("stream_id").alias("source"), "zone")
    return timestamps.normalise(lines, sources, F.col("ts"), F.col("stream_id"), F.col("recv_t"), {"line_id": F.col("line_id")})


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    """All entries of raw_lines, with the message of each."""
    return entries.entries(table(spark, d, "raw_lines"), F.col("file_id"), F.col("line_no"), F.col("ts"), F.col("message"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_entries(spark, d).drop("message")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_services, p2_service_times, p2_templates, p4_found, p5_entries, p5_found)}


_SUMMARY = """
select {key} key, count(*) n_rows,
  count(*) filter (lvl = 'D') n_debug, count(*) filter (lvl = 'I') n_info, count(*) filter (lvl = 'W') n_warn, count(*) filter (lvl = 'E') n_error,
  count(*) filter (lvl is null) n_other_level, min({time}) {first}, max({time}) {last}
from (select *, case when upper(trim(level)) in ('D', 'DEBUG') then 'D' when upper(trim(level)) in ('I', 'INFO') then 'I'
  when upper(trim(level)) in ('W', 'WARN', 'WARNING') then 'W' when upper(trim(level)) in ('E', 'ERR', 'ERROR') then 'E' end lvl from {table})
group by 1"""

_RESTORED = """(select r.*, t from template_records r left join (
  select segment_id, original_idx, cast(sum(ts_delta) over (partition by segment_id order by original_idx) as bigint) t
  from (select segment_id, original_idx, any_value(ts_delta) ts_delta from template_records group by 1, 2)) i using (segment_id, original_idx))"""


def oracle_sql() -> dict[str, str]:
    hot = "select '{t}' tbl, cast({c} as varchar) hot_key from {t} where {c} is not null group by {c} having count(*) >= 0.04 * (select count(*) from {t})"
    return {
        "p2_found": hot.format(t="log_lines", c="service") + " union all " + hot.format(t="template_records", c="pat_id"),
        "p2_services": _SUMMARY.format(key="service", time="recv_t", table="log_lines", first="first_arrival", last="last_arrival"),
        "p2_templates": _SUMMARY.format(key="pat_id", time="t", table=_RESTORED, first="first_t", last="last_t"),
    }
