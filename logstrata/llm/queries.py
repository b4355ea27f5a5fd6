"""Queries of the training-data problems, with their SQL where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import packing, phrases, spans, termstats
from logstrata.llm.runs import runs, text_event
from logstrata.operators import timestamps
from logstrata.session import broadcast_if_small, cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    counts, n = termstats.count_ngrams(termstats.template_terms(table(spark, d, "template_records")), F.col("terms"))
    return termstats.value_columns(termstats.mark(counts, n))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_values(spark, d).filter("mark is not null").select("field", "ty", "val", "mark")


def p1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    counts, _ = termstats.count_ngrams(termstats.template_terms(table(spark, d, "template_records")), F.col("terms"), sigma=3)
    return counts.select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n_terms"), "occurrences", "records")


def template_events(spark: SparkSession, d: str) -> DataFrame:
    """template_records with `event`: the literal text of the template, or the id itself where there is no template."""
    literal = F.array_join(F.transform(F.filter("parts", lambda p: ~p["is_param"]), lambda p: p["text"]), " ")
    plain = F.trim(F.regexp_replace(F.lower(literal), r"\s+", " "))
    names = table(spark, d, "templates").groupBy("pat_id").agg(F.min(F.concat(F.lit("="), plain)).alias("literal"))
    records = table(spark, d, "template_records").select("segment_id", "original_idx", "pat_id", "ts_delta")
    return records.join(broadcast_if_small(names), "pat_id", "left").withColumn("event", F.coalesce("literal", F.col("pat_id").cast("string")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    logs = runs(table(spark, d, "log_lines"), F.col("stream_id"), F.col("seq"), text_event(F.col("message")))
    records = runs(template_events(spark, d), F.col("segment_id"), F.col("original_idx"), F.col("event"))
    cols = ["sequence_id", "first_pos", "last_pos", "n_members"]
    return logs.select(F.lit("log_lines").alias("tbl"), *cols).unionByName(records.select(F.lit("template_records").alias("tbl"), *cols))


def _timed(found: DataFrame, name: str) -> DataFrame:
    took = F.when(F.col("n_timed") > 1, F.col("high_t") - F.col("low_t"))
    return found.select(
        F.lit(name).alias("tbl"), "sequence_id", "first_pos", "last_pos", "n_members", "n_timed", F.col("low_t").alias("first_t"), F.col("high_t").alias("last_t"), took.alias("duration_ms")
    )


def p3_record_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of template_records with their duration, by instants restored from the differences."""
    restored = timestamps.restored(template_events(spark, d), F.col("segment_id"), F.col("original_idx"), F.col("ts_delta"))
    return _timed(runs(restored, F.col("segment_id"), F.col("original_idx"), F.col("event"), F.col("t"), extent=True), "template_records")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of both tables with their duration, from the earliest to the latest of the members' own instants.

    The duration is null where fewer than two members have a readable instant; n_timed tells how many have.
    """
    lines, sources = table(spark, d, "log_lines"), table(spark, d, "log_sources").select(F.col("stream_id").alias("source"), "zone")
    timed = timestamps.line_instants(lines, sources, F.col("ts"), F.col("stream_id"), F.col("recv_t"), {c: F.col(c) for c in ("stream_id", "seq", "message")})
    logs = runs(timed, F.col("stream_id"), F.col("seq"), text_event(F.col("message")), F.col("t"), extent=True)
    return _timed(logs, "log_lines").unionByName(p3_record_runs(spark, d))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    limits = {r.limit_name: r.capacity_tokens for r in table(spark, d, "pack_limits").collect()}  # three rows, fixed
    return packing.pack_limits(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), limits)


def _phrases(spark: SparkSession, d: str, slop: int) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return phrases.search_all(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), length=12, slop=slop)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d, 0).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d, 0).distinct()


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d, 2).select("doc_id", "item_id").distinct()


def _shared(spark: SparkSession, d: str) -> spans.SharedSpans:
    return spans.SharedSpans(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).pairs()


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).coverage()


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).stretches()


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the class of its exact copies."""
    return _shared(spark, d).membership()


def p8_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes with a common span; with p8_classes they say what p8_found says, without expanding copies."""
    return _shared(spark, d).class_pairs()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_values, p1_ngrams, p3_found, p3_runs, p3_record_runs, p6_packing, p7_found, p7_passages, p7_near, p8_found, p8_coverage, p8_stretches, p8_classes, p8_class_pairs)}


_VALUES = """
with r as (select segment_id, original_idx, any_value(pat_id) pat_id, first(params) params from template_records group by 1, 2),
v as (
  select segment_id, original_idx, 'pat_id' field, -1 ty, cast(pat_id as varchar) val from r where pat_id is not null
  union all
  select segment_id, original_idx, 'bytes', p.ty, hex(p.bytes) from (select segment_id, original_idx, unnest(params) p from r) where p.bytes is not null
),
c as (select field, cast(ty as int) ty, val, count(*) occurrences, count(distinct (segment_id, original_idx)) records from v group by 1, 2, 3),
m as (select *, case when records < 3 then 'rare' when records > 0.02 * (select count(*) from r) then 'common' end mark from c)
"""
_RUNS = """
with e as ({events}),
n as (select *, case when ev is not null and ev = lag(ev) over w then 0 else 1 end fresh from e window w as (partition by sid order by pos)),
g as (select *, sum(fresh) over (partition by sid order by pos) run from n)
"""
_LOG_EVENTS = r"""
  select stream_id sid, seq pos,
    trim(regexp_replace(lower(regexp_replace(' ' || regexp_replace(any_value(message), '\s+', '  ', 'g') || ' ', '\s\S*[0-9]\S*\s', ' ', 'g')), '[^\p{L}]+', ' ', 'g')) ev
  from log_lines group by 1, 2"""
_TEMPLATE_EVENTS = r"""
  select segment_id sid, original_idx pos, coalesce(any_value(lit), cast(any_value(r.pat_id) as varchar)) ev
  from template_records r left join (
    select pat_id, '=' || trim(regexp_replace(lower(array_to_string([p.text for p in parts if not p.is_param], ' ')), '\s+', ' ', 'g')) lit from templates
  ) t on r.pat_id = t.pat_id group by 1, 2"""
_TIMED_EVENTS = f"""
  select e.*, cast(sum(dt) over (partition by sid order by pos) as bigint) t from ({_TEMPLATE_EVENTS}) e
  join (select segment_id sid, original_idx pos, any_value(ts_delta) dt from template_records group by 1, 2) using (sid, pos)"""
_RUN_ROWS = "select {tbl} sid sequence_id, min(pos) first_pos, max(pos) last_pos, count(*) n_members{more} from g where ev is not null group by sid, run having count(*) > 1"


_SHARED = """
with d as (select doc_id, text from documents where length(text) >= 300),
t as (select text, min(doc_id) rep, count(distinct doc_id) > 1 copied from d group by 1),
c as (select rep, o, text[o + 1:o + 799] x from (select rep, text, unnest(range(0, length(text) - 299, 500)) o from t)),
s as materialized (select rep, o + unnest(range(0, least(500, length(x) - 299))) i, unnest(list_transform(range(0, least(500, length(x) - 299)), lambda i: hash(x[i + 1:i + 300]))) h from c),
r as (select h from s group by 1 having min(rep) <> max(rep)),
m as (select doc_id, rep, copied, length(text) n from d join t using (text))
"""
_CLASS_PAIRS = ", k as (select distinct h, rep from s semi join r using (h)), p as (select distinct a.rep x, b.rep y from k a join k b on a.h = b.h and a.rep < b.rep) "
_STRETCHES = """, w as (select rep, i, case when i <= lag(i) over (partition by rep order by i) + 300 then 0 else 1 end fresh from (select distinct rep, i from s semi join r using (h))),
g as (select rep, i, sum(fresh) over (partition by rep order by i) k from w),
z as (select doc_id, case when copied then 0 else a end as "start", case when copied then n else b - a end as "length" from m left join (select rep, k, min(i) a, max(i) + 300 b from g group by 1, 2) using (rep) where copied or a is not null),
st as (select distinct doc_id, "start", "length" from z) """
_LEAKS = r"""
with i as (select item_id, regexp_extract_all(lower(text), '[\pL\pN]+') w from eval_items),
d as (select doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') w from documents),
ig as (select distinct item_id, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
dg as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d))
select distinct doc_id, item_id from dg join ig using (g)"""
_NGRAMS = """
with r as (select segment_id, original_idx, any_value(pat_id) pat_id, first(params) params from template_records group by 1, 2),
t as (select segment_id, original_idx, list_concat(case when pat_id is null then [] else ['pat_id|-1|' || pat_id] end,
  list_transform(list_filter(coalesce(params, []), lambda p: p.bytes is not null), lambda p: 'bytes|' || coalesce(cast(p.ty as varchar), '') || '|' || hex(p.bytes))) w from r),
g as (select segment_id, original_idx, n, array_to_string(w[k:k + n - 1], ' ') gram from (select *, unnest(range(1, len(w) - n + 2)) k from t, (values (1), (2), (3)) x(n)))
select gram, cast(n as int) n_terms, count(*) occurrences, count(distinct (segment_id, original_idx)) records from g group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    run = lambda events, tbl, more="": _RUNS.format(events=events) + _RUN_ROWS.format(tbl=tbl, more=more)
    return {
        "p1_values": _VALUES + "select field, ty, val, occurrences, records, mark from m",
        "p1_found": _VALUES + "select field, ty, val, mark from m where mark is not null",
        "p3_found": f"select * from ({run(_LOG_EVENTS, "'log_lines' tbl,")}) union all select * from ({run(_TEMPLATE_EVENTS, "'template_records' tbl,")})",
        "p1_ngrams": _NGRAMS,
        "p7_found": _LEAKS.replace("\\\\", "\\"),
        "p8_found": _SHARED + _CLASS_PAIRS + ", e as (select * from p union all select rep, rep from t where copied) select distinct least(a.doc_id, b.doc_id) doc_a, greatest(a.doc_id, b.doc_id) doc_b from e join m a on a.rep = x join m b on b.rep = y where a.doc_id <> b.doc_id",
        "p8_class_pairs": _SHARED + _CLASS_PAIRS + "select x class_a, y class_b from p",
        "p8_classes": "select distinct doc_id, min(doc_id) over (partition by text) class_id from documents where text is not null",
        "p8_stretches": _SHARED + _STRETCHES + "select * from st",
        "p8_coverage": _SHARED + _STRETCHES + 'select doc_id, coalesce(length(text), 0) n_chars, cast(coalesce(sum("length"), 0) as bigint) shared_chars from documents left join st using (doc_id) group by all',
        "p3_record_runs": run(_TIMED_EVENTS, "'template_records' tbl,", ", count(t) n_timed, min(t) first_t, max(t) last_t, case when count(t) > 1 then max(t) - min(t) end duration_ms"),
    }
