"""Queries of the log store's own operators over the event log, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import scalars
from logstrata.functions.tokens import param_type, tokenize, type_sequence
from logstrata.operators import manifest, segments, templates
from logstrata.operators.search import has_keyword, in_range, level_matches, overlaps, search
from logstrata.plans.logs import LOGS_SQL, event_logs
from logstrata.session import cut, shared_folder, table
from logstrata.sources.generate import generate_lines
from logstrata.sources.parse import infer_level, parse_lines
from logstrata.sources.wal import parse_wal
from logstrata.store import LogStore, StoreConfig, numbered

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
ROW = ["segment_id", "seq", "t", "s", "l", "m"]
# The middle of the event table's time range, in epoch milliseconds.
START, END = 1_704_700_000_000, 1_706_000_000_000
KEYWORDS = ("click", "svc-3", "E", "purchase", "no such word", "")
BASE_T = 1_700_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL; `with logs` is put before SQL that names logs."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if sql.lstrip().startswith("with") else f"with {LOGS_SQL} {sql}"
        return f

    return add


_ROWS = "select segment_id, seq, t, s, l, m from logs"


@query(_ROWS)
def scan_loglines(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).select(ROW)


@query(f"{_ROWS} where t between {START} and {END}")
def time_range(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d, START, END).select(ROW)


def _keyword(name: str, keyword: str, fields: tuple[str, ...]) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return event_logs(spark, d).filter(has_keyword(keyword, fields)).select(ROW)

    f.__name__ = name
    quoted = keyword.replace("'", "''")
    query(f"{_ROWS} where " + (" or ".join(f"contains({c}, '{quoted}')" for c in fields)))(f)


_keyword("keyword_message", "error", ("m",))
_keyword("keyword_service", "svc-3", ("s",))
_keyword("keyword_level", "E", ("l",))
_keyword("keyword_any", "3", ("s", "l", "m"))
_keyword("keyword_case_sensitive", "ERROR", ("s", "l", "m"))
_keyword("keyword_literal_percent", "%", ("s", "l", "m"))
_keyword("empty_keyword", "", ("s", "l", "m"))


@query(f"""select segment_id, seq, t, s, l, m from (
  select *, row_number() over (order by mx desc, segment_id, seq) rn from (select *, max(t) over (partition by segment_id) mx from logs)
  where t between {START} and {END} and (contains(s, 'error') or contains(l, 'error') or contains(m, 'error'))) where rn <= 50""")
def limit_scan_order(spark, d):  # noqa: ANN001, ANN201
    # the newest time of each segment comes from two columns of all rows, the rows themselves only from the range
    manifest_rows = segments.summaries(event_logs(spark, d)).select("segment_id", "max_ts")
    return search(event_logs(spark, d, START, END), START, END, "error", 50, segments=manifest_rows).select(ROW)


@query(f"{_ROWS} where contains(m, 'click') order by t desc, segment_id, seq limit 100")
def topk_latest(spark, d):  # noqa: ANN001, ANN201
    return search(event_logs(spark, d), None, None, "click", 100, "latest").select(ROW)


@query(f"{_ROWS} where l = 'W'")
def level_filter(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).filter(level_matches("warning")).select(ROW)


@query(f"{_ROWS} where s = 'svc-5'")
def service_filter(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).filter(F.col("s") == "svc-5").select(ROW)


@query(f"""select segment_id, seq, t, s, l, m from logs where contains(m, 'view')
  union all select null, event_id, epoch_us(ts) // 1000, 'buffer', 'I', 'unflushed ' || event_type from events where event_type = 'view'""")
def union_buffer(spark, d):  # noqa: ANN001, ANN201
    stored = event_logs(spark, d)
    e = table(spark, d, "events")
    buffered = e.select(
        F.lit(None).cast("long").alias("segment_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.lit("buffer").alias("s"), F.lit("I").alias("l"), F.concat(F.lit("unflushed "), "event_type").alias("m"),
    )
    return stored.select(ROW).unionByName(buffered).filter(has_keyword("view"))


# Segments, chunks and metadata.
_BIT = "case l when 'D' then 1 when 'W' then 4 when 'E' then 8 else 2 end"
_SEG = f"segs as (select segment_id, min(t) min_ts, max(t) max_ts, count(*) line_count, cast(bit_or({_BIT}) as int) level_mask from logs group by 1)"


@query(f"with {LOGS_SQL}, {_SEG} select * from segs")
def segment_manifest(spark, d):  # noqa: ANN001, ANN201
    return segments.summaries(event_logs(spark, d)).drop("raw_bytes")


@query(f"with {LOGS_SQL}, {_SEG} select *, row_number() over (order by max_ts desc, segment_id) as rn from segs where max_ts >= {START} and min_ts <= {END}")
def segments_overlap(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    found = manifest.query_range(segments.summaries(event_logs(spark, d)).drop("raw_bytes"), START, END)
    return found.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("max_ts"), "segment_id")))


@query(f"with {LOGS_SQL}, {_SEG} select * from segs where segment_id = 3")
def segment_by_id(spark, d):  # noqa: ANN001, ANN201
    return manifest.query_by_id(segments.summaries(event_logs(spark, d)).drop("raw_bytes"), 3)


@query(f"with {LOGS_SQL}, {_SEG} select count(*) segment_count, cast(sum(line_count) as bigint) line_count, min(min_ts) min_ts, max(max_ts) max_ts from segs")
def index_stats(spark, d):  # noqa: ANN001, ANN201
    return manifest.stats(segments.summaries(event_logs(spark, d)))


@query(f"select segment_id, chunk_id, min(t) min_ts, max(t) max_ts, count(*) line_count, cast(bit_or({_BIT}) as int) level_mask from logs group by 1, 2")
def chunk_stats(spark, d):  # noqa: ANN001, ANN201
    return segments.summaries(event_logs(spark, d), ("segment_id", "chunk_id")).drop("raw_bytes")


@query(f"""select segment_id, chunk_id, count(*) line_count from logs group by 1, 2
  having max(t) >= {START} and min(t) <= {END}""")
def chunks_overlap(spark, d):  # noqa: ANN001, ANN201
    return segments.summaries(event_logs(spark, d), ("segment_id", "chunk_id")).filter(overlaps(START, END)).select("segment_id", "chunk_id", "line_count")


@query(f"select segment_id, cast(bit_or({_BIT}) as int) level_mask, bit_count(bit_or({_BIT})) n_levels from logs group by 1")
def level_mask_by_segment(spark, d):  # noqa: ANN001, ANN201
    return segments.summaries(event_logs(spark, d)).select("segment_id", "level_mask", F.bit_count("level_mask").cast("tinyint").alias("n_levels"))


@query("select l, count(*) n from logs group by 1")
def level_distribution(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).groupBy("l").agg(F.count(F.lit(1)).alias("n"))


@query("select segment_id, seq, t - coalesce(lag(t) over (partition by segment_id order by seq), 0) delta from logs")
def ts_delta(spark, d):  # noqa: ANN001, ANN201
    return segments.deltas(event_logs(spark, d)).select("segment_id", "seq", "delta")


@query("""select segment_id, count(*) > 1 and coalesce(min(delta) = max(delta), false) as constant
  from (select segment_id, t - lag(t) over (partition by segment_id order by seq) delta from logs) group by 1""")
def constant_delta(spark, d):  # noqa: ANN001, ANN201
    return segments.constant_delta(event_logs(spark, d))


@query("select segment_id, seq, t restored from logs")
def ts_rebuild(spark, d):  # noqa: ANN001, ANN201
    only = segments.deltas(event_logs(spark, d)).select("segment_id", "seq", "delta")
    return segments.restore(only).select("segment_id", "seq", "restored")


@query("select segment_id, s, row_number() over (partition by segment_id order by min(seq)) - 1 svc_id from logs group by 1, 2")
def service_dictionary(spark, d):  # noqa: ANN001, ANN201
    return segments.service_dictionary(event_logs(spark, d)).withColumn("svc_id", F.col("svc_id").cast("long"))


@query(f"""with {LOGS_SQL}, r as (select *, case when l = lag(l) over (partition by segment_id order by seq) then 0 else 1 end c from logs),
  g as (select *, sum(c) over (partition by segment_id order by seq) run from r),
  k as (select *, (row_number() over (partition by segment_id, run order by seq) - 1) // 16 block from g)
  select segment_id, seq, min(seq) over (partition by segment_id, run, block) ref_seq from k""")
def reference_rows(spark, d):  # noqa: ANN001, ANN201
    return segments.reference_rows(event_logs(spark, d), 16, "l").select("segment_id", "seq", "ref_seq")


def _answers(per_keyword: Callable[[str], DataFrame], column: str) -> DataFrame:
    out = None
    for k in KEYWORDS:
        one = per_keyword(k).select(F.lit(k).alias("keyword"), column)
        out = one if out is None else out.unionByName(one)
    return out


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    logs = event_logs(spark, d)
    return segments.summaries(logs).join(segments.trigram_index(logs), "segment_id")


_LEVEL_OF = "case when upper('{k}') in ('D','DEBUG') then 'D' when upper('{k}') in ('I','INFO') then 'I' when upper('{k}') in ('W','WARN','WARNING') then 'W' when upper('{k}') in ('E','ERR','ERROR') then 'E' end"
_MAY = " union all ".join(
    f"""select '{k}' keyword, coalesce(bool_or(bit or possible), false) may_exist from (select segment_id, max(t) mx, min(t) mn, bool_or(coalesce(l = {_LEVEL_OF.format(k=k)}, false)) bit,
    length('{k}') < 3 or ({" and ".join([f"bool_or(contains(s,'{k[i : i + 3]}') or contains(l,'{k[i : i + 3]}') or contains(m,'{k[i : i + 3]}'))" for i in range(len(k) - 2)] or ["true"])}) possible
    from logs group by 1) where mx >= {START} and mn <= {END}"""
    for k in KEYWORDS
)


@query(f"with {LOGS_SQL} {_MAY}")
def may_exist_keyword(spark, d):  # noqa: ANN001, ANN201
    meta = cut(_metadata(spark, d))
    return _answers(lambda k: manifest.may_exist(meta, START, END, k), "may_exist")


@query(f"""with {LOGS_SQL}, {_SEG} select k keyword, coalesce(bool_or(level_mask & b <> 0), false) may_exist from segs,
  (values ('WARN', 4), ('W', 4), ('ERROR', 8), ('DEBUG', 1)) x(k, b) where max_ts >= {START} and min_ts <= {END} group by 1""")
def may_exist_levels(spark, d):  # noqa: ANN001, ANN201
    segs = segments.summaries(event_logs(spark, d)).filter(overlaps(START, END))
    bits = [F.coalesce(F.bool_or(manifest.has_level(manifest.level_alias(k))), F.lit(False)).alias(k) for k in ("WARN", "W", "ERROR", "DEBUG")]
    return segs.agg(*bits).unpivot([], ["WARN", "W", "ERROR", "DEBUG"], "keyword", "may_exist")


class _Dying(LogStore):
    """A writer that dies at one step of a write."""

    class Killed(Exception):
        pass

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig, step: str) -> None:
        super().__init__(spark, path, config)
        self.step = step

    def _die(self, step: str) -> None:
        if step == self.step:
            raise self.Killed(step)

    def _log(self, rows, batch):  # noqa: ANN001, ANN202
        self._die("claimed")
        size = super()._log(rows, batch)
        self._die("logged")
        return size

    def _register(self, *args, **more):  # noqa: ANN002, ANN003, ANN202
        self._die("written")
        super()._register(*args, **more)

    def _clean(self) -> None:
        self._die("registered")
        super()._clean()


@query("select event_id idx, epoch_us(ts) // 1000 t, 'svc-' || (user_id % 8) s, case event_type when 'error' then 'E' when 'signup' then 'W' when 'view' then 'D' else 'I' end l, 'User ' || user_id || ' did ' || event_type || ' props ' || props m from events")
def recovered_store(spark, d):  # noqa: ANN001, ANN201
    """All events, appended in ten batches by writers that die at each step of a write in turn and are replayed: each row once, in order."""
    logs = cut(event_logs(spark, d).select("seq", "t", "s", "l", "m"))
    n, batches = logs.count(), 10
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    config = StoreConfig(max_buffer_lines=max(1, n // 4))
    for k in range(batches):
        low, high = n * k // batches, n * (k + 1) // batches
        rows = logs.filter((F.col("seq") >= low) & (F.col("seq") < high)).orderBy("seq").drop("seq")
        step = ("claimed", "logged", "written", "registered")[k % 4]
        try:
            dying = _Dying(spark, path, config, step)
            dying.append_batch(rows, f"batch-{k}")
            if k > 4:
                dying.flush()
        except _Dying.Killed:
            pass
        LogStore(spark, path, config).append_batch(rows, f"batch-{k}")
    store = LogStore(spark, path, config)
    stored = store.rows().select(F.lit(0).alias("w"), "segment_id", "seq", "t", "s", "l", "m")
    waiting = store.buffered().select(F.lit(1).alias("w"), F.col("b").alias("segment_id"), F.col("i").alias("seq"), "t", "s", "l", "m")
    return numbered(stored.unionByName(waiting), ["w", "segment_id", "seq"]).select("idx", "t", "s", "l", "m")


# Parsing.
def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_lines").select("raw_id", "ts", "service", "message")


_TRIM = r"regexp_replace(message, '^\s+|\s+$', '', 'g')"
_INFER = "case when regexp_matches({m}, 'ERROR|Error|error') then 'E' when regexp_matches({m}, 'WARN|Warn|warn') then 'W' when regexp_matches({m}, 'DEBUG|Debug') then 'D' else 'I' end"
_PARSE = f"""with x as (select raw_id, ts, service, {_TRIM} line from raw_lines where {_TRIM} <> ''),
j as (select *, case when line[1] = '{{' and line[-1] = '}}' and json_valid(line) then line end js from x),
k as (select *, [json_type(js, '$.' || f) for f in ['t', 'ts', 'timestamp']] nums, [json_type(js, '$.' || f) for f in ['s', 'l', 'm']] short, [json_type(js, '$.' || f) for f in ['service', 'level', 'message']] long from j),
p as (select *, js->>'$.t' t0, js->>'$.s' s0, js->>'$.l' l0, js->>'$.m' m0, js->>'$.timestamp' t1, js->>'$.ts' t2, js->>'$.service' s1, js->>'$.level' l1, js->>'$.message' m1 from k),
r as (select *, case when nums[1] = 'UBIGINT' and short = ['VARCHAR', 'VARCHAR', 'VARCHAR'] then 'compact'
  when js is not null and len(list_filter(nums[2:3], lambda y: y not in ('UBIGINT', 'NULL'))) = 0 and len(list_filter(short || long, lambda y: y not in ('VARCHAR', 'NULL'))) = 0 then 'standard'
  when contains(line, 'HTTP/') then 'nginx' else 'fallback' end as rule from p)
select raw_id, rule,
  case rule when 'compact' then try_cast(t0 as bigint) when 'standard' then coalesce(try_cast(t2 as bigint), try_cast(t1 as bigint), ts) else ts end t,
  case rule when 'compact' then s0 when 'standard' then coalesce(s0, s1, service) when 'nginx' then 'nginx' else service end s,
  case rule when 'compact' then l0 when 'standard' then coalesce(l0, l1, 'I') when 'nginx' then 'I' else {_INFER.format(m="line")} end l,
  case rule when 'compact' then m0 when 'standard' then coalesce(m0, m1, line) else line end m
from r"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(_lines(spark, d), F.col("message"), F.col("ts"), F.col("service"), keep=("raw_id",))


@query(_PARSE)
def parse_raw_lines(spark, d):  # noqa: ANN001, ANN201
    return _parsed(spark, d)


def _rule(name: str, rule: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _parsed(spark, d).filter(F.col("rule") == rule)

    f.__name__ = name
    query(_PARSE + f" where rule = '{rule}'")(f)


_rule("parse_compact_json", "compact")
_rule("parse_standard_json", "standard")
_rule("parse_nginx", "nginx")
_rule("parse_fallback", "fallback")


@query(f"with x as (select doc_id, unnest(string_split(text, chr(10))) line from documents) select doc_id, {_INFER.format(m='line')} l, count(*) n from x group by 1, 2")
def infer_level_documents(spark, d):  # noqa: ANN001, ANN201
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", infer_level(F.col("line")).alias("l")).agg(F.count(F.lit(1)).alias("n"))


@query("select seq, t, s, l, m from logs")
def wal_replay(spark, d):  # noqa: ANN001, ANN201
    # every row as a record of the log, with a broken copy of it beside; only whole records come back
    logs = event_logs(spark, d)
    record = F.to_json(F.struct("t", F.concat_ws("|", "seq", "s").alias("s"), "l", "m"))
    lines = logs.select(F.explode(F.array(record, F.substr(record, F.lit(1), F.length(record) - 9), F.lit("  "))).alias("value"))
    back = parse_wal(lines).filter("bad is null")
    part = F.split("s", r"\|")
    return back.select(part[0].cast("long").alias("seq"), "t", part[1].alias("s"), "l", "m")


@query(f"""select i seq, {BASE_T} + 100 * i t, 'app' s, case when contains(m, 'ERROR') then 'E' when contains(m, 'WARN') then 'W' else 'I' end l, m || ' [seq=' || i || ']' m from (
  select i, ['User login successful', 'Connection timeout after 3000ms', 'Query executed in 45ms', 'Cache miss for key user:12345', 'Payment processed: $99.99',
  'Health check passed', 'ERROR: null pointer exception at line 42', 'WARN: retry attempt 3/3', 'Config reloaded successfully'][1 + i % 9] m from range(5000) t(i))""")
def generate_log_lines(spark, d):  # noqa: ANN001, ANN201
    return generate_lines(spark, 5000, BASE_T)


# Tokens.
_TOKENS = r"regexp_extract_all(m, '\s|[\pL\pN_.:/-]+|[^\s\pL\pN_.:/-]')"
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TYPE = rf"""case when regexp_full_match({{t}}, '\s+') then 's'
  when regexp_full_match({{t}}, '{_OCT}(\.{_OCT}){{{{3}}}}:(0|[1-9][0-9]{{{{0,4}}}})') and try_cast(split_part({{t}}, ':', 2) as int) < 65536 then 'P'
  when regexp_full_match({{t}}, '{_OCT}(\.{_OCT}){{{{3}}}}') then 'I' when regexp_full_match({{t}}, '[0-9]{{{{6}}}}') then 'T'
  when regexp_full_match({{t}}, 'blk_(0|-?[1-9][0-9]{{{{0,18}}}})') and try_cast({{t}}[5:] as bigint) is not null then 'B'
  when regexp_full_match({{t}}, '0x(0|[1-9a-fA-F][0-9a-fA-F]{{{{0,15}}}})') then 'H'
  when regexp_full_match({{t}}, '0|-?[1-9][0-9]{{{{0,18}}}}') and try_cast({{t}} as bigint) is not null then 'N'
  when {{t}}[1] = '/' and strlen({{t}}) > 1 then 'h' when regexp_full_match({{t}}, '[!-/:-@\[-`{{{{-~]+') then 'C' else 'W' end"""


def _type(t: str) -> str:
    return _TYPE.format(t=t)


@query(f"select seq, {_TOKENS} tokens from logs")
def tokenize_messages(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).select("seq", tokenize(F.col("m")).alias("tokens"))


@query(f"select seq, array_to_string(list_transform({_TOKENS}, lambda x: {_type('x')}), '') type_seq from logs")
def type_sequences(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).select("seq", type_sequence(tokenize(F.col("m"))).alias("type_seq"))


_PTYPE = "case {c} when 'P' then 'ipv4_port' when 'I' then 'ipv4' when 'T' then 'timestamp' when 'B' then 'block_id' when 'H' then 'hex' when 'N' then 'integer' when 'h' then 'path' else 'string' end"


@query(f"""with x as (select line_id, unnest(regexp_extract_all(message, '\\s|[\\pL\\pN_.:/-]+|[^\\s\\pL\\pN_.:/-]')) tok from log_lines)
  select ptype, count(*) n, count(distinct tok) n_distinct from (select tok, {_PTYPE.format(c=f"({_type('tok')})")} ptype from x) group by 1""")
def typed_params(spark, d):  # noqa: ANN001, ANN201
    # one row per distinct token first: the types of a token are found once
    tokens = table(spark, d, "log_lines").select(F.explode(tokenize(F.col("message"))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("k"))
    return tokens.groupBy(param_type(F.col("tok")).alias("ptype")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


# Templates.
_MINED = f"""with {LOGS_SQL}, a as (select segment_id, seq, {_TOKENS} toks from logs),
b as (select segment_id, seq, unnest(toks) tok, unnest(range(len(toks))) pos, array_to_string(list_transform(toks, lambda x: {_type('x')}), '') ts, array_to_string(toks[1:4], chr(0)) head from a),
p1 as (select segment_id, ts, pos, min(tok) lo, max(tok) hi from b group by 1, 2, 3),
g1 as (select segment_id, ts, count(*) filter (lo = hi) < greatest(count(*) // 4, 2) split from p1 group by 1, 2),
c as (select b.*, case when split then head else '' end sub from b join g1 using (segment_id, ts)),
p2 as (select segment_id, ts, sub, pos, min(tok) lo, max(tok) hi from c group by 1, 2, 3, 4),
g2 as (select segment_id, ts, sub, string_agg(case when lo = hi then lo else '<*>' end, '' order by pos) signature from p2 group by 1, 2, 3),
w as (select distinct segment_id, seq, ts, sub from c),
r as (select segment_id, seq, signature, ts, sub from w join g2 using (segment_id, ts, sub)),
t as (select segment_id, signature, min(seq) first_seq, count(*) row_count from r group by 1, 2),
tpl as (select segment_id, cast(row_number() over (partition by segment_id order by first_seq) - 1 as int) pat_id, signature, row_count from t)
"""


@query(_MINED + "select * from tpl")
def mined_templates(spark, d):  # noqa: ANN001, ANN201
    found, _ = templates.mine(event_logs(spark, d))
    return found.select("segment_id", "pat_id", templates.signature_text(F.col("signature")).alias("signature"), "row_count")


@query(_MINED + """, v as (select c.segment_id, c.seq, c.pos, c.tok from c join p2 using (segment_id, ts, sub, pos) where lo <> hi)
  select r.segment_id, r.seq, tpl.pat_id, coalesce(string_agg(v.tok, '|' order by v.pos), '') params from r join tpl using (segment_id, signature) left join v on r.segment_id = v.segment_id and r.seq = v.seq group by 1, 2, 3""")
def template_params(spark, d):  # noqa: ANN001, ANN201
    _, records = templates.mine(event_logs(spark, d))
    return records.select("segment_id", "seq", "pat_id", F.array_join(F.transform("params", lambda p: p["value"]), "|").alias("params"))


@query("select segment_id, seq, m from logs")
def template_rebuild(spark, d):  # noqa: ANN001, ANN201
    found, records = templates.mine(event_logs(spark, d))
    return templates.rebuild(records, found)


@query(_MINED + """, q as (select *, (length(signature) - length(replace(signature, '<*>', ''))) // 3 params from tpl)
  select segment_id, count(*) n_templates, count(*) filter (row_count = 1) n_single, max(row_count) most_rows,
    count(*) filter (replace(signature, '<*>', '') = '') n_all_param, avg(params) mean_params, cast(list_sort(list(params))[1 + count(*) // 2] as int) median_params from q group by 1""")
def template_quality(spark, d):  # noqa: ANN001, ANN201
    found, _ = templates.mine(event_logs(spark, d))
    return templates.quality(found)


@query(_MINED + "select segment_id, count(*) n_patterns from tpl group by 1")
def pattern_count_by_segment(spark, d):  # noqa: ANN001, ANN201
    found, _ = templates.mine(event_logs(spark, d))
    return found.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_patterns"))


@query(_MINED + """, lit as (select distinct r.segment_id, r.signature, lower(lo) keyword from p2 join (select distinct segment_id, ts, sub, signature from r) r using (segment_id, ts, sub) where lo = hi and strlen(lower(lo)) >= 3)
  select distinct lit.segment_id, keyword, pat_id from lit join tpl using (segment_id, signature)""")
def keyword_map(spark, d):  # noqa: ANN001, ANN201
    found, _ = templates.mine(event_logs(spark, d))
    return templates.keyword_map(found)


@query(_MINED + f"""select segment_id, cast(pat_id as int) pat_id, pat_id - coalesce(lag(pat_id) over (partition by segment_id order by seq), 0) delta, seq from r join tpl using (segment_id, signature)""")
def pat_delta(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    _, records = templates.mine(event_logs(spark, d))
    w = Window.partitionBy("segment_id").orderBy("seq")
    return records.select("segment_id", "pat_id", (F.col("pat_id") - F.coalesce(F.lag("pat_id").over(w), F.lit(0))).alias("delta"), "seq")


_ATLEAST = " union all ".join(
    f"""select '{k}' keyword, cast(coalesce(sum(greatest(coalesce(sure, 0), case when lv then 1 else 0 end)), 0) as bigint) at_least from (
    select s.segment_id, s.min_ts, s.max_ts, coalesce(s.level_mask & case {_LEVEL_OF.format(k=k)} when 'D' then 1 when 'I' then 2 when 'W' then 4 when 'E' then 8 end <> 0, false) lv,
      (select sum(row_count) from tpl where tpl.segment_id = s.segment_id and exists (select 1 from lits where lits.segment_id = tpl.segment_id and lits.signature = tpl.signature and contains(lo, '{k}'))) sure
    from segs s) where min_ts >= {START} and max_ts <= {END}"""
    for k in KEYWORDS
)


@query(_MINED + f", lits as (select distinct r.segment_id, r.signature, lo from p2 join (select distinct segment_id, ts, sub, signature from r) r using (segment_id, ts, sub) where lo = hi), {_SEG} " + _ATLEAST)
def count_at_least(spark, d):  # noqa: ANN001, ANN201
    logs = event_logs(spark, d)
    found, _ = templates.mine(logs)
    found, segs = cut(found), cut(segments.summaries(logs))
    return _answers(lambda k: manifest.count_at_least(segs, found, START, END, k), "at_least")


@query(f"""with x as (select segment_id, original_idx, any_value(ts_delta) ts_delta, any_value(pat_id) pat_id, any_value(svc_id) svc_id, first(params) params from template_records group by 1, 2)
  select x.segment_id, x.original_idx, sum(ts_delta) over (partition by x.segment_id order by x.original_idx) t, x.pat_id, len(x.params) n_params,
    array_to_string([p.text for p in t.parts if not p.is_param], ' ') literals, services[svc_id + 1] service
  from x left join templates t on x.pat_id = t.pat_id left join segments g on x.segment_id = g.segment_id""")
def stored_records(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    r = table(spark, d, "template_records").select("segment_id", "original_idx", "ts_delta", "pat_id", "svc_id", F.size("params").alias("n_params"))
    once = r.groupBy("segment_id", "original_idx").agg(F.first("ts_delta").alias("ts_delta"), F.first("pat_id").alias("pat_id"), F.first("svc_id").alias("svc_id"), F.first("n_params").alias("n_params"))
    w = Window.partitionBy("segment_id").orderBy("original_idx").rowsBetween(Window.unboundedPreceding, 0)
    literals = F.array_join(F.transform(F.filter("parts", lambda p: ~p["is_param"]), lambda p: p["text"]), " ")
    names = table(spark, d, "templates").select("pat_id", literals.alias("literals"))
    services = table(spark, d, "segments").select("segment_id", "services")
    return once.join(names, "pat_id", "left").join(services, "segment_id", "left").select(
        "segment_id", "original_idx", F.sum("ts_delta").over(w).alias("t"), "pat_id", F.when(F.col("n_params") >= 0, F.col("n_params").cast("long")).alias("n_params"), "literals", F.get("services", F.col("svc_id")).alias("service")
    )


@query("select distinct segment_id, pat_id from template_records where pat_id in (3, 7, 100)")
def segments_with_pattern(spark, d):  # noqa: ANN001, ANN201
    ids = cut(segments.pattern_ids(table(spark, d, "template_records")))
    found = None
    for p in (3, 7, 100):
        one = ids.filter(segments.may_contain_pattern(p)).select("segment_id", F.lit(p).alias("pat_id"))
        found = one if found is None else found.unionByName(one)
    return found


@query(r"""with w as (select distinct pat_id from (select pat_id, unnest(string_split_regex(lower(p.text), '\s+')) word from (select pat_id, unnest(parts) p from templates) where not p.is_param) where word = 'session')
  select segment_id, count(*) n_records from template_records semi join w using (pat_id) group by 1""")
def keyword_segments(spark, d):  # noqa: ANN001, ANN201
    words = templates.keyword_map(table(spark, d, "templates"), ())
    return templates.segments_of_keyword("session", words, table(spark, d, "template_records").select("segment_id", "pat_id"))


@query("""select segment_id, seq, case when count(*) over w <= 1000 and sum(strlen(m)) over w <= 100000 then 0 else cast((seq % 1024) // 256 as int) end chunk from logs window w as (partition by segment_id)""")
def chunk_policy(spark, d):  # noqa: ANN001, ANN201
    logs = event_logs(spark, d).withColumn("seq_in_segment", F.col("seq") % 1024)
    return segments.chunked(logs, 256, 1000, 100_000).select("segment_id", "seq", "chunk")


# Scalar functions.
@query("select seq, (t // 1000) || '.' || (t % 1000) ts, '[' || (t // 1000) || '.' || (t % 1000) || '] [' || s || '] ' || l || ': ' || m line from logs")
def format_lines(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).select("seq", scalars.format_ts(F.col("t")).alias("ts"), scalars.format_line(F.col("t"), F.col("s"), F.col("l"), F.col("m")).alias("line"))


@query("""select seq, case when z < 0 then 10 when z = 0 then 1 else cast(floor(log2(z) / 7) as int) + 1 end size, (z + 4095) // 4096 * 4096 aligned, (z + 4095) // 4096 * 4096 - z padding
  from (select seq, seq * 3 z from logs)""")
def varint_sizes(spark, d):  # noqa: ANN001, ANN201
    z = F.col("seq") * 3
    return event_logs(spark, d).select("seq", scalars.varuint_size(z).alias("size"), scalars.align_up(z).alias("aligned"), scalars.padding_needed(z).alias("padding"))


@query("select distinct segment_id, 'segment-' || lpad(cast(segment_id as varchar), 8, '0') || '.seg' file_name, cast(segment_id as int) parsed from logs")
def segment_names(spark, d):  # noqa: ANN001, ANN201
    name = scalars.segment_name(F.col("segment_id"))
    return event_logs(spark, d).select("segment_id").distinct().select("segment_id", name.alias("file_name"), scalars.parse_segment_name(name).alias("parsed"))


def _crc(text: Column) -> Column:
    return scalars.crc32(text)


@query()
def crc32_messages(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).select("seq", _crc(F.col("m")).alias("crc"))


_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(m) + 1), lambda i: ascii(m[i])::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
_MIXED = "(xor({h}, {h} // 8589934592::uhugeint) * {f}::uhugeint) % 18446744073709551616::uhugeint"


@query(f"""with {LOGS_SQL}, h as (select seq, {_FNV} h from logs),
  a as (select *, {_MIXED.format(h="((h + 1) % 18446744073709551616::uhugeint)", f=0xFF51AFD7ED558CCD)} a from h), b as (select *, {_MIXED.format(h="a", f=0xC4CEB9FE1A85EC53)} b from a)
  select seq, cast(case when h >= 9223372036854775808::uhugeint then h::hugeint - 18446744073709551616::hugeint else h::hugeint end as bigint) hash, cast(xor(b, b // 8589934592::uhugeint) % 512 as int) bit from b""")
def fnv_hash(spark, d):  # noqa: ANN001, ANN201
    return event_logs(spark, d).select("seq", scalars.hash_path("m").alias("hash"), scalars.bloom_hash("m", F.lit(1)).alias("bit"))


@query(f"""with recursive {LOGS_SQL},
  x as materialized (select s stream, t, row_number() over (partition by s order by seq) rn, strlen(json_object('t', t, 's', s, 'l', l, 'm', m)) + 1 nb from logs),
  r as (select stream, t, rn, 1 lines, nb used, 0::bigint flush from x where rn = 1
    union all select x.stream, x.t, x.rn, case when full_ then 1 else lines + 1 end, case when full_ then nb else used + nb end, case when full_ then flush + 1 else flush end
    from (select *, lines >= 1000 or used >= 65536 full_ from r) r join x on x.stream = r.stream and x.rn = r.rn + 1)
  select stream, flush, count(*) n, min(t) min_ts from r group by 1, 2""")
def dual_threshold_segments(spark, d):  # noqa: ANN001, ANN201
    logs = event_logs(spark, d).withColumn("stream", F.col("s"))
    return segments.dual_threshold(logs, 1000, 65_536).groupBy("stream", "flush").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min_ts"))


@query(_MINED + """, v as (select c.segment_id, sum(strlen(c.tok) + 1) b, count(distinct c.seq) from c join p2 using (segment_id, ts, sub, pos) where lo <> hi group by 1),
  one as (select segment_id, signature, min((ts, sub)) k from r group by 1, 2),
  lit as (select one.segment_id, sum(case when lo = hi then strlen(lo) else 0 end + 2) b from one join p2 on p2.segment_id = one.segment_id and (p2.ts, p2.sub) = one.k group by 1),
  raw as (select segment_id, sum(strlen(json_object('t', t, 's', s, 'l', l, 'm', m)) + 1) b from logs group by 1)
  select segment_id, cast(raw.b as bigint) raw_bytes, cast(lit.b as bigint) literal_bytes, cast(coalesce(v.b, 0) as bigint) param_bytes, raw.b / (lit.b + coalesce(v.b, 0)) ratio from raw join lit using (segment_id) left join v using (segment_id)""")
def compression_report(spark, d):  # noqa: ANN001, ANN201
    """Raw bytes, bytes as templates and parameters, and their ratio, per segment."""
    logs = event_logs(spark, d)
    found, records = templates.mine(logs)
    literal = found.groupBy("segment_id").agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["text"]) + 2)).alias("literal_bytes"))
    params = records.groupBy("segment_id").agg(F.sum(F.aggregate("params", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["value"]) + 1)).alias("param_bytes"))
    sizes = segments.summaries(logs).select("segment_id", "raw_bytes").join(literal, "segment_id").join(params, "segment_id")
    return sizes.withColumn("ratio", manifest.compression_ratio(F.col("raw_bytes"), F.col("literal_bytes") + F.col("param_bytes")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
