"""Hot keys, timestamps and log entries: edge cases and brute force on small fixtures."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logstrata.operators import entries as E
from logstrata.operators.hotkeys import hot_keys, key_summary
from logstrata.operators.timestamps import extend_dictionary, instants, line_instants, normalise, restored
from logstrata.plans import problems


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


# -- hot keys


def test_hot_keys_count_nulls_and_ties(spark):
    rows = [("a",)] * 50 + [("b",)] * 4 + [(None,)] * 43 + [("c",)] * 3
    df = spark.createDataFrame(rows, "k string").withColumn("n_rows", F.lit(1)).withColumn("key", F.lit("clash"))
    assert {r.key for r in hot_keys(df, F.col("k")).collect()} == {"a", "b"}  # b is exactly 4 %
    got = {r.key: r.n_rows for r in key_summary(df, F.col("k")).collect()}
    assert got == {"a": 50, "b": 4, None: 43, "c": 3}
    assert hot_keys(df.limit(0), F.col("k")).count() == 0 and key_summary(df.limit(0), F.col("k")).count() == 0


def test_key_summary_levels_and_times(spark):
    rows = [("a", "WARN", 5), ("a", " w ", None), ("a", "?", 1), ("a", None, 9), ("b", "err", None)]
    df = spark.createDataFrame(rows, "k string, l string, t long")
    got = {r.key: r.asDict() for r in key_summary(df, F.col("k"), F.col("l"), F.col("t")).collect()}
    assert (got["a"]["n_warn"], got["a"]["n_other_level"], got["a"]["first_t"], got["a"]["last_t"]) == (2, 2, 1, 9)
    assert (got["b"]["n_error"], got["b"]["first_t"]) == (1, None)


def test_instants_are_restored_from_differences(spark):
    rows = [(1, 0, 1000, "a"), (1, 1, -300, "b"), (1, 1, -300, "b"), (1, 3, 50, "a"), (1, 4, None, "b"), (2, 2, 5, "a"), (2, 0, 7000, None), (None, 0, 9, "a"), (1, None, 9, "b")]
    df = spark.createDataFrame(rows, "seg long, at int, diff long, k string").repartition(3)
    timed = restored(df, F.col("seg"), F.col("at"), F.col("diff"))
    assert sorted(((r.seg or 0, -1 if r.at is None else r.at, r.t) for r in timed.collect()), key=repr) == sorted(
        [(1, 0, 1000), (1, 1, 700), (1, 1, 700), (1, 3, 750), (1, 4, 750), (2, 2, 7005), (2, 0, 7000), (0, 0, None), (1, -1, None)], key=repr)
    got = {r.key: (r.n_rows, r.first_t, r.last_t) for r in key_summary(timed, F.col("k"), None, F.col("t")).collect()}
    assert got == {"a": (4, 750, 7005), "b": (4, 700, 750), None: (1, 7000, 7000)}


def test_template_times_lie_in_their_segments(spark):
    d = "/root/testdata/sf0.001"
    low, high = spark.read.parquet(f"{d}/segments.parquet").agg(F.min("min_ts"), F.max("max_ts")).first()
    got = problems.p2_templates(spark, d).collect()
    assert min(r.first_t for r in got) == low and max(r.last_t for r in got) == high
    assert sum(r.n_rows for r in got) == spark.read.parquet(f"{d}/template_records.parquet").count()


def test_service_times_are_the_lines_own(spark):
    d = "/root/testdata/sf0.001"
    got = {r.key: r for r in problems.p2_service_times(spark, d).collect()}
    arrival = {r.key: r for r in problems.p2_services(spark, d).collect()}
    assert {k: r.n_rows for k, r in got.items()} == {k: r.n_rows for k, r in arrival.items()} and {k: r.n_error for k, r in got.items()} == {k: r.n_error for k, r in arrival.items()}
    times = {r.line_id: r.t for r in problems.p4_found(spark, d).collect()}
    own = {}
    for r in spark.read.parquet(f"{d}/log_lines.parquet").select("line_id", "service", "ts").collect():
        t = int(r.ts) if r.ts and len(r.ts) == 13 and r.ts.isdigit() else times.get(r.line_id)
        if t is not None:
            own.setdefault(r.service, []).append(t)
    assert {k: (r.first_t, r.last_t) for k, r in got.items()} == {k: (min(own[k]), max(own[k])) if k in own else (None, None) for k in got}


# -- timestamps

T = utc(2024, 3, 31, 12, 0, 5)
CASES = [
    ("2024-03-31T12:00:05Z", None, [T]),
    ("  [2024-03-31 14:00:05 CEST] ", "Asia/Tokyo", [T]),
    ("2024-03-31T14:00:05.123456789+02:00", None, [T + 123]),
    ("31.03.2024 14:00:05", "Europe/Berlin", [T]),
    ("03/31/2024 02:00:05 PM", "Europe/Berlin", [T]),
    ("03/31/2024 12:00:05 AM", "UTC", [utc(2024, 3, 31, 0, 0, 5)]),
    ("31/Mar/2024:14:00:05 +0200", None, [T]),
    ("Sun, 31 Mar 2024 17:30:05 +0530", None, [T]),
    ("20240331140005007", "Europe/Berlin", [T + 7]),
    ("240331 140005", "Europe/Berlin", [T]),
    ("2024-03-31 14:00", "Europe/Berlin", [T - 5000]),
    ("2024-03-31 14:00:05,250", "Europe/Berlin", [T + 250]),
    (str(T // 1000), None, [T]),
    (str(T), None, [T]),
    (f"{T}999", None, [T]),
    (f"{T}999999", None, [T]),
    (f"{T // 1000}.250", None, [T + 250]),
    ("2024-03-31 02:30:00", "Europe/Berlin", []),  # a wall time that never was
    ("2024-10-27 02:30:00", "Europe/Berlin", [utc(2024, 10, 27, 0, 30), utc(2024, 10, 27, 1, 30)]),
    ("2024-10-27 02:30:00 CEST", "Europe/Berlin", [utc(2024, 10, 27, 0, 30)]),
    ("2024-03-31 12:00:05", None, []),
    ("2024-03-31 12:00:05", "No/Where", []),
    *((x, "UTC", []) for x in (None, "", "   ", "N/A", "-", "null", "<ts>", "0000-00-00 00:00:00", "25:61:61", "20240-5-1", "2024-13-41T07:00:00Z", "13/13/2024 01:00:00 AM", "x" * 100_000)),
]


@pytest.mark.parametrize("text,zone,want", CASES)
def test_instants(text, zone, want):
    assert instants(text, zone) == want


def test_year_is_the_latest_not_after_arrival(spark):
    lines = spark.createDataFrame(
        [(1, 1, "Dec 31 23:59:58", utc(2025, 1, 1, 0, 0, 1)), (2, 1, "Jan  1 00:00:00", utc(2025, 1, 1, 0, 0, 1)), (3, 1, "Feb 29 10:00:00", utc(2023, 5, 1)),
         (4, 2, "2024-10-27 02:30:00", utc(2024, 10, 27, 0, 45)), (5, 2, "2024-10-27 02:30:00", utc(2024, 10, 27, 9)), (6, 9, "2024-10-27 02:30:00", utc(2024, 10, 27, 9)),
         (7, None, None, None), (5, 2, "2024-10-27 02:30:00", utc(2024, 10, 27, 9)), (8, 9, "2024-01-01T00:00:00Z", None)],
        "line_id long, stream_id long, ts string, recv_t long",
    ).withColumn("raw", F.lit("clash")).withColumn("zone", F.lit("clash"))
    zones = spark.createDataFrame([(1, "UTC"), (2, "Europe/Berlin"), (3, None), (2, "Europe/Berlin")], "source long, zone string")
    get = lambda df: sorted((r.line_id, r.t) for r in normalise(df, zones, F.col("ts"), F.col("stream_id"), F.col("recv_t"), {"line_id": F.col("line_id")}).collect())
    late = utc(2024, 10, 27, 1, 30)
    assert get(lines) == [(1, utc(2024, 12, 31, 23, 59, 58)), (2, utc(2025, 1, 1)), (3, utc(2020, 2, 29, 10)), (4, utc(2024, 10, 27, 0, 30)), (5, late), (5, late), (8, utc(2024, 1, 1))]
    assert get(lines.limit(0)) == []


def test_every_line_keeps_its_place(spark):
    rows = [(1, 1, str(T), T), (2, 1, "2024-03-31 14:00:05", T), (3, 1, None, T), (4, 1, "N/A", T), (5, 1, "2024-13-41T07:00:00Z", T), (6, None, f" {T} ", None), (2, 1, "2024-03-31 14:00:05", T)]
    lines = spark.createDataFrame(rows, "line_id long, stream_id long, ts string, recv_t long")
    zones = spark.createDataFrame([(1, "Europe/Berlin")], "source long, zone string")
    got = line_instants(lines, zones, F.col("ts"), F.col("stream_id"), F.col("recv_t"), {"line_id": F.col("line_id")}).collect()
    assert sorted((r.line_id, r.t or 0) for r in got) == [(1, T), (2, T), (2, T), (3, 0), (4, 0), (5, 0), (6, T)]


def test_dictionary_grows_by_what_is_new(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "UTC", None), ("x", None, None)], "raw string, zone string, hint int")
    path = str(tmp_path / "dictionary")
    assert extend_dictionary(spark, path, rows).count() == 2
    more = rows.unionByName(spark.createDataFrame([("2024-01-02 00:00:00", "UTC", None)], rows.schema))
    assert extend_dictionary(spark, path, more).count() == 3
    spark.read.parquet(path).write.mode("append").parquet(path)  # as another run at the same time would
    assert extend_dictionary(spark, path, more).count() == 3


# -- log entries

RAW = [
    "  at nowhere", "2025-01-02 10:00:00,001 WARN  [w-1] net.Dialer - first message here", "Traceback:", "   ", None,
    "2025-01-02 10:00:01,002+0100 ERROR [w-2] raft.Peer - another (INFO) text \x1b[31mred\x1b[0m\r", "  > 2025-01-02 10:00:00,001 ERROR [w-0] authz - quoted", "",
    "2025-01-02 10:00:02,003 DEBUG [main] kv-shard - a b c d e f", "2025-01-02 10:00:03,004 info  [w-9] gc - short", "2025-01-02 10:00:04,005 FATAL [w-9] gc - x y",
]


def raw(spark, lines, copies=1):
    rows = [(f, i + 1, 1735812100000 + 1000 * i, x) for f in range(copies) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "file long, no int, at long, msg string").withColumn("t", F.lit("clash")).withColumn("line", F.lit("clash"))


def read(df):
    got = E.entries(df, F.col("file"), F.col("no"), F.col("at"), F.col("msg")).collect()
    return sorted((r.file_id, r.first_line, r.last_line, r.t, r.level, r.component) for r in got)


def test_entries_of_one_layout(spark):
    want = [(2, 3, utc(2025, 1, 2, 10) + 1, "W", "net.Dialer"), (6, 7, utc(2025, 1, 2, 9, 0, 1) + 2, "E", "raft.Peer"), (9, 9, utc(2025, 1, 2, 10, 0, 2) + 3, "D", "kv-shard"),
            (10, 10, utc(2025, 1, 2, 10, 0, 3) + 4, "I", "gc"), (11, 11, utc(2025, 1, 2, 10, 0, 4) + 5, "E", "gc")]
    df = raw(spark, RAW, 2)
    again = df.unionByName(df.limit(5).withColumn("at", F.col("at") + 5)).unionByName(df.limit(1).withColumn("no", F.lit(None).cast("int")))
    assert read(again) == [(f, *w) for f in (0, 1) for w in want]


def messages(df):
    got = E.entries(df, F.col("file"), F.col("no"), F.col("at"), F.col("msg")).collect()
    return {(r.file_id, r.first_line): r.message for r in got}


def test_messages_of_entries(spark):
    want = {2: "first message here\nTraceback:", 6: "another (INFO) text red\n  > 2025-01-02 10:00:00,001 ERROR [w-0] authz - quoted", 9: "a b c d e f", 10: "short", 11: "x y"}
    df = raw(spark, RAW, 2)
    assert messages(df.unionByName(df.limit(5).withColumn("at", F.col("at") + 5))) == {(f, k): m for f in (0, 1) for k, m in want.items()}


def test_a_message_spans_stretches(spark):
    n = 2 * E.STRETCH
    lines = [RAW[1], *(f"more {i}" for i in range(n - 1)), "", "  end", RAW[8], "tail", *RAW[9:]]
    got = messages(raw(spark, lines))
    assert got[(0, 1)] == "\n".join(["first message here", *lines[1 : n + 2]])
    assert got[(0, n + 3)] == "a b c d e f\ntail" and len(got) == 4


@pytest.mark.parametrize("template,line,want", [
    (("{", '"t":', "<T>", ",", '"s":', '"', E.WORD, '"', ",", '"l":', '"', "<L>", '"', ",", '"m":', '"', E.ANY, '"', "}"),
     r'{"t":1734995750723,"s":"gc","l":"I","m":"a \"b\" \u00e9, \"m\":1"}', 'a "b" é, "m":1'),
    (("{", '"level":', '"', "<L>", '"', ",", '"message":', '"', E.ANY, '"', ",", '"timestamp":', '"', "<T>", '"', ",", '"service":', '"', E.WORD, '"', E.ANY, "}"),
     '{"level": "info", "message": "x | y", "timestamp": "2025-09-07T04:59:32.009Z", "service": "sched", "n": 67}', "x | y"),
    (("ts=", "<T>", "level=", "<L>", "component=", E.WORD, "msg=", '"', E.ANY, '"'), r'ts=2025-09-07T04:59:11.337Z level=I component=gc msg="a msg=\"b\" c" n=3', 'a msg="b" c'),
    (("ts=", "<T>", "level=", "<L>", "component=", E.WORD, "msg=", E.ANY), "ts=2025-09-07T04:59:11.337Z level=I component=gc msg=a b=c d", "a b=c d"),
    (("<", "<N>", ">", "<N>", "<T>", E.WORD, E.WORD, "<N>", "-", "-", E.ANY), "<146>1 2024-12-31T23:54:00.307305Z h36 kv-shard 97 - - - idle - 5", "- idle - 5"),
    (('"', "<T>", '"', ",", '"', E.WORD, '"', ",", '"', "<L>", '"', ",", '"', E.ANY, '"'), '"2024-08-27 11:34:04","gc","I","a ""b"", c"', 'a "b", c'),
    (("<L>", "<T>", "<N>", E.WORD, ":", "<N>", "]", E.ANY), "I0304 05:13:25.437348  5037 mail.Spool:632] 7 ] left", "7 ] left"),
    (("<T>", "|", "<L>", "|", E.WORD, "|", E.ANY), "2025/04/27 08:55:53.970|NOTICE|index-builder|a|b", "a|b"),
    (("<I>", "-", "-", "[", "<T>", "]", '"', E.WORD, "/", E.WORD, "HTTP", "/", "<N>", '"', "<N>", "<N>"),
     '10.0.0.1 - - [01/Jan/2025:00:00:01 +0000] "GET /x HTTP/1.1" 200 5', '10.0.0.1 - - [01/Jan/2025:00:00:01 +0000] "GET /x HTTP/1.1" 200 5'),
])
def test_message_of_a_layout(template, line, want):
    layout = E.layouts([(template, 9)])[0]
    assert E.message_of(line, E.re.match(layout.pattern, line).end(), layout) == want


def test_entries_of_nothing(spark):
    assert read(raw(spark, ["no header", "", None, "x" * 200_000])) == []
    assert read(raw(spark, RAW).limit(0)) == []


def test_an_entry_spans_stretches(spark):
    lines = [RAW[1], *["more"] * (2 * E.STRETCH), RAW[8], "tail", *RAW[9:]]
    n = 2 * E.STRETCH + 1
    assert [(r[1], r[2]) for r in read(raw(spark, lines))] == [(1, n), (n + 1, n + 2), (n + 3, n + 3), (n + 4, n + 4)]


def test_templates_are_subsequences_of_their_lines():
    lines = [E.headers.skeleton(x) for x in RAW if x and E.headers.skeleton(x)]
    (template, n), *rest = E.headers.mine([[x for x in RAW if x and not x[0].isspace()]]).templates()
    assert n == 5 and not [t for t, _ in rest if "<L>" in t and t[0] == "<T>"]
    for x in lines:
        if x[0] == "<T>":
            left = iter(x)
            assert all(t in left for t in template if t != E.ANY)


def test_missing_year_and_severity():
    patterns = [(E.re.compile(x.pattern), x.web) for x in E.layouts([
        (("<", "<N>", ">", "<T>", E.WORD, E.WORD, "[", "<N>", "]", ":", E.ANY), 9),
        (("<I>", "-", "-", "[", "<T>", "]", '"', E.WORD, "/", E.WORD, "HTTP", "/", "<N>", '"', "<N>", "<N>"), 9),
    ])]
    at = utc(2025, 1, 1, 0, 0, 30)
    assert E.header("<12>Dec 31 23:59:59 h1 app.Main[77]: hello", at, patterns) == (utc(2024, 12, 31, 23, 59, 59), "W", "app.Main")
    assert E.header("<14>Jan  1 00:00:10 h1 app.Main[77]: hello", at, patterns) == (utc(2025, 1, 1, 0, 0, 10), "I", "app.Main")
    assert E.header('10.0.0.1 - - [01/Jan/2025:00:00:01 +0000] "GET /x HTTP/1.1" 200 5', at, patterns) == (utc(2025, 1, 1, 0, 0, 1), "I", "nginx")
    assert E.header(" <12>Dec 31 23:59:59 h1 app.Main[77]: hello", at, patterns) is None
