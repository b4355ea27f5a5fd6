"""Header layouts that the test tables don't hold, alone and mixed; and an independent reading of the tables' own."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest

from logstrata.operators import entries as E
from logstrata.operators import headers as H

COMPONENTS = ["net.Dialer", "raft.Peer", "kv-shard", "gc", "sched", "index_builder", "authz"]
LEVELS = {"DEBUG": "D", "INFO": "I", "WARN": "W", "ERROR": "E", "FATAL": "E"}
START = datetime(2025, 1, 2, 10, 0, 1, tzinfo=timezone.utc)
LAYOUTS = {
    "brackets": "[{t}] [{l}] [{c}] {m}",
    "parenthesised": "{t} ({c}) {l}: {m}",
    "tight brackets": "[{t}][{c}][{l}] {m}",
    "keys": 'time={t} host=h{n} level={l} component={c} msg="{m}"',
    "other keys": 'time={t} host=h{n} svc={c} zone=z{n} severity={l} text="{m}"',
    "bare time before keys": "{t} host=h{n} level={l} component={c} msg=\"{m}\"",
    "thread before level": "{t} [worker-{n}] {l} {c} - {m}",
    "level first": "{l} [{t}] {c}: {m}",
    "source line": "{t} {l} {c}({n}): {m}",
    "nested objects": '{{"ts": "{t}", "ctx": {{"a": {n}}}, "lvl": "{l}", "logger": "{c}", "msg": "{m}"}}',
    "bars": "{t} | {n} | {c} | {l} | {m}",
    "message before level": '{{"msg": "{m}", "level": "{l}", "time": "{t}", "logger": "{c}", "k": {n}}}',
    "no mark": "{t} {l} {c} {m}",
}


def message(rng):
    k = rng.randrange(9)
    n = rng.randrange(100_000)
    return [
        f"request tr{n:x} throttled for {n} ms", f"ledger entry {n} posted, balance unchanged", "idle", f"cache: miss for key k{n}", f"retry {n} of 5 (no ERROR seen)",
        f"disk /data/p{n}/in at {n % 100} percent", f"user=u{n} took={n}ms level=warn expected", f"see also 2023-02-01 03:04:05 in part {n}", f"{n} rows read",
    ][k]


def lines_of(name, n, rng):
    out = []
    for i in range(n):
        t = START + timedelta(seconds=i)
        level, c, m = rng.choice(list(LEVELS)), rng.choice(COMPONENTS), message(rng)
        text = LAYOUTS[name].format(t=t.strftime("%Y-%m-%d %H:%M:%S" if name in ("keys", "parenthesised") else "%Y-%m-%dT%H:%M:%SZ"), l=level, c=c, m=m, n=rng.randrange(1, 99))
        out.append((text, (int(t.timestamp() * 1000), LEVELS[level], c), m))
    return out


def shares(rows):
    """Shares of the lines whose level, component and message come out right."""
    found = E.layouts(H.mine([[x for x, _, _ in rows]]).templates())
    compiled = [(re.compile(x.pattern), x.web) for x in found]
    right = [0, 0, 0]
    for text, (t, level, c), m in rows:
        if hit := E._header(text, None, compiled):
            right[0] += hit[0][:2] == (t, level)
            right[1] += hit[0][2] == c
            right[2] += E.message_of(text, hit[1], found[hit[2]]) == m
    return [r / len(rows) for r in right]


@pytest.mark.parametrize("name", LAYOUTS)
def test_unseen_layout(name):
    assert min(shares(lines_of(name, 400, random.Random(name)))) >= 0.95


@pytest.mark.parametrize("names", [("keys", "other keys"), ("keys", "other keys", "bare time before keys"), ("brackets", "tight brackets", "level first"), tuple(LAYOUTS)])
def test_mixed_layouts(names):
    rng = random.Random(7)
    rows = [r for n in names for r in lines_of(n, 400, rng)]
    rng.shuffle(rows)
    level, component, _ = shares(rows)
    assert level >= 0.95 and component >= 0.95


def test_order_and_partitioning_do_not_matter():
    rng = random.Random(3)
    rows = [x for n in LAYOUTS for x, _, _ in lines_of(n, 60, rng)]
    whole = {x.pattern for x in E.layouts(H.mine([rows]).templates())}
    rng.shuffle(rows)
    parts = [H.mine([rows[k::5]]).clusters for k in range(5)]
    merged = E.merge_clusters([c for p in parts for c in p])
    lost = whole - {x.pattern for x in E.layouts(merged.templates())}
    assert not lost


def test_odd_lines():
    for line in ("", " ", "no time at all", "x" * 100_000, "2025-01-02 10:00:00 " + "a, " * 50_000, '{"t":1734995750723,"s":', '"' * 1000, "{" * 1000, "ts=" * 1000):
        H.skeleton(line)
    assert H.skeleton("2025-01-02 10:00:00 " + "a, " * 50_000)[-1] == H.ANY
    assert H.mine([[]]).templates() == [] and E.layouts([]) == []


# The tables' own layouts, written down by hand and read without the miner.
_T = {
    "iso": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "slash": r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d\.\d+",
}
INDEPENDENT = [
    rf"(?P<t>{_T['iso']}) +(?P<l>[A-Za-z]+) +\[[^\]]*\] (?P<c>\S+) - ",
    rf"ts=(?P<t>{_T['iso']}) level=(?P<l>[A-Za-z]+) component=(?P<c>\S+) msg=",
    rf"\[(?P<t>{_T['iso']})\] \[(?P<l>[A-Za-z]+)\] (?P<c>[^:\s]+): ",
    rf"(?P<t>{_T['slash']})\|(?P<l>[A-Za-z]+)\|(?P<c>[^|]+)\|",
    rf'"(?P<t>{_T["iso"]})","(?P<c>[^"]+)","(?P<l>[A-Za-z]+)","',
    r"\d\d-\d\d \d\d:\d\d:\d\d\.\d+ +\d+ +\d+ (?P<l>[A-Z]) (?P<c>[^:\s]+): ",
    r"(?P<l>[A-Z])\d{4} \d\d:\d\d:\d\d\.\d+ +\d+ (?P<c>[^:\s]+):\d+\] ",
    r"<(?P<p>\d+)>1 \S+ \S+ (?P<c>\S+) \S+ - - ",
    r"[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d \S+ (?P<c>[^:\[\s]+)(?:\[\d+\])?: (?P<l>[A-Za-z]+): ",
    r"1\d{9}\.\d+ (?P<c>\S+) (?P<l>[A-Za-z]+) ",
    r"\d+\.\d+\.\d+\.\d+ - - \[[^\]]+\] \"[A-Z]+ \S+ (?P<w>HTTP)/",
    r'\{"t":\d+,"s":"(?P<c>[^"]+)","l":"(?P<l>[^"]+)","m":',
    r'\{"timestamp": ?"[^"]+", ?"level": ?"(?P<l>[^"]+)", ?"service": ?"(?P<c>[^"]+)", ?"message":',
    r'\{"level": ?"(?P<l>[^"]+)", ?"message": ?"(?:[^"\\]|\\.)*", ?"timestamp": ?"[^"]+", ?"service": ?"(?P<c>[^"]+)"',
]


def by_hand(line):
    for p in INDEPENDENT:
        if m := re.match(p, line):
            g = m.groupdict()
            if g.get("w"):
                return "I", "nginx"
            if g.get("p"):
                return "EEEEWIID"[int(g["p"]) & 7], g["c"]
            return next(c for c, names in H.LEVEL_WORDS.items() if g["l"].lower() in names), g["c"]
    return None


def test_the_tables_layouts_agree_with_an_independent_reading(spark):
    from pyspark.sql import functions as F

    from logstrata.plans import problems

    d = "/root/testdata/sf0.01"
    lines = {}
    for r in spark.read.parquet(f"{d}/raw_lines.parquet").groupBy("file_id", "line_no").agg(F.max("message").alias("m")).collect():
        lines[r.file_id, r.line_no] = re.sub(r"[\r\n]+\Z", "", re.sub(E.TERMINAL, "", r.m or ""))
    want = {k: h for k, x in lines.items() if (h := by_hand(x))}
    got = {(r.file_id, r.first_line): (r.level, r.component) for r in problems.p5_found(spark, d).collect()}
    assert len(want) > 1500 and got == want
