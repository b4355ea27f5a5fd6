"""python -m logstrata agent|query|generate|stats ..."""

from __future__ import annotations

import sys
import time
from itertools import islice

from pyspark.sql import functions as F

from logstrata.functions.scalars import format_line
from logstrata.schema import InvalidInput
from logstrata.session import get_spark
from logstrata.sources.generate import generate_lines, to_json_lines
from logstrata.sources.parse import parse_lines
from logstrata.store import LogStore

USAGE = """usage: python -m logstrata agent <dir> <service> <file, or - for standard input>
       python -m logstrata query <dir> <start_ms> <end_ms> [keyword] [limit]
       python -m logstrata generate <count> <out> [service]
       python -m logstrata stats <dir>"""


def _number(text: str, name: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise InvalidInput(f"{name} is no number: {text}") from None


def _read_stdin(store: LogStore, service: str, lines: int = 50_000) -> None:
    """Append the lines of standard input, some at a time, and put the rest into a segment at its end."""
    stream = iter(sys.stdin)
    while block := list(islice(stream, lines)):
        rows = store.spark.createDataFrame([(x,) for x in block], "value string")
        store.append(parse_lines(rows, F.col("value"), F.lit(int(time.time() * 1000)), F.lit(service)).select("t", "s", "l", "m"))
    store.flush()


def main(args: list[str]) -> int:
    needed = {"agent": 3, "query": 3, "generate": 2, "stats": 1}
    if not args or args[0] not in needed or len(args) - 1 < needed[args[0]]:
        print(USAGE, file=sys.stderr)
        return 1
    verb, *rest = args
    if verb == "query":
        start, end = _number(rest[1], "start"), _number(rest[2], "end")
        keyword, limit = rest[3] if len(rest) > 3 else "", _number(rest[4], "limit") if len(rest) > 4 else 100
        rows = LogStore(get_spark(), rest[0]).query(start, end, keyword, limit).select(format_line(*(F.col(c) for c in "tslm")).alias("line"))
        for r in rows.toLocalIterator():
            print(r.line)
    elif verb == "generate":
        count = _number(rest[0], "count")
        to_json_lines(generate_lines(get_spark(), count, int(time.time() * 1000), rest[2] if len(rest) > 2 else "app")).write.mode("overwrite").text(rest[1])
        print(f"Generated {count} lines to {rest[1]}")
    elif verb == "stats":
        for k, v in LogStore(get_spark(), rest[0]).stats().items():
            print(f"{k}: {v}")
    elif rest[2] == "-":
        _read_stdin(LogStore(get_spark(), rest[0]), rest[1])
    else:
        from logstrata.streaming.ingest import ingest, tail_lines

        spark = get_spark()
        query = ingest(tail_lines(spark, rest[2]), LogStore(spark, rest[0]), rest[1], f"{rest[0]}/_checkpoint")
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
    return 0
