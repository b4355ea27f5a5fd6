"""Physical lines of differing layouts to log entries with timestamp, level, component and message.

1. Mining.  The header templates of all lines that hold a time are mined, partition by partition, by longest common
   subsequences (see headers), and the templates of all partitions are merged in the same way.
2. Classification.  Each template's tokens get a role from their type, their key and their place: time, level,
   severity, request, component, message.  A template with a time and one of the others is a layout.
3. Extraction.  Every line is matched against the layouts; the lines between two headers belong to the first, and go on
   its message.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.operators import headers
from logstrata.operators.headers import ADDRESS, ANY, CODE_OF, LEVEL, NUMBER, PATH, TIME, TIMED, WEB, WORD, is_key, role_of
from logstrata.operators.timestamps import instants
from logstrata.session import cut, partitions

#: Lines in a stretch of a file that one window orders.
STRETCH = 4096
TERMINAL = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b[@-Z\\-_]"
_HINT = r"[0-9]{1,2}:[0-9]{2}|[0-9]{10}|[0-9]{6} [0-9]{6}"
_CLUSTER = "tokens array<string>, support array<bigint>, gaps array<bigint>, members bigint, n bigint"


def _frame(clusters: headers.Clusters) -> pd.DataFrame:
    c = clusters.clusters
    return pd.DataFrame({"tokens": [list(x.tokens) for x in c], "support": [x.support for x in c], "gaps": [x.gaps for x in c], "members": [x.members for x in c], "n": [x.n for x in c]})


def _mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    clusters = headers.mine(pdf["line"] for pdf in batches)
    if clusters.clusters:
        yield _frame(clusters)


def merge_clusters(found: list[headers.Cluster]) -> headers.Clusters:
    """Clusters of several partitions as one set, the shortest first."""
    clusters = headers.Clusters()
    for c in sorted(found, key=lambda c: (len(c.solid), -c.n, c.tokens)):
        clusters.add(c)
    return clusters


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    clusters = merge_clusters([headers.Cluster(tuple(r.tokens), [int(x) for x in r.support], [int(x) for x in r.gaps], int(r.members), int(r.n)) for r in rows])
    if clusters.clusters:
        yield _frame(clusters)


def mine_templates(lines: DataFrame) -> list[tuple[tuple[str, ...], int]]:
    """(template, lines) of all rows of (line), merged over partitions in rounds of eight.

    As many as there are layouts: what varies inside a layout, its messages above all, adds none.
    """
    found = lines.mapInPandas(_mine, _CLUSTER)
    n = max(1, partitions(lines) // 8)
    while n > 1:
        found, n = found.repartition(n).mapInPandas(_merge, _CLUSTER), n // 8
    rows = found.repartition(1).mapInPandas(_merge, _CLUSTER).collect()
    return merge_clusters([headers.Cluster(tuple(r.tokens), list(r.support), list(r.gaps), r.members, r.n) for r in rows]).templates()


@dataclass
class Layout:
    """A classified template: a pattern with groups for the roles it has, and where the message stands.

    key     pattern of the key that names the message, until the pattern of the next key, if fields have keys
    lead    else, pattern of what stands between the last role and the message
    quoted  whether the message stands in quotation marks then
    end     tokens of the template up to the last role
    starts  the mark that its lines begin with; empty for a letter or a digit, None for anything
    """

    pattern: str
    n: int
    web: bool = False
    key: str | None = None
    until: str | None = None
    lead: str = ""
    quoted: bool = False
    end: int = 0
    starts: str | None = None

    def whole(self) -> bool:
        """Whether it gives both a level and a component."""
        return self.web or "(?P<component>" in self.pattern and ("(?P<level>" in self.pattern or "(?P<pri>" in self.pattern)


_WORDS = r"[^\W\d][\w.\-]*+"
_ROLE_PATTERN = {"time": rf"(?P<time>{TIME})", "level": r"(?P<level>[^\W\d_]++)", "pri": r"(?P<pri>\d{1,3})", "component": rf"(?P<component>{_WORDS})"}
_TYPE_PATTERN = {TIMED: f"(?:{TIME})", LEVEL: r"[^\W\d_]+", NUMBER: r"\d+(?:\.\d+)*", ADDRESS: r"\d+\.\d+\.\d+\.\d+", WORD: r"[^\s\"|,]+?", PATH: r"\S+", ANY: r".*?"}
#: What stands between two fields with keys: other fields, quoted values as a whole.
_SKIP = r'(?:"(?:[^"\\]|\\.)*+"|[^"])*?'
_PAIRS = {"[": "]", "(": ")", "{": "}"}


def classify(tokens: tuple[str, ...], n: int) -> Layout | None:
    """Roles of a template's tokens, and the pattern up to the last of them; None if it is no header.

    Keys name their values; what stands before the first key is told by its place.  The first time and the first level
    are the header's, a number in angle brackets at the start is a severity.  The component is the last word before the
    message that a mark, a number or a level follows, as a host, a thread or the first word of a message is not
    followed by one; else the last word in brackets of its own; else, after a level, the first word there is.
    """
    keyed = [i for i, t in enumerate(tokens) if is_key(t)]
    first_key = keyed[0] if keyed else len(tokens)
    roles: dict[str, int] = {}
    for role, kind in (("time", TIMED), ("level", LEVEL)):
        at = next((i for i, t in enumerate(tokens[:first_key]) if t == kind), None)
        if at is not None:
            roles[role] = at
    if tokens[:3] == ("<", NUMBER, ">"):
        roles["pri"] = 1
    placed = max(roles.values(), default=-1)
    body = next((i for i in range(placed + 1, first_key) if tokens[i] == ANY), first_key)
    if (at := _component(tokens, body, "level" in roles or "pri" in roles)) is not None:
        roles["component"] = at
    by_key: dict[str, int] = {}
    for i in keyed:
        role, j = role_of(tokens[i]), i + 1
        if j < len(tokens) and tokens[j] == '"':
            j += 1
        if role is None or j >= len(tokens) or role in roles or role in by_key:
            continue
        if role == "time" and tokens[j] != TIMED or role == "level" and tokens[j] not in (LEVEL, WORD):
            continue
        by_key[role] = j
    if "time" not in roles and "time" not in by_key:
        return None
    web = WEB in tokens and "level" not in roles and "pri" not in roles and not keyed
    if web:
        roles = {"time": roles["time"]}
    if len((roles.keys() | by_key.keys()) - {"message"}) < 2 and not web:
        return None
    fields = sorted((i, r) for r, i in by_key.items() if r != "message")
    last = tokens.index(WEB) if web else max(roles.values(), default=-1)
    if fields:
        last = first_key - 1
        while last >= 0 and tokens[last] == ANY:
            last -= 1
    parts = _by_place(tokens[: last + 1], roles)
    if fields:
        for i, role in fields:
            quoted = tokens[i - 1] == '"'
            at = i - 2 if quoted else i - 1
            parts.append((r"[\s,;]*" if at == last + 1 else _SKIP) + _key(tokens[at]) + r"\s*")
            last = i
            value = _ROLE_PATTERN[role] if role != "component" else r'(?P<component>[^"]*)' if quoted else r'(?P<component>[^\s,;"}]+)'
            parts.append(rf'"\s*{value}\s*"' if quoted else value + r"(?!\w)")
        pattern = "".join(parts)
    else:
        # what follows the last role delimits it: a mark of the layout, or the end of the word
        after = tokens[last + 1] if last + 1 < len(tokens) else ANY
        delimited = not _solid(after) and after != ANY
        pattern = "".join(parts) + (r"\s*" + _literal(after) if delimited else r"(?!\w)")
    if "message" in by_key:
        at = by_key["message"]
        key = tokens[at - 2 if tokens[at - 1] == '"' else at - 1]
        follows = next((_key(tokens[i]) for i in keyed if i > at), None)
        return Layout(pattern, n, web, _key(key), follows)
    if fields:
        return Layout(pattern, n, web, None, None, "")
    start = last + 2 if delimited else last + 1
    return Layout(pattern, n, web, None, None, _lead(tokens[start:body]), tokens[:body].count('"') % 2 == 1, last + 1)


def _component(tokens: tuple[str, ...], body: int, graded: bool) -> int | None:
    """The place of the component's word among the tokens before the message, if there is one."""
    words = [i for i in range(body) if tokens[i] == WORD]
    plain = [i for i in words if not _inside(tokens, i)]
    ended = [i for i in plain if i + 1 < len(tokens) and tokens[i + 1] not in (WORD, ANY, PATH)]
    if ended:
        return ended[-1]
    enclosed = [i for i in words if _inside(tokens, i)]
    if enclosed:
        return enclosed[-1]
    return plain[0] if plain and graded else None


def _by_place(tokens: tuple[str, ...], roles: dict[str, int]) -> list[str]:
    """Patterns of the tokens, one after the other; white space may stand between any two of them."""
    at = {i: r for r, i in roles.items()}
    parts: list[str] = []
    for i, t in enumerate(tokens):
        parts.append(_ROLE_PATTERN[at[i]] if i in at else _literal(t))
        if i + 1 < len(tokens):
            # two tokens without a mark between them are held apart by white space
            nxt = tokens[i + 1]
            parts.append(r"\s+" if _solid(t) and _solid(nxt) and (t, nxt) != (LEVEL, TIMED) else r"\s*")
    return parts


def _key(token: str) -> str:
    """The pattern of a key."""
    return re.escape(token[:-1]) + r"\s*:" if token[-1] == ":" else r"(?<![^\s,;{])" + re.escape(token)


def _lead(tokens: tuple[str, ...]) -> str:
    """Pattern of the marks, numbers and bracketed words before a message; words and what follows the last mark are the message's."""
    end = next((i for i, t in enumerate(tokens) if t in (WORD, PATH) and not _inside(tokens, i)), len(tokens))
    while end and (_solid(tokens[end - 1]) or tokens[end - 1] in "([{"):
        end -= 1
    return r"\s*".join(_literal(t) for t in tokens[:end])


def message_of(line: str, end: int, layout: Layout) -> str:
    """The message on the line of a header that ends at `end`; a web request is its whole line.

    A quoted message comes without its marks and escapes.  What a layout doesn't tell from the message stays in it.
    """
    if layout.web:
        return line
    if layout.key is not None:
        if line[0] == "{":
            try:
                value = json.loads(line, strict=False)[re.sub(r"\\s\*|[\\\":=]", "", layout.key)]
                return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
            except (ValueError, KeyError, RecursionError):
                pass  # not whole on this line
        m = re.compile(_SKIP + layout.key + r"\s*").match(line)
        if m is None:
            return line[end:].strip()
        rest = line[m.end() :]
        if rest[:1] == '"':
            value = re.match(r'"((?:[^"\\]|\\.)*)', rest, re.S)[1]
            try:
                return json.loads(f'"{value}"', strict=False)
            except ValueError:
                return value
        stop = re.search(r"[\s,;]+" + layout.until, rest) if layout.until else None
        return rest[: stop.start()] if stop else rest
    m = re.compile(r"\s*" + layout.lead + r"\s*").match(line, end)
    rest = line[m.end() :] if m else line[end:].lstrip()
    if layout.quoted and (m := re.match(r'((?:[^"]|"")*)"\s*(?:,|\Z)', rest)):
        return m[1].replace('""', '"')
    return rest


def _solid(token: str) -> bool:
    """Whether a token is a word, a number, a time or the like, and no mark."""
    return token in _TYPE_PATTERN and token != ANY or token == WEB


def _literal(token: str) -> str:
    return _TYPE_PATTERN[token] if token in _TYPE_PATTERN else re.escape(token)


def _inside(tokens: tuple[str, ...], i: int) -> bool:
    """Whether a word stands in brackets of its own, as a thread or a level does."""
    return 0 < i < len(tokens) - 1 and _PAIRS.get(tokens[i - 1]) == tokens[i + 1]


def layouts(templates: list[tuple[tuple[str, ...], int]]) -> list[Layout]:
    """The header layouts of mined templates, those with all fields first, then the most frequent.

    A frequent template with all fields stands for the rarer ones without keys that begin like its header: what these
    hold beyond it are words of messages that too few lines had.
    """
    found: dict[tuple[str, bool], Layout] = {}
    heads: list[tuple[tuple[str, ...], tuple[str, bool]]] = []
    for t, n in sorted(templates, key=lambda x: (-x[1], x[0])):
        x = classify(t, n)
        if x is None:
            continue
        solid = t[0] in _TYPE_PATTERN or t[0][-1] == "="
        x = replace(x, starts=None if t[0] in (ANY, PATH) else "" if solid else t[0][0])
        key = next((k for head, k in heads if t[: len(head)] == head), (x.pattern, x.web))
        if key not in found and x.whole() and not any(map(is_key, t)):
            end = t.index(WEB) + 1 if x.web else x.end
            heads.append((t[:end], key))
        found[key] = replace(found[key], n=found[key].n + n) if key in found else x
    return sorted(found.values(), key=lambda x: (not x.whole(), -x.n, x.pattern))


def header(line: str, at_most: int | None, compiled: list[tuple]) -> tuple[int, str | None, str | None] | None:
    """(t, level, component) if a line carries its own header from the first character on, else None."""
    found = _header(line, at_most, compiled)
    return found and found[0]


def _header(line: str, at_most: int | None, compiled: list[tuple]) -> tuple[tuple[int, str | None, str | None], int, int] | None:
    """The header, where it ends, and the number of its layout."""
    if not line or line[0].isspace():
        return None
    first = line[0]
    for k, (pattern, web, *starts) in enumerate(compiled):
        # most layouts are told apart by their first character
        if starts and starts[0] is not None and (first != starts[0] if starts[0] else not first.isalnum() and first not in "_@"):
            continue
        m = pattern.match(line)
        if not m:
            continue
        g = m.groupdict()
        level = CODE_OF.get(g["level"].lower()) if g.get("level") else None
        if g.get("level") and level is None or web and "HTTP/" not in line:
            continue
        if level is None and g.get("pri"):
            severity = int(g["pri"]) & 7
            level = "E" if severity <= 3 else "W" if severity == 4 else "I" if severity <= 6 else "D"
        year = datetime.fromtimestamp(at_most / 1000, timezone.utc).year if at_most is not None else None
        times = instants(g["time"], "UTC", year)
        if not times:
            continue
        fitting = [t for t in times if at_most is None or t <= at_most]
        t = fitting[-1] if len(times) > 1 and fitting else times[0]
        return (t, "I", "nginx") if web else (t, level, g.get("component")), m.end(), k
    return None


def _extract(found: list[Layout]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(x.pattern), x.web, x.starts) for x in found]
        for pdf in batches:
            hits = [_header(s, None if ts != ts else int(ts), compiled) for s, ts in zip(pdf["line"], pdf["ts"])]
            keep = [h is not None for h in hits]
            out = pdf.loc[keep, ["file_id", "line_no"]].copy()
            hits = [(*h[0], message_of(s, h[1], found[h[2]])) for s, h in zip(pdf["line"], hits) if h is not None]
            for k, (name, kind) in enumerate((("t", "int64"), ("level", object), ("component", object), ("message", object))):
                out[name] = pd.Series([h[k] for h in hits], dtype=kind, index=out.index)
            yield out

    return run


def clean_lines(df: DataFrame, file: Column, line_no: Column, ts: Column, message: Column) -> DataFrame:
    """(file_id, line_no, ts, line): each physical line once, with its earliest time, without terminal codes and line ends."""
    slim = df.select(file.cast("long").alias("file_id"), line_no.cast("int").alias("line_no"), ts.cast("long").alias("ts"), message.alias("m"))
    once = slim.filter("file_id is not null and line_no is not null").groupBy("file_id", "line_no").agg(F.min("ts").alias("ts"), F.max("m").alias("m"))
    return once.select("file_id", "line_no", "ts", F.regexp_replace(F.regexp_replace("m", TERMINAL, ""), r"[\r\n]+\z", "").alias("line"))


def assemble(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Entries from lines and headers: (file_id, first_line, last_line, t, level, component, message).

    Files are ordered in stretches of lines, so that a file with a third of all lines is spread; what an entry has in
    the following stretches is found from one row per stretch.  Only an entry's own text comes together in one row.
    """
    stretch = F.floor(F.col("line_no") / STRETCH)
    solid = lines.filter(F.coalesce("line", F.lit("")).rlike(r"\S")).select("file_id", "line_no", F.lit(False).alias("is_header"), F.col("line").alias("message"), *(F.lit(None).cast(t).alias(c) for c, t in (("t", "long"), ("level", "string"), ("component", "string"))))
    marks = solid.unionByName(headers.withColumn("is_header", F.lit(True)).select(solid.columns)).withColumn("stretch", stretch)
    w = Window.partitionBy("file_id", "stretch").orderBy("line_no", F.col("is_header").desc())
    grouped = marks.withColumn("head", F.last(F.when(F.col("is_header"), F.col("line_no")), True).over(w)).groupBy("file_id", "stretch", "head").agg(
        F.max("line_no").alias("last_line"), *(F.first(c, True).alias(c) for c in ("t", "level", "component")),
        # of the header's line only its message
        F.collect_list(F.when(F.col("is_header") | ~F.col("line_no").eqNullSafe(F.col("head")), F.struct("line_no", "message"))).alias("lines"),
    )
    parts = cut(grouped)
    per = parts.groupBy("file_id", "stretch").agg(
        F.max("head").alias("last_head"), F.max(F.when(F.col("head").isNull(), F.col("last_line"))).alias("lead_in")
    )
    over = Window.partitionBy("file_id").orderBy("stretch")
    numbered = per.withColumn("upto", F.count("last_head").over(over)).withColumn("before", F.col("upto") - F.when(F.col("last_head").isNotNull(), 1).otherwise(0))
    tails = numbered.groupBy("file_id", F.col("before").alias("upto")).agg(F.max("lead_in").alias("tail"))
    ends = numbered.filter("last_head is not null").join(tails, ["file_id", "upto"], "left").select("file_id", F.col("last_head").alias("head"), "tail", "upto")
    leads = parts.filter("head is null").join(numbered.select("file_id", "stretch", F.col("before").alias("upto")), ["file_id", "stretch"])
    more = leads.groupBy("file_id", "upto").agg(F.flatten(F.collect_list("lines")).alias("more"))
    ends = ends.join(more, ["file_id", "upto"], "left").drop("upto")
    # blank lines inside an entry stay, as line breaks
    broken = lambda x, i: F.concat(F.repeat(F.lit("\n"), x["line_no"] - F.coalesce(F.get("lines", i - 1)["line_no"], x["line_no"])), x["message"])
    whole = parts.filter("head is not null").join(ends, ["file_id", "head"], "left").withColumn(
        "lines", F.array_sort(F.when(F.col("more").isNull(), F.col("lines")).otherwise(F.concat("lines", "more")))
    )
    return whole.select(
        "file_id", F.col("head").alias("first_line"), F.greatest("last_line", "tail").alias("last_line"), "t", "level", "component",
        F.array_join(F.transform("lines", broken), "").alias("message"),
    )


def entries(df: DataFrame, file: Column, line_no: Column, ts: Column, message: Column) -> DataFrame:
    """Log entries of physical lines: (file_id, first_line, last_line, t, level, component, message).

    Lines read again count once; rows without file or line number have no place and are left out; null and blank lines
    never end an entry.  Lines before a file's first header belong to none.  t is epoch milliseconds; header times are
    UTC unless an offset is written; a missing year is the latest that does not put the entry after the earliest `ts`
    of the line (the current year's neighbourhood if that is null).  level or component is null where a layout has
    none.  message is what follows the header and the entry's other lines, in order, without terminal codes; the lines
    are joined by line breaks.  Without any line that has a header the result is empty.
    """
    lines = cut(clean_lines(df, file, line_no, ts, message))
    candidates = lines.filter(F.col("line").rlike(r"^\S") & F.col("line").rlike(_HINT))
    found = layouts(mine_templates(candidates.select("line")))
    headers = candidates.mapInPandas(_extract(found), "file_id bigint, line_no int, t bigint, level string, component string, message string")
    return assemble(lines, headers)
