"""Header templates of log lines, mined by longest common subsequence.

A line becomes a skeleton of typed tokens: times, levels, addresses, numbers, words, marks, and the keys that name a field.  Where
its free text begins (a run of words) the skeleton of a line without keys ends; a line with keys is read to its end, quoted
values as one token.  Equal skeletons are counted once.  Clusters are built from the shortest skeleton on, so that headers come
before the messages that happen to look like one.  A skeleton joins the cluster whose solid tokens (those that nearly all members
have) make up most of their longest common subsequence; what a line has beyond the last of them is its message and does not
count, what it has in between does.  A time, a level or a key that the other side lacks keeps two apart in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from logstrata.operators.timestamps import MONTHS

# Words for the four levels, and the names under which fields are written as key and value.
LEVEL_WORDS = {
    "D": ("d", "v", "t", "trace", "trc", "debug", "dbg", "verbose", "fine"),
    "I": ("i", "n", "info", "inf", "information", "notice"),
    "W": ("w", "warn", "warning", "wrn"),
    "E": ("e", "f", "c", "error", "err", "severe", "fatal", "ftl", "crit", "critical", "alert", "emerg", "panic"),
}
KEY_ROLES = {
    "time": ("timestamp", "time", "ts", "t", "@timestamp", "datetime", "date"),
    "level": ("level", "lvl", "l", "severity", "loglevel"),
    "component": ("service", "component", "comp", "logger", "s", "module", "app", "svc"),
    "message": ("message", "msg", "m", "text"),
}
CODE_OF = {w: c for c, words in LEVEL_WORDS.items() for w in words}
ROLE_OF = {k: r for r, keys in KEY_ROLES.items() for k in keys}
TIMED, LEVEL, ADDRESS, NUMBER, WORD, PATH, ANY = "<T>", "<L>", "<I>", "<N>", "<W>", "<P>", "<*>"
WEB = "HTTP"
#: Share of the solid tokens that a member has in common with its cluster, and share of members that makes a token solid.
SIMILAR, SOLID = 0.8, 0.9
#: Words, or numbers, in a row that are free text.
RUN = {WORD: 3, NUMBER: 4}
#: Tokens after the last time, level or key within which a header may still go on.
REACH = 32
#: Skeletons of a task that are counted before they are folded into clusters.
COUNTED = 100_000

_MONTH = "|".join(m.capitalize() for m in MONTHS)
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
_OFFSET = r"(?:\s?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})(?![\w]))?"
#: Notations of a time of day with its date, as they stand inside a line.
TIME = (
    rf"(?<!\d)\d{{4}}[-/.]\d{{2}}[-/.]\d{{2}}[T ]{_CLOCK}{_OFFSET}|\d{{1,2}}/(?:{_MONTH})/\d{{4}}:{_CLOCK}{_OFFSET}"
    rf"|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+)?(?:\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}|(?:{_MONTH})\s+\d{{1,2}}(?:,?\s+\d{{4}})?)\s+{_CLOCK}{_OFFSET}"
    rf"|(?<!\d)\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}\s+{_CLOCK}(?:\s?[AaPp][Mm])?{_OFFSET}"
    rf"|(?<![\d-])\d{{2}}-\d{{2}} {_CLOCK}|(?<!\d)\d{{4}} {_CLOCK}|(?<!\d)\d{{6}} \d{{6}}(?!\d)|(?<![\d.])1\d{{9}}\.\d{{3,9}}(?!\d)|(?<![\d.])1\d{{12}}(?:\d{{3}}|\d{{6}})?(?![\d.])"
)
_TIME = re.compile(TIME)
_KEY = r'"[A-Za-z_@][\w@.\-]*"\s*:|(?<![^\s,;{])[A-Za-z_@][\w@.\-]*='
_TOKEN = re.compile(
    rf"(?P<K>{_KEY})|(?P<L>\b[A-Z](?=\d{{4}} \d{{2}}:))|(?P<T>{TIME})|(?P<P>(?<=\s)(?:https?://|/)\S+)"
    rf"|(?P<I>(?<![\w.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\w.]))|(?P<W>[^\W\d][\w.\-]*)|(?P<N>\d+(?:\.\d+)*)|(?P<M>[^\w\s])"
)
_TYPED = {"L": LEVEL, "T": TIMED, "P": PATH, "I": ADDRESS, "N": NUMBER}
_QUOTED = re.compile(r'\s*"((?:[^"\\]|\\.)*)"?', re.S)
_BARE = re.compile(r"\s*([^\s,;}\]\"]*)")
_NEXT_KEY = re.compile(r"[\s,;]+(?=[A-Za-z_@][\w@.\-]*=)")
_NAME = re.compile(r"[^\W\d][\w.\-]*\Z")


def is_level(word: str) -> bool:
    """Whether a token is a name of a level; a single letter counts only as a capital."""
    return word.lower() in CODE_OF and (len(word) > 1 or word.isupper())


def is_key(token: str) -> bool:
    return len(token) > 1 and token[-1] in "=:" and token[0] not in "<"


def role_of(key: str) -> str | None:
    return ROLE_OF.get(key.strip('":= ').lower())


def is_anchor(token: str) -> bool:
    """Whether a token tells layouts apart by itself."""
    return token in (TIMED, LEVEL, WEB) or is_key(token)


def _value(line: str, at: int, role: str) -> tuple[list[str], int]:
    """The tokens of the value of a key, and where it ends."""
    quoted = _QUOTED.match(line, at)
    if quoted:
        text, end, mark = quoted[1], quoted.end(), ['"']
    elif role == "message":
        m = _NEXT_KEY.search(line, at)
        return [ANY], m.start() if m else len(line)
    else:
        space = at + len(line[at:]) - len(line[at:].lstrip()) if line[at : at + 1].isspace() else at
        if (m := _TIME.match(line, space)) and role == "time":
            return [TIMED], m.end()
        bare = _BARE.match(line, at)
        text, end, mark = bare[1], bare.end(), []
    if role == "time":
        kind = TIMED if _TIME.fullmatch(text.strip()) else ANY
    elif role == "level":
        kind = LEVEL if is_level(text.strip()) else WORD if _NAME.match(text) else ANY
    else:
        kind = WORD if role == "component" and text else ANY
    return [*mark, kind], end


def skeleton(line: str) -> tuple[str, ...] | None:
    """The typed tokens of a line's header and of what may be one; None if it has no time before its free text."""
    out: list[str] = []
    at, run, since, keyed, timed, leveled = 0, 0, 0, False, False, False
    while m := _TOKEN.search(line, at):
        kind, at = m.lastgroup, m.end()
        if kind == "K":
            if timed and leveled and not keyed:
                out.append(ANY)  # a field of the message
                break
            keyed = True
            key = m.group().replace(" ", "")
            role = role_of(key)
            run = since = 0
            if role is None:
                quoted = _QUOTED.match(line, at)
                at = quoted.end() if quoted else _BARE.match(line, at).end()
                if not out or out[-1] != ANY:
                    out.append(ANY)
                continue
            value, at = _value(line, at, role)
            timed |= TIMED in value
            out += [key, *value]
            continue
        if kind == "M":
            mark = m.group()
            if keyed and mark in ",;{}\"":
                continue
            token = mark
        elif kind == "W":
            word = m.group()
            token = LEVEL if is_level(word) else WEB if word == WEB and line[at : at + 1] == "/" else WORD
        else:
            token = _TYPED[kind]
        if token in (TIMED, LEVEL):
            timed, leveled = timed or token == TIMED, leveled or token == LEVEL
            since = 0
        since += 1
        run = run + 1 if out and out[-1] == token and token in RUN else 1
        if keyed and token not in (TIMED, LEVEL):
            if out[-1] != ANY:
                out.append(ANY)
            continue
        if run == RUN.get(token) or since > REACH:
            out.append(ANY)
            break
        out.append(token)
        if token == WEB:
            break
    return tuple(out) if timed else None


@dataclass
class Cluster:
    """A template under construction.

    support  for each token, the members that have it
    gaps     for each token, the members that have other tokens before it, since the last one in common
    """

    tokens: tuple[str, ...]
    support: list[int]
    gaps: list[int]
    members: int
    n: int
    solid: list[int] = field(default_factory=list)
    anchors: tuple[str, ...] = ()
    head: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.refresh()

    def refresh(self) -> None:
        least = SOLID * self.members
        self.solid = [i for i, s in enumerate(self.support) if s >= least and self.tokens[i] != ANY]
        self.anchors = tuple(self.tokens[i] for i in self.solid if is_anchor(self.tokens[i]))
        # a header without any gap is compared as it stands
        k = len(self.solid)
        whole = self.solid == list(range(k)) and not any(self.gaps[:k])
        self.head = tuple(self.tokens[:k]) if whole and k else ()

    def template(self) -> tuple[str, ...]:
        """The solid tokens, with a slot of any length where members differ."""
        out: list[str] = []
        last = -1
        for i in self.solid:
            if (i != last + 1 or self.gaps[i]) and (not out or out[-1] != ANY):
                out.append(ANY)
            out.append(self.tokens[i])
            last = i
        if last + 1 < len(self.tokens) or self.members > 1 or not out:
            out.append(ANY)
        return tuple(out)


def align(cluster: Cluster, line: tuple[str, ...]) -> list[int]:
    """For each token of the cluster the place of its partner in the line, or -1: a longest common subsequence.

    Solid tokens count first, then the others; of equally long ones that which lies furthest left.
    """
    a, n, m = cluster.tokens, len(cluster.tokens), len(line)
    weight = [1] * n
    for i in cluster.solid:
        weight[i] = n + 1
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        here, below, x, w = table[i], table[i + 1], a[i], weight[i]
        for j in range(m - 1, -1, -1):
            best = below[j] if below[j] >= here[j + 1] else here[j + 1]
            if x == line[j] and x != ANY and below[j + 1] + w > best:
                best = below[j + 1] + w
            here[j] = best
    out = [-1] * n
    i = j = 0
    while i < n and j < m and table[i][j]:
        if a[i] == line[j] and a[i] != ANY and table[i][j] == table[i + 1][j + 1] + weight[i]:
            out[i] = j
            i, j = i + 1, j + 1
        elif table[i][j] == table[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def similarity(cluster: Cluster, line: tuple[str, ...], at: list[int]) -> float:
    """Common solid tokens over all solid tokens and those that the line has between them."""
    common = [at[i] for i in cluster.solid if at[i] >= 0]
    if not common:
        return 0.0
    if any(at[i] < 0 and is_anchor(cluster.tokens[i]) for i in cluster.solid):
        return 0.0
    taken = {j for j in at if j >= 0}
    between = [line[j] for j in range(common[-1]) if j not in taken]
    if any(is_anchor(t) for t in between):
        return 0.0
    return len(common) / (len(cluster.solid) + len(between))


class Clusters:
    """Templates of the skeletons added."""

    def __init__(self) -> None:
        self.clusters: list[Cluster] = []
        #: clusters by their first anchors, so that a skeleton is compared only with those that it can join
        self.by_anchors: dict[tuple[str, ...], list[int]] = {}

    def add_all(self, counts: Iterable[tuple[tuple[str, ...], int]]) -> None:
        for tokens, n in sorted(counts, key=lambda x: (len(x[0]), -x[1], x[0])):
            self.add(Cluster(tokens, [1] * len(tokens), [0] * len(tokens), 1, n))

    def add(self, new: Cluster) -> None:
        line = tuple(new.tokens[i] for i in new.solid)
        anchors = tuple(t for t in line if is_anchor(t))
        best, chosen, places = 0.0, -1, None
        for k in range(len(anchors) + 1):
            for c in self.by_anchors.get(anchors[:k], ()):
                cluster = self.clusters[c]
                if cluster.head and line[: len(cluster.head)] == cluster.head:
                    score, at = 1.0, None
                    if len(cluster.head) == len(cluster.tokens):
                        at = [*range(len(cluster.head))]
                else:
                    at = align(cluster, line)
                    score = similarity(cluster, line, at)
                if score > best or score == best and chosen >= 0 and len(cluster.solid) > len(self.clusters[chosen].solid):
                    best, chosen, places = score, c, at
        if best < SIMILAR:
            self.by_anchors.setdefault(new.anchors, []).append(len(self.clusters))
            self.clusters.append(new)
            return
        cluster = self.clusters[chosen]
        before = cluster.anchors
        at = align(cluster, line) if places is None else places
        last = -1
        for i, j in enumerate(at):
            if j >= 0:
                own = new.solid[j]
                cluster.support[i] += new.support[own]
                inner = new.gaps[own] if own - 1 in new.solid or own == 0 else new.members
                cluster.gaps[i] += new.members if j != last + 1 else inner
                last = j
        cluster.members += new.members
        cluster.n += new.n
        cluster.refresh()
        if cluster.anchors != before:
            self.by_anchors[before].remove(chosen)
            self.by_anchors.setdefault(cluster.anchors, []).append(chosen)

    def templates(self) -> list[tuple[tuple[str, ...], int]]:
        """(template, lines), the most frequent first; equal ones are one."""
        out: dict[tuple[str, ...], int] = {}
        for c in self.clusters:
            out[c.template()] = out.get(c.template(), 0) + c.n
        return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def mine(lines: Iterator[Iterable[str]]) -> Clusters:
    """The clusters of batches of lines."""
    clusters, counts = Clusters(), {}
    for batch in lines:
        for line in batch:
            s = skeleton(line)
            if s:
                counts[s] = counts.get(s, 0) + 1
        if len(counts) > COUNTED:
            clusters.add_all(counts.items())
            counts = {}
    clusters.add_all(counts.items())
    return clusters
