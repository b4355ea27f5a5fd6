"""Mixed timestamp notations and zones to one UTC instant.

The distinct pairs of raw string and wall-clock zone form a dictionary.  Each entry is parsed once, against the whole
list of notations, into the instants it can denote: one as a rule, two in an hour that occurs twice, several for a
notation without a year.  The dictionary is written (and can be kept and extended between runs) and joined back to the
rows, where the time of arrival picks among the instants.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logstrata.session import broadcast_if_small, cut

# Month names, and the offsets in minutes of zone abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540,
    "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120,
    "ART": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Years before and after the hint within which a notation without a year is looked for; 29 February needs up to 8.
YEARS_BACK, YEARS_ON = 8, 1

_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,:](?P<f>\d{1,12}))?)?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
_AMPM = r"(?:\s*(?P<p>[AaPp])\.?[Mm]\.?)?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MON = r"(?P<b>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: The notations with punctuation, tried in this order; each must match the whole string.
NOTATIONS = tuple(
    re.compile(p + r"\Z", re.I | re.A)
    for p in (
        rf"(?P<Y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})[T\s]\s*{_CLOCK}{_AMPM}{_ZONE}",
        rf"(?P<Y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})[T\s]\s*{_CLOCK}{_AMPM}{_ZONE}",
        rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<Y>\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_AMPM}{_ZONE}",
        rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<Y>\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_AMPM}{_ZONE}",
        rf"(?P<d>\d{{1,2}})[/\s-]{_MON}[/\s-](?P<Y>\d{{4}})[:\s]\s*{_CLOCK}{_AMPM}{_ZONE}",
        rf"{_DAY}(?P<d>\d{{1,2}})[\s-]{_MON}[\s-](?P<Y>\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_AMPM}{_ZONE}",
        rf"{_DAY}{_MON}\s+(?P<d>\d{{1,2}}),?\s+(?P<Y>\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}",
        rf"{_DAY}{_MON}\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_AMPM}(?:\s*(?P<z>Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{3,5}}))?\s+(?P<Y>\d{{4}})",
        rf"{_DAY}{_MON}\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}",
        rf"(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}",
        rf"(?P<m>\d{{2}})(?P<d>\d{{2}})\s+{_CLOCK}{_ZONE}",
        rf"(?P<Y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[T\s](?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})(?:[.,](?P<f>\d{{1,12}}))?{_ZONE}",
        rf"(?P<Y>\d{{2}})(?P<m>\d{{2}})(?P<d>\d{{2}})\s+(?P<H>\d{{2}}):?(?P<M>\d{{2}}):?(?P<S>\d{{2}})(?:[.,](?P<f>\d{{1,12}}))?{_ZONE}",
        r"(?P<Y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})",
    )
)
#: Epoch counts by their number of digits: multiplier and divisor to milliseconds.
EPOCH = {10: (1000, 1), 13: (1, 1), 16: (1, 1000), 19: (1, 1_000_000)}
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?(\d{3})?\Z", re.A)
_DECIMAL = re.compile(r"(\d{10}|\d{13}|\d{16})[.,](\d+)\Z", re.A)
#: Strings without a year: only these need a hint of the year in the dictionary.
NO_YEAR = r"(?i)^[\s\[({]*([a-z]{3,9}[.,]?\s+)?[a-z]{3,9}\.?\s+\d{1,2}\s+\d{1,2}:\d{2}(:\d{2}([.,:]\d+)?)?(\s*(z|[+-]\d{2}:?\d{2}|[a-z]{2,5}))?[\s\])}]*$|^[\s\[({]*\d{1,2}-?\d{1,2}\s+\d{1,2}:\d{2}"
#: A space to which the marks around a readable string are stripped.
PADDING = " \t\r\n\f\v ﻿[](){}<>\"'"
_EPOCH0 = datetime(1970, 1, 1)
_zones: dict[str, ZoneInfo | None] = {}


def _zone(name: str | None) -> ZoneInfo | None:
    if name not in _zones:
        try:
            _zones[name] = ZoneInfo(name) if name else None
        except (KeyError, ValueError, OSError):
            _zones[name] = None
    return _zones[name]


def _millis(wall: datetime) -> int:
    delta = wall - _EPOCH0
    return delta.days * 86_400_000 + delta.seconds * 1000 + delta.microseconds // 1000


def wall_instants(wall: datetime, zone: str | None) -> list[int]:
    """The epoch milliseconds at which the clock of a zone shows `wall`: none in a gap, two in a repeated hour."""
    tz = _zone(zone)
    if tz is None:
        return []
    base, out = _millis(wall), []
    for fold in (0, 1):
        offset = wall.replace(tzinfo=tz, fold=fold).utcoffset()
        t = base - round(offset.total_seconds() * 1000)
        back = datetime.fromtimestamp(t // 1000, timezone.utc).astimezone(tz).utcoffset()
        if back == offset and t not in out:
            out.append(t)
    return out


def _offset_minutes(text: str) -> int | None:
    if text[0] in "+-":
        digits = text[1:].replace(":", "").ljust(4, "0")
        hours, minutes = int(digits[:2]), int(digits[2:])
        return None if hours > 18 or minutes > 59 else (hours * 60 + minutes) * (-1 if text[0] == "-" else 1)
    return ABBREVIATIONS.get(text.upper())


def _instants(year: int, month: int, day: int, clock: tuple[int, int, int, int], offset: int | None, zone: str | None) -> list[int]:
    try:
        wall = datetime(year, month, day, clock[0], clock[1], clock[2]) + timedelta(milliseconds=clock[3])
    except ValueError:
        return []
    if offset is None and zone == "UTC":
        offset = 0
    return wall_instants(wall, zone) if offset is None else [_millis(wall) - offset * 60_000]


def instants(text: str | None, zone: str | None, year_hint: int | None = None) -> list[int]:
    """All epoch milliseconds that a string can denote, ascending; [] if it is unreadable.

    Finer digits are cut off, coarser ones are zero.  Digits alone are an epoch count by their length (10 s, 13 ms,
    16 us, 19 ns) or a compact calendar notation (12, 14 or 17 digits).  A written offset or abbreviation wins over
    `zone`; a wall time with neither, with an unknown zone name, or inside a daylight-saving gap denotes nothing.
    """
    s = (text or "").strip(PADDING)
    if not s or not any(c.isdigit() for c in s):
        return []
    if s.isascii() and s.isdigit():
        if len(s) in EPOCH:
            mul, div = EPOCH[len(s)]
            return [int(s) * mul // div]
        c = _COMPACT.match(s)
        if not c or len(s) not in (12, 14, 17):
            return []
        y, mo, d, h, mi, sec, ms = (int(x) if x else 0 for x in c.groups())
        return sorted(_instants(y, mo, d, (h, mi, sec, ms), None, zone))
    if c := _DECIMAL.match(s):
        mul, div = EPOCH[len(c[1])]
        return [int(c[1] + c[2]) * mul // (div * 10 ** len(c[2]))]
    for notation in NOTATIONS:
        c = notation.match(s)
        if not c:
            continue
        g = c.groupdict()
        hour = int(g.get("H") or 0)
        if p := g.get("p"):
            if not 1 <= hour <= 12:
                return []
            hour = hour % 12 + (12 if p in "Pp" else 0)
        clock = (hour, int(g.get("M") or 0), int(g.get("S") or 0), int(((g.get("f") or "") + "000")[:3]))
        offset = None
        if g.get("z") and (offset := _offset_minutes(g["z"])) is None:
            return []
        month = MONTHS.index(g["b"].lower()) + 1 if g.get("b") else int(g["m"])
        if g.get("Y"):
            year = int(g["Y"]) + (2000 if len(g["Y"]) == 2 else 0)
            return sorted(_instants(year, month, int(g["d"]), clock, offset, zone))
        hint = year_hint if year_hint is not None else datetime.now(timezone.utc).year
        found = (t for y in range(hint - YEARS_BACK, hint + YEARS_ON + 1) for t in _instants(y, month, int(g["d"]), clock, offset, zone))
        return sorted(found)
    return []


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        hints = pdf["hint"]
        yield pdf.assign(
            instants=[
                instants(s, z if isinstance(z, str) else None, None if h != h or h is None else int(h))
                for s, z, h in zip(pdf["raw"], pdf["zone"], hints)
            ]
        )


def build_dictionary(rows: DataFrame) -> DataFrame:
    """Parse each distinct (raw, zone, hint) of `rows` once: (raw, zone, hint, instants)."""
    distinct = rows.select("raw", "zone", "hint").distinct()
    return distinct.mapInPandas(_parse, "raw string, zone string, hint int, instants array<bigint>")


def extend_dictionary(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Append to the dictionary table at `path` what it lacks, and return the whole; only new strings are parsed.

    Two runs at once may both append a string; both entries are the same, and one of them is read.
    """
    try:
        old = spark.read.parquet(path)
        if not old.columns:
            raise ValueError("empty")
        new = rows.select("raw", "zone", "hint").distinct()
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("raw", "zone", "hint")]
        missing = new.alias("a").join(old.alias("b"), on, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e) and "empty" not in str(e):
            raise
        missing = rows
    build_dictionary(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).dropDuplicates(["raw", "zone", "hint"])


def normalise(
    df: DataFrame, sources: DataFrame, raw: Column, source: Column, arrival: Column, keep: dict[str, Column], dictionary_path: str | None = None, unreadable: bool = False
) -> DataFrame:
    """Add `t`, the UTC instant in epoch milliseconds, to the columns `keep` of the rows whose string is readable.

    df          rows; raw is the written string, source the id of the stream, arrival epoch milliseconds
    sources     (source, zone): the wall-clock zone of each stream; several rows of one source count as one
    Of several instants the latest not after `arrival` is taken; if all lie after it, or arrival is null, the earliest
    (for a null arrival the year hint is the current year).  Rows whose string is null, empty or unreadable are left
    out, or with `unreadable` kept with a null t.  Repeated rows stay repeated.  The rows' side of the join back is a plain shuffle, so adaptive execution splits
    a string that a third of all rows share.
    """
    slim = df.select(raw.alias("raw"), source.alias("source"), arrival.cast("long").alias("arrival"), *(c.alias(f"k_{n}") for n, c in keep.items()))
    zones = sources.groupBy("source").agg(F.min("zone").alias("zone"))
    hopeful = F.col("raw").rlike("[0-9].*[0-9].*[0-9]")
    rows = (
        (slim if unreadable else slim.filter(hopeful))
        .join(broadcast_if_small(zones, 200_000), "source", "left")
        .select(
            "raw", "arrival", *(f"k_{n}" for n in keep),
            # the zone matters only to wall times and the year only where none is written
            F.when(F.col("raw").rlike(r"^[\s\[]*[0-9]{10}([0-9]{3}|[0-9]{6}|[0-9]{9})?([.][0-9]+)?[\s\]]*$|[Zz][\s\]]*$|[+-][0-9]{2}:?[0-9]{2}[\s\]]*$"), F.lit(None)).otherwise(F.col("zone")).alias("zone"),
            F.when(F.col("raw").rlike(NO_YEAR), F.year(F.timestamp_millis("arrival"))).cast("int").alias("hint"),
        )
    )
    dictionary = cut(build_dictionary(rows.filter(hopeful))) if dictionary_path is None else extend_dictionary(df.sparkSession, dictionary_path, rows.filter(hopeful))
    # null-safe keys as plain equalities, so that the join hashes on them
    key = [F.col("raw"), F.coalesce("zone", F.lit("")), F.coalesce("hint", F.lit(0))]
    left = rows.select("arrival", *(f"k_{n}" for n in keep), *(c.alias(f"j{i}") for i, c in enumerate(key)))
    right = dictionary.filter(F.size("instants") > 0).select("instants", *(c.alias(f"j{i}") for i, c in enumerate(key)))
    fitting = F.array_max(F.filter("instants", lambda t: t <= F.col("arrival")))
    return left.join(right, ["j0", "j1", "j2"], "left" if unreadable else "inner").select(
        *(F.col(f"k_{n}").alias(n) for n in keep), F.coalesce(fitting, F.array_min("instants")).alias("t")
    )


def line_instants(df: DataFrame, sources: DataFrame, raw: Column, source: Column, arrival: Column, keep: dict[str, Column]) -> DataFrame:
    """All rows with the columns `keep` and `t`, null where the string denotes no instant.

    Strings of exactly 13 digits are epoch milliseconds as they stand; the rest goes through normalise().
    """
    millis = F.coalesce(raw.rlike(r"^[0-9]{13}\z"), F.lit(False))
    plain = df.filter(millis).select(*(c.alias(n) for n, c in keep.items()), raw.cast("long").alias("t"))
    return plain.unionByName(normalise(df.filter(~millis), sources, raw, source, arrival, keep, unreadable=True))


def restored(df: DataFrame, segment: Column, position: Column, delta: Column) -> DataFrame:
    """df with `t`, the instant of each record of a segment: the sum of the differences up to its position.

    The first record of a segment holds the absolute time.  All copies of a (segment, position) stay and have the same
    instant, their difference counting once; a null difference counts as none.  Rows without segment or position have
    no instant.  One shuffle by segment.
    """
    placed = segment.isNotNull() & position.isNotNull()
    w = Window.partitionBy(segment).orderBy(position)
    before = F.lag(position).over(Window.partitionBy(segment).orderBy(position, delta.asc_nulls_last()))
    step = F.when(placed & ~before.eqNullSafe(position), delta.cast("long"))
    # the window's range holds all copies of a position, so that each has the whole sum
    return df.withColumn("_step", step).withColumn("t", F.when(placed, F.sum("_step").over(w))).drop("_step")
