"""Occurrences and record frequencies of all terms and term n-grams, by suffix-sorted counting.

Every record is a sequence of terms.  Its suffixes, truncated to `sigma` terms, are combined on the map side with their
multiplicity, routed by their first term, sorted in reverse lexicographic order, and read once with a stack: all prefixes of
all suffixes are counted without ever materialising them.  Record sets are not carried: a suffix knows the length of its
longest prefix that an earlier suffix of the same record already had, and prefixes up to that length don't count the
record again.  That makes the state two numbers, which add up across partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.session import cut, partitions

#: Entries of the map-side table; beyond it, its counts are handed on and a new one is begun.
TABLE_ENTRIES = 200_000


def suffixes(terms: list[str], sigma: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """The truncated suffixes of a record, each with the length of its longest prefix that an earlier one has."""
    seen: set[tuple[str, ...]] = set()
    for i in range(len(terms)):
        suffix = tuple(terms[i : i + sigma])
        known = 0
        for length in range(1, len(suffix) + 1):
            prefix = suffix[:length]
            if prefix in seen:
                known = length
            else:
                seen.add(prefix)
        yield suffix, known


def _emit(sigma: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: Counter[tuple[tuple[str, ...], int]] = Counter()
        # suffixes of one term need no tuples: those that are new to their record, and those that it already had
        single: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            counts = [(list(s), k, n) for (s, k), n in table.items()]
            for known, terms in enumerate(single):
                counts += [([t], known, n) for t, n in terms.items()]
                terms.clear()
            table.clear()
            return pd.DataFrame(counts, columns=["suffix", "known", "n"])

        for pdf in batches:
            table[(), 0] += len(pdf)  # the empty prefix counts the records
            for terms in pdf["terms"]:
                if terms is None or not len(terms):
                    continue
                if sigma > 1:
                    table.update(suffixes(list(terms), sigma))
                else:
                    distinct = set(terms)
                    single[0].update(distinct)
                    if len(distinct) < len(terms):
                        single[1].update(Counter(terms) - Counter(distinct))
                if len(table) + len(single[0]) > TABLE_ENTRIES:
                    yield flush()
        if table:
            yield flush()

    return run


def stack_counts(rows: Iterator[tuple[list[str], int, int]]) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """Counts of all prefixes from suffixes in reverse lexicographic order: (prefix, occurrences, records).

    rows are (suffix, known, n).  The stack holds the current suffix; what leaves it is complete and adds its counts to
    the shorter prefix below.
    """
    terms: list[str] = []
    occurrences, records = [0], [0]  # one entry more than terms: that of the empty prefix, which gathers the sum
    for suffix, known, n in rows:
        common = 0
        while common < len(terms) and common < len(suffix) and terms[common] == suffix[common]:
            common += 1
        while len(terms) > common:
            o, r = occurrences.pop(), records.pop()
            yield tuple(terms), o, r
            terms.pop()
            occurrences[-1] += o
            records[-1] += r
        for t in suffix[common:]:
            terms.append(t)
            occurrences.append(0)
            records.append(0)
        occurrences[len(suffix)] += n
        records[len(suffix)] += n
        records[known] -= n
    while terms:
        o, r = occurrences.pop(), records.pop()
        yield tuple(terms), o, r
        terms.pop()
        occurrences[-1] += o
        records[-1] += r


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple[list[str], int, int]]:
        for pdf in batches:
            yield from zip(pdf["suffix"], pdf["known"], pdf["n"])

    found: list[tuple[tuple[str, ...], int, int]] = []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame({"gram": [list(g) for g, _, _ in found], "occurrences": [o for _, o, _ in found], "records": [r for _, _, r in found]})
        found.clear()
        return out

    for item in stack_counts(rows()):
        found.append(item)
        if len(found) >= 50_000:
            yield frame()
    if found:
        yield frame()


def count_ngrams(records: DataFrame, terms: Column, sigma: int = 1) -> tuple[DataFrame, int]:
    """((gram array<string>, occurrences, records), number of records) for every n-gram of up to sigma terms.

    A record without terms (null or empty) counts as a record only.  terms must hold no nulls.  Suffixes of a term that
    holds a third of all rows are combined before the shuffle and, beyond single terms, spread by their second term; the
    partial counts of single terms then add up.  Nothing is dropped at any frequency.
    """
    n = partitions(records)
    table = (
        records.select(terms.alias("terms"))
        .mapInPandas(_emit(sigma), "suffix array<string>, known int, n bigint")
        .groupBy("suffix", "known")
        .agg(F.sum("n").alias("n"))
    )
    table = cut(table)
    total = table.filter(F.size("suffix") == 0).agg(F.sum("n")).first()[0] or 0
    # equal first terms meet, whole suffixes never split further than by their second term
    route = [F.get("suffix", F.lit(0))] + ([F.get("suffix", F.lit(1))] if sigma > 1 else [])
    counted = (
        table.filter(F.size("suffix") > 0)
        .repartition(n, *route)
        .sortWithinPartitions(F.col("suffix").desc())
        .mapInPandas(_count, "gram array<string>, occurrences bigint, records bigint")
    )
    if sigma > 1:
        counted = counted.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counted, int(total)


def mark(counts: DataFrame, n_records: int, rare_below: int = 3, common_over: float = 0.02) -> DataFrame:
    """Add `mark`: 'rare' if fewer than rare_below records hold the gram, else 'common' if more than the share do, else null."""
    threshold = F.lit(round(common_over * 10_000) * n_records)
    return counts.withColumn(
        "mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 10_000 > threshold, "common")
    )


def template_terms(records: DataFrame) -> DataFrame:
    """The distinct records of a template_records table as terms: one row (terms) per (segment_id, original_idx).

    Re-delivered rows count once; null ids form a key of their own.  A term is `pat_id` in decimal or a parameter's type
    and bytes in upper-case hex, marked by its field; null ids, null parameters and null bytes are no terms, a null
    type is written as an empty string.
    """
    unique = records.select("segment_id", "original_idx", "pat_id", "params").dropDuplicates(["segment_id", "original_idx"])
    values = F.transform(
        F.filter(F.coalesce("params", F.array()), lambda p: p.isNotNull() & p["bytes"].isNotNull()),
        lambda p: F.concat_ws("|", F.lit("bytes"), F.coalesce(p["ty"].cast("string"), F.lit("")), F.hex(p["bytes"])),
    )
    pattern = F.when(F.col("pat_id").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat_ws("|", F.lit("pat_id"), F.lit("-1"), F.col("pat_id").cast("string"))))
    return unique.select(F.concat(pattern, values).alias("terms"))


def value_columns(counts: DataFrame) -> DataFrame:
    """Single terms of template_terms back to columns: (field, ty, val, ...)."""
    part = F.split(F.get("gram", F.lit(0)), r"\|", 3)
    rest = [c for c in counts.columns if c != "gram"]
    return counts.filter(F.size("gram") == 1).select(
        part[0].alias("field"), F.when(part[1] != "", part[1]).cast("int").alias("ty"), part[2].alias("val"), *rest
    )
