"""Runs of equal consecutive events, by associative run summaries.

The events are range-sorted by (sequence, position) into chunks of about equal size, so that one long sequence spreads
over many tasks.  Each chunk is encoded locally into runs.  Only the first and the last run of a chunk can go on in a
neighbour: these boundary runs, at most two per chunk, are merged by a prefix computation over the chunks, and runs that
span any number of chunks come out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.session import cut, partitions

_ENCODED = (
    "chunk int, ord bigint, is_first boolean, is_last boolean, sequence_id bigint, first_pos bigint, last_pos bigint,"
    " n_members bigint, k1 bigint, k2 bigint, eventful boolean, first_t bigint, last_t bigint,"
    " low_t bigint, high_t bigint, n_timed bigint"
)
#: A missing time, and what stands for it where the least is looked for.
_MISSING, _LARGEST = -(2**63), 2**63 - 1
_FIELDS = ("seq", "pos", "k1", "k2", "ok", "t")


def text_event(message: Column) -> Column:
    """The words of a message that make it the same event: lower case, in order, without tokens that hold a digit."""
    plain = F.regexp_replace(message, r"(?<!\S)\S*[0-9]\S*(?!\S)", " ")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}]+", " "))


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId()
    open_run: dict[str, np.ndarray] | None = None  # the run that may go on in the next batch, as one-row arrays
    last_key: tuple[int, int] | None = None
    emitted = 0

    def frame(r: dict[str, np.ndarray], first: bool, last: bool) -> pd.DataFrame | None:
        nonlocal emitted
        n = len(r["seq"])
        order = np.arange(emitted, emitted + n)
        is_first, is_last = (order == 0) & first, np.zeros(n, bool)
        if last and n:
            is_last[-1] = True
        emitted += n
        keep = (r["ok"] & (r["n"] > 1)) | is_first | is_last
        if not keep.any():
            return None
        out = pd.DataFrame(
            {"chunk": np.int32(chunk), "ord": order, "is_first": is_first, "is_last": is_last, "sequence_id": r["seq"], "first_pos": r["first"],
             "last_pos": r["last"], "n_members": r["n"], "k1": r["k1"], "k2": r["k2"], "eventful": r["ok"], "first_t": r["t0"], "last_t": r["t1"],
             "low_t": r["low"], "high_t": r["high"], "n_timed": r["timed"]}
        )
        return out[keep]

    for pdf in batches:
        a = {f: pdf[f].to_numpy() for f in _FIELDS}
        if not len(a["seq"]):
            continue
        # repeated deliveries lie side by side, the earliest first
        fresh = np.ones(len(a["seq"]), bool)
        fresh[1:] = (a["seq"][1:] != a["seq"][:-1]) | (a["pos"][1:] != a["pos"][:-1])
        fresh[0] = last_key != (a["seq"][0], a["pos"][0])
        last_key = (a["seq"][-1], a["pos"][-1])
        a = {f: v[fresh] for f, v in a.items()}
        if not len(a["seq"]):
            continue
        ok = a["ok"].astype(bool)
        new = np.ones(len(ok), bool)
        new[1:] = ~((a["seq"][1:] == a["seq"][:-1]) & (a["k1"][1:] == a["k1"][:-1]) & (a["k2"][1:] == a["k2"][:-1]) & ok[1:] & ok[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(ok)) - 1
        runs = {
            "seq": a["seq"][start], "first": a["pos"][start], "last": a["pos"][end], "n": end - start + 1, "k1": a["k1"][start],
            "k2": a["k2"][start], "ok": ok[start], "t0": a["t"][start], "t1": a["t"][end],
            "low": np.minimum.reduceat(np.where(a["t"] == _MISSING, _LARGEST, a["t"]), start), "high": np.maximum.reduceat(a["t"], start),
            "timed": np.add.reduceat((a["t"] != _MISSING).astype(np.int64), start),
        }
        if open_run is not None:
            same = all(open_run[f][0] == runs[f][0] for f in ("seq", "k1", "k2")) and open_run["ok"][0] and runs["ok"][0]
            if same:
                for f in ("first", "t0"):
                    runs[f][0] = open_run[f][0]
                for f in ("n", "timed"):
                    runs[f][0] += open_run[f][0]
                runs["low"][0] = min(runs["low"][0], open_run["low"][0])
                runs["high"][0] = max(runs["high"][0], open_run["high"][0])
            else:
                runs = {f: np.concatenate([open_run[f], runs[f]]) for f in runs}
        open_run = {f: v[-1:].copy() for f, v in runs.items()}
        if (out := frame({f: v[:-1] for f, v in runs.items()}, True, False)) is not None:
            yield out
    if open_run is not None and (out := frame(open_run, True, True)) is not None:
        yield out


def runs(df: DataFrame, sequence: Column, position: Column, event: Column, time: Column | None = None, chunks: int | None = None, extent: bool = False) -> DataFrame:
    """Maximal runs of two or more consecutive equal events.

    Result: (sequence_id, first_pos, last_pos, n_members, first_t, last_t), times being those of the first and the last
    member (null without `time`).  With `extent` also (low_t, high_t, n_timed): the earliest and the latest time of any
    member, as positions need not follow time, and the number of members that have one.  Consecutive means next existing position.  Rows of equal (sequence, position) count
    once, the one of the earliest time first.  A null event belongs to no run and ends one; rows without sequence or
    position have no place in an order and are left out.  Events are compared by two independent 64-bit hashes of
    their text.  No rows, or no runs, give an empty result.  Other columns are not read.
    """
    n = chunks or partitions(df)
    placed = df.select(
        sequence.cast("long").alias("seq"),
        position.cast("long").alias("pos"),
        event.alias("event"),
        (time if time is not None else F.lit(None)).cast("long").alias("t"),
    ).filter("seq is not null and pos is not null")
    # the raw text travels: it compresses better than hashes, and the event is computed after the shuffle, once
    sorted_rows = placed.repartitionByRange(n, "seq", "pos").sortWithinPartitions("seq", "pos", F.col("t").asc_nulls_last())
    found = merge_chunks(encode_chunks(sorted_rows))
    return found if extent else found.drop("low_t", "high_t", "n_timed")


def encode_chunks(sorted_rows: DataFrame) -> DataFrame:
    """Encode each partition of (seq, pos, event, t), sorted by seq, pos and t, into its runs."""
    hashed = sorted_rows.select(
        "seq", "pos",
        F.xxhash64("event").alias("k1"), F.xxhash64(F.lit(7), "event").alias("k2"), F.col("event").isNotNull().alias("ok"),
        F.coalesce("t", F.lit(_MISSING)).alias("t"),
    )
    return hashed.mapInPandas(_encode, _ENCODED)


def merge_chunks(encoded: DataFrame) -> DataFrame:
    """Join the runs that go on across chunk boundaries and return all runs of two or more members."""
    encoded = cut(encoded)
    edge = F.col("is_first") | F.col("is_last")
    inner = encoded.filter(~edge)
    # at most two rows per chunk, so one partition holds the boundaries of any number of rows
    w = Window.partitionBy("sequence_id").orderBy("chunk", "ord")
    before = lambda c: F.lag(c).over(w)
    goes_on = (
        F.col("is_first") & F.col("eventful") & before("eventful") & before("is_last") & (before("chunk") != F.col("chunk"))
        & (before("k1") == F.col("k1")) & (before("k2") == F.col("k2"))
    )
    grouped = (
        encoded.filter(edge)
        .withColumn("starts", F.when(goes_on, 0).otherwise(1))
        .withColumn("run", F.sum("starts").over(w))
        .groupBy("sequence_id", "run")
        .agg(
            F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n_members").alias("n_members"),
            F.min_by("first_t", "first_pos").alias("first_t"), F.max_by("last_t", "last_pos").alias("last_t"), F.bool_and("eventful").alias("eventful"),
            F.min("low_t").alias("low_t"), F.max("high_t").alias("high_t"), F.sum("n_timed").alias("n_timed"),
        )
    )
    cols = ["sequence_id", "first_pos", "last_pos", "n_members", "first_t", "last_t", "low_t", "high_t", "n_timed"]
    return (
        inner.select(*cols, "eventful")
        .unionByName(grouped.select(*cols, "eventful"))
        .filter("eventful and n_members > 1")
        .select(*cols[:4], *(F.when(~F.col(c).isin(_MISSING, _LARGEST), F.col(c)).alias(c) for c in cols[4:8]), "n_timed")
    )
