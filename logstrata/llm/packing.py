"""Texts into fixed-capacity containers: variable-capacity best fit.

Token counts are taken once per text, in parallel.  Then only (id, count) pairs move: they are spread over blocks of bounded
size, and each block is packed on its own.  A block holds thousands of containers, so what its last ones leave empty is
a small share, and no step sees more than one block.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.session import bound_batches, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts of a block.  A documented bound on what one task packs; the packing of a text never depends on other blocks.
BLOCK_ROWS = 20_000
# Fixed value: the same pattern for texts of ASCII characters only, in the syntax of the standard library.
ASCII_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
#: Token counts of pieces that a task remembers; the memory starts afresh beyond it.
REMEMBERED = 200_000
_PACKED = "container_id bigint, capacity_tokens int, position int, doc_id bigint, piece_no int, n_tokens int"


class _PieceCounts(dict):
    """Tokens of a piece, encoded when first asked for; the tokenizer never merges across pieces, so they add up."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.encode(piece))
        return n

    def tokens(self, text: str) -> int:
        if not text.isascii():
            return len(self.encode(text))
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, ASCII_PIECES.findall(text)))


def _counter(path: str):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _PieceCounts(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [0 if t is None else counts.tokens(t) for t in pdf["text"]]})

    return run


def count_tokens(docs: DataFrame, doc: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row with an id; a null or empty text has 0 tokens.  Whole texts are encoded."""
    bound_batches(docs.sparkSession)
    slim = docs.select(doc.cast("long").alias("doc_id"), text.alias("text")).filter("doc_id is not null")
    return slim.mapInPandas(_counter(tokenizer), "doc_id bigint, n_tokens bigint")


class _Sizes:
    """A multiset of sizes that finds the largest one not above a bound, or the smallest one not below it."""

    def __init__(self) -> None:
        self.bits = 0
        self.of: dict[int, list[int]] = {}

    def add(self, size: int, item: int) -> None:
        self.of.setdefault(size, []).append(item)
        self.bits |= 1 << size

    def pop(self, size: int) -> int:
        items = self.of[size]
        item = items.pop()
        if not items:
            self.bits &= ~(1 << size)
        return item

    def at_most(self, bound: int) -> int:
        return (self.bits & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound >= 0 else -1

    def at_least(self, bound: int) -> int:
        rest = self.bits >> bound
        return bound + (rest & -rest).bit_length() - 1 if rest else -1


def _trial(size: int, capacity: int, left: _Sizes, counts: dict[int, int]) -> int:
    """What a new container of `capacity` would hold if the largest fitting ones of the texts still left followed."""
    fill, used = size, {}
    bound = capacity - fill
    while bound > 0 and (s := left.at_most(bound)) > 0:
        if used.get(s, 0) < counts[s]:
            used[s] = used.get(s, 0) + 1
            fill += s
            bound = capacity - fill
        else:
            bound = s - 1
    return fill


def pack(sizes: list[int], capacities: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Containers as (capacity, [(index of the text, piece number, tokens)]).

    A text larger than the largest capacity is cut into pieces of that capacity and a rest; nothing else is split.  The
    pieces and texts, in decreasing size, each go where they leave the least space.  Where none has space, a container
    of the size is opened that is expected to waste least, given the texts still left; ties open the larger.  In the end
    every container is downsized to the smallest capacity that holds its contents.
    """
    capacities = sorted(set(capacities))
    top = capacities[-1]
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, size in enumerate(sizes):
        full, tail = divmod(size, top)
        done += [(top, [(i, k, top)]) for k in range(full)]
        if tail or not full:
            rest.append((i, full, tail))
    rest.sort(key=lambda x: (-x[2], x[0]))
    left, counts = _Sizes(), {}
    for _, _, size in rest:
        counts[size] = counts.get(size, 0) + 1
        left.bits |= 1 << size
    bins: list[list[tuple[int, int, int]]] = []
    space: list[int] = []
    gaps = _Sizes()
    for item in rest:
        size = item[2]
        counts[size] -= 1
        if not counts[size]:
            left.bits &= ~(1 << size)
        gap = gaps.at_least(size)
        if gap >= 0:
            b = gaps.pop(gap)
        else:
            best = None
            for c in capacities:
                if c >= size:
                    fill = _trial(size, c, left, counts)
                    kept = next(x for x in capacities if x >= fill)
                    cost = ((kept - fill) / kept, -c)
                    if best is None or cost < best[0]:
                        best = (cost, c)
            b = len(bins)
            bins.append([])
            space.append(best[1])
        bins[b].append(item)
        space[b] -= size
        gaps.add(space[b], b)
    for b in bins:
        fill = sum(x[2] for x in b)
        done.append((next(c for c in capacities if c >= fill), b))
    return done


def _pack_block(capacities: list[int]):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"])
        ids, block = pdf["doc_id"].tolist(), int(pdf["block"].iloc[0])
        rows = [
            ((block << 32) + c, capacity, position, ids[i], piece, size)
            for c, (capacity, items) in enumerate(pack(pdf["n_tokens"].tolist(), capacities))
            for position, (i, piece, size) in enumerate(items)
        ]
        return pd.DataFrame(rows, columns=["container_id", "capacity_tokens", "position", "doc_id", "piece_no", "n_tokens"])

    return run


def pack_tokens(counts: DataFrame, capacities: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pack (doc_id, n_tokens): (container_id, capacity_tokens, position, doc_id, piece_no, n_tokens), one row per text or piece.

    capacities are the container sizes permitted jointly.  Texts without tokens take a position and no space.  Repeated
    ids are packed as often as they come.  An empty input gives no rows.  Capacities must be positive.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    blocks = max(1, math.ceil(counts.count() / block_rows))
    # equal rows are numbered, so that repeated ids spread too and blocks don't depend on how the rows lie
    equal = counts.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("k"))
    each = equal.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("copy"))
    spread = each.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(blocks)).alias("block"))
    return spread.groupBy("block").applyInPandas(_pack_block(sorted(capacities)), _PACKED)


def pack_limits(docs: DataFrame, doc: Column, text: Column, limits: dict[str, int], tokenizer: str = TOKENIZER) -> DataFrame:
    """One packing per limit, its containers of at most that capacity: adds (limit_name, limit_tokens).

    Within a limit all listed capacities up to it are permitted, so the sizes are chosen jointly and a container that
    holds little ends as a smaller one.
    """
    counts = cut(count_tokens(docs, doc, text, tokenizer))
    out: DataFrame | None = None
    for name, capacity in sorted(limits.items(), key=lambda x: (x[1], x[0])):
        one = pack_tokens(counts, [c for c in limits.values() if c <= capacity]).select(F.lit(name).alias("limit_name"), F.lit(capacity).alias("limit_tokens"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return counts.sparkSession.createDataFrame([], "limit_name string, limit_tokens int, " + _PACKED)
    return out
