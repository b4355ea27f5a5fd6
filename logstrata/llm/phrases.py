"""Held-out passages in a corpus, by a distributed positional inverted index.

The index is partitioned by document: a segment row holds the positional postings of some documents, the way a search
engine's shard does, so building it moves no text and no posting.  Words that no query holds need no list: a phrase is
found from its own words only, and a gap in the positions breaks a match just as another word would.  A search goes over
the segments; in each, every window of a query is looked up by its rarest word (by the counts of the whole corpus), and the
offset-adjusted lists of the other words are intersected with that one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.session import bound_batches, cut

WORD = re.compile(r"[^\W_]+")
#: Words after which a segment is closed.
SEGMENT_WORDS = 500_000
#: Offsets that are intersected at once.
CANDIDATES = 1 << 21
#: Rows and characters of a block of queries, which driver and executors hold in memory.
BLOCK_QUERIES, BLOCK_CHARS = 100_000, 32 << 20
#: Positions between two documents, larger than any gap that proximity may bridge.
MARGIN = 64
_SEGMENT = "term_ids array<int>, starts array<int>, positions array<int>, doc_starts array<int>, doc_ids array<bigint>"


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, without regard to case."""
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.casefold() for w in WORD.findall(text)]


def _segments(vocabulary: dict[str, int]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray] = []
        docs: list[int] = []
        size = 0
        get = vocabulary.get

        def close() -> pd.DataFrame:
            nonlocal ids, docs, size
            starts = np.zeros(len(ids), np.int64)
            np.cumsum([len(x) + MARGIN for x in ids[:-1]], out=starts[1:])
            term = np.concatenate(ids)
            pos = np.concatenate([np.arange(s, s + len(x)) for s, x in zip(starts, ids)])
            term, pos = term[term >= 0], pos[term >= 0]
            order = np.argsort(term, kind="stable")
            term, pos = term[order], pos[order]
            known, first = np.unique(term, return_index=True)
            out = pd.DataFrame(
                {"term_ids": [known.astype(np.int32)], "starts": [np.append(first, len(term)).astype(np.int32)], "positions": [pos.astype(np.int32)],
                 "doc_starts": [starts.astype(np.int32)], "doc_ids": [np.array(docs, np.int64)]}
            )
            ids, docs, size = [], [], 0
            return out

        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"]):
                found = words(text)
                if not found or doc != doc:
                    continue
                ids.append(np.fromiter((get(w, -1) for w in found), np.int32, len(found)))
                docs.append(doc)
                size += len(found) + MARGIN
                if size >= SEGMENT_WORDS:
                    yield close()
        if ids:
            yield close()

    return run


def query_terms(queries: dict[int, str]) -> tuple[dict[str, int], dict[int, np.ndarray]]:
    """The vocabulary of the queries, and each query as term ids."""
    vocabulary: dict[str, int] = {}
    return vocabulary, {q: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int32) for q, t in queries.items()}


def build_index(docs: DataFrame, doc: Column, text: Column, vocabulary: dict[str, int]) -> DataFrame:
    """Positional postings of the words of `vocabulary` in all documents, one row per segment.

    In a segment, postings of term_ids[i] are positions[starts[i]:starts[i+1]], ascending; document j occupies the
    positions from doc_starts[j] on.  Whole texts are indexed.  Null or empty texts and null ids have no postings.
    """
    bound_batches(docs.sparkSession)
    return docs.select(doc.cast("long").alias("doc"), text.alias("text")).filter("doc is not null and text is not null").mapInPandas(_segments(vocabulary), _SEGMENT)


def term_counts(index: DataFrame) -> dict[int, int]:
    """Postings of each indexed term in the whole corpus; as large as the queries' vocabulary."""
    return dict(
        index.select(F.explode(F.expr("transform(term_ids, (t, i) -> struct(t as term, starts[i + 1] - starts[i] as n))")).alias("x"))
        .groupBy("x.term").agg(F.sum("x.n")).collect()
    )


def anchors(query: np.ndarray, length: int, counts: dict[int, int]) -> list[int]:
    """Positions of the query such that every window of `length` words holds one, each the rarest of a window.

    The window that ends furthest left without an anchor chooses next, so no window is left out.
    """
    n = [counts.get(int(t), 0) for t in query]
    out: list[int] = []
    last = -1
    for start in range(len(query) - length + 1):
        if last < start:
            last = min(range(start, start + length), key=lambda p: (n[p], -p))
            out.append(last)
    return out


def _flat(queries: dict[int, np.ndarray], plan: dict[int, list[int]]) -> dict[str, np.ndarray]:
    """The queries one after the other, and their anchors by term: (ids, starts, terms) and (term, query, place)."""
    ids = np.array(list(queries), np.int64)
    starts = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(t) for t in queries.values()], out=starts[1:])
    terms = np.concatenate(list(queries.values())).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    owner = np.array([k for k, q in enumerate(queries) for _ in plan[q]], np.int64)
    place = np.array([p for q in queries for p in plan[q]], np.int64)
    term = terms[starts[owner] + place]
    order = np.argsort(term, kind="stable")
    return {"ids": ids, "starts": starts, "terms": terms, "term": term[order], "owner": owner[order], "place": place[order]}


def _search(queries: dict[int, np.ndarray], plan: dict[int, list[int]], length: int, slop: int):  # noqa: ANN202
    flat = _flat(queries, plan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for terms, starts, positions, doc_starts, doc_ids in pdf.itertuples(index=False):
                found = _bulk(flat, terms, starts, positions, length) if slop == 0 else _windows(queries, flat, terms, starts, positions, length, slop)
                if len(found[0]):
                    at, q, first, n = found
                    d = np.searchsorted(doc_starts, at, side="right") - 1
                    yield pd.DataFrame({"doc_id": doc_ids[d], "item_id": q, "doc_word": at - doc_starts[d], "item_word": first, "n_words": n})

    return run


def _contains(sorted_list: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, wanted)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == wanted


def _present(flat: dict[str, np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors whose term the segment has, and the number of that term in it."""
    at = np.searchsorted(terms, flat["term"])
    at[at == len(terms)] = 0
    here = np.flatnonzero(terms[at] == flat["term"]) if len(terms) else np.zeros(0, np.int64)
    return here, at[here]


def _bulk(flat: dict[str, np.ndarray], terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Passages of all queries in a segment: (position of the first word, query, query position of it, words).

    The list of an anchor's term, less the anchor's place, holds the offsets at which its query may lie.  The lists of the
    next words, adjusted likewise, are intersected with it, to the right and then to the left, as long as any offset
    is left; those of all queries at once, since (term, position) is one sorted key in the index.
    """
    keys = (np.repeat(terms.astype(np.int64), np.diff(starts)) << 32) | positions
    here, at = _present(flat, terms)
    counts = np.diff(starts)[at].astype(np.int64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    lot = np.cumsum(counts) // CANDIDATES
    for k in np.unique(lot):
        of = np.flatnonzero(lot == k)
        n = counts[of]
        anchor = np.repeat(here[of], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        position = positions[np.repeat(starts[at[of]].astype(np.int64), n) + within].astype(np.int64)
        owner, place = flat["owner"][anchor], flat["place"][anchor]
        base, size = flat["starts"][owner], flat["starts"][owner + 1] - flat["starts"][owner]
        reach = np.zeros((2, len(anchor)), np.int64)
        for side, step in enumerate((1, -1)):
            # who cannot reach the length with all the words of the other side is out
            alive = np.arange(len(anchor)) if side == 0 else np.flatnonzero(reach[0] + 1 + place >= length)
            distance = 0
            while len(alive):
                distance += 1
                word = place[alive] + step * distance
                inside = (word >= 0) & (word < size[alive])
                alive, word = alive[inside], word[inside]
                alive = alive[_contains(keys, (flat["terms"][base[alive] + word] << 32) | (position[alive] + step * distance))] if len(alive) else alive
                reach[side, alive] = distance
        hit = np.flatnonzero(reach.sum(axis=0) + 1 >= length)
        for values, column in zip((position[hit] - reach[1, hit], flat["ids"][owner[hit]], place[hit] - reach[1, hit], reach[:, hit].sum(axis=0) + 1), out):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _windows(queries: dict[int, np.ndarray], flat: dict[str, np.ndarray], terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, length: int, slop: int) -> tuple[np.ndarray, ...]:
    """Like _bulk(), for windows with other words in between; only anchors whose term the segment has are looked at."""
    lists = {int(t): positions[a:b].astype(np.int64) for t, a, b in zip(terms, starts[:-1], starts[1:])}
    rows = []
    for k in _present(flat, terms)[0]:
        q = int(flat["ids"][flat["owner"][k]])
        rows += [(at, q, first, n) for at, first, n in _near(int(flat["place"][k]), queries[q], lists, length, slop)]
    return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def _near(p: int, query: np.ndarray, lists: dict[int, np.ndarray], length: int, slop: int) -> list[tuple[int, int, int]]:
    """Windows of `length` query words holding p that occur in order with at most `slop` words between neighbours."""
    here, out = lists[int(query[p])], []
    steps = np.arange(1, slop + 2)
    for s in range(max(0, p - length + 1), min(p, len(query) - length) + 1):
        alive = np.arange(len(here))  # places of word p from which both ends of the window are reached
        for direction, ks in ((1, range(p + 1, s + length)), (-1, range(p - 1, s - 1, -1))):
            owner, at = alive, here[alive]
            for k in ks:
                postings = lists.get(int(query[k]))
                if postings is None or not len(owner):
                    owner = owner[:0]
                    break
                owner, at = np.repeat(owner, len(steps)), (at[:, None] + direction * steps).ravel()
                there = _contains(postings, at)
                owner, at = owner[there], at[there]
                if len(owner) > 1:  # several ways may lead to one place
                    fresh = np.unique(np.stack([owner, at]), axis=1)
                    owner, at = fresh[0], fresh[1]
            alive = np.unique(owner)
            if not len(alive):
                break
        out += [(int(x), s, length) for x in here[alive]]
    return out


def phrase_matches(docs: DataFrame, doc: Column, text: Column, queries: dict[int, str], length: int = 12, slop: int = 0) -> DataFrame:
    """Passages of at least `length` consecutive words of a query that occur in a document.

    Result: (doc_id, item_id, doc_word, item_word, n_words).  With slop 0 the words are consecutive in the document too, a
    row is a maximal passage (repeated if several of its words were looked up), and doc_word and item_word are the
    numbers, from 0, of its first word.  With a slop, up to so many other words may stand between neighbours; a row is
    then a window of `length` words of the query and doc_word the place of its rarest word.  The queries are held in
    memory on driver and executors, so they must be a bounded set (bounded_queries checks); the documents are of any
    number and length; search_all() takes query sets of any size.  A query of fewer than `length` words matches nothing; equal queries each match; null or empty
    documents match nothing; repeated document ids give repeated rows.
    """
    if not 0 <= slop < MARGIN:
        raise ValueError(f"slop must be below {MARGIN}")
    vocabulary, terms = query_terms(queries)
    index = cut(build_index(docs, doc, text, vocabulary))
    counts = term_counts(index)
    if slop:  # every window with its own rarest word
        plan = {q: sorted({min(range(s, s + length), key=lambda p: counts.get(int(t[p]), 0)) for s in range(len(t) - length + 1)}) for q, t in terms.items()}
    else:
        plan = {q: anchors(t, length, counts) for q, t in terms.items()}
    live = {q: t for q, t in terms.items() if plan[q]}
    return index.mapInPandas(_search(live, plan, length, slop), "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint")


def bounded_queries(items: DataFrame, item: Column, text: Column, most: int = BLOCK_QUERIES, chars: int = BLOCK_CHARS) -> dict[int, str]:
    """The query set as a dictionary; more rows or characters than a block may have are refused before any is fetched."""
    slim = items.select(item.cast("long").alias("item"), text.alias("text")).filter("item is not null and text is not null")
    n, size, longest = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.max(F.length("text"))).first()
    if n > most or size > max(chars, longest or 0):
        raise ValueError(f"more than {most} queries or {chars} characters: search them with search_all")
    return {r[0]: r[1] for r in slim.collect()}


def search_all(
    docs: DataFrame, doc: Column, text: Column, items: DataFrame, item: Column, passage: Column, length: int = 12, slop: int = 0,
    most: int = BLOCK_QUERIES, chars: int = BLOCK_CHARS,
) -> DataFrame:
    """phrase_matches() for a query set of any size, in as many blocks as its rows and characters need.

    Items fall into blocks by a hash of their id; a block that is still too large is split again.  Every block is a
    pass over the documents.  Only a single text may be larger than a block.  Of several texts under one id the last in
    alphabetical order is searched.
    """

    def blocks(rows: DataFrame, salt: int) -> Iterator[dict[int, str]]:
        n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        if n <= most and size <= chars or n == 1:
            yield bounded_queries(rows, F.col("item"), F.col("text"), most, chars)
            return
        k = max(2, -(-2 * n // most), -(-2 * size // chars))
        if k > 2 * n:
            k = n
        for b in range(k):
            part = rows.filter(F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(k)) == b)
            if not part.isEmpty():
                yield from blocks(part, salt + 1)

    slim = items.select(item.cast("long").alias("item"), passage.alias("text")).filter("item is not null and text is not null").groupBy("item").agg(F.max("text").alias("text"))
    out: DataFrame | None = None
    for block in blocks(cut(slim), 0):
        found = phrase_matches(docs, doc, text, block, length, slop)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else phrase_matches(docs, doc, text, {}, length, slop)
