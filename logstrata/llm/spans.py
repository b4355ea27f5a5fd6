"""Long spans that recur verbatim in other documents, by repeated-phrase automata.

1. Winnowing picks phrases of PHRASE characters such that any span of min_chars holds one, picked alike in every document
   that has the span.  Only their 64-bit hashes move; those of two or more different texts are candidates.
2. The candidates' phrases are cut out where the documents lie, and those that two or more different texts hold, character
   for character, are confirmed.
3. The confirmed phrases are sharded by the parts of the corpus that hold any of their candidates.  Every part compiles an
   Aho-Corasick automaton of its shard and streams all its documents through it, which locates every occurrence.  No
   place is handed on from the first step, and no text is shuffled but that of phrases and their surroundings.
4. Occurrences with equal surroundings form a class.  Classes share a span where one of the spans around the phrase has the
   same hash in both: first those on a coarse grid are compared, then those between two grid points where the grid
   leaves it open.  Equal spans meet by their hash; no pairs are formed, however large a group is.

Exact copies are one text throughout and are expanded only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.session import bound_batches, broadcast_if_small, cut, read_part, written

MIN_CHARS = 300
#: Characters of a phrase.  Of the min_chars - PHRASE + 1 phrases of a span one is picked.
PHRASE = 100
#: Characters hashed at once, rows of a part, and phrases of one automaton; they bound a worker's memory.
CHUNK, PART_ROWS, AUTOMATON = 1 << 20, 1024, 20_000
#: Intervals of the grid of spans around a phrase.
INTERVALS = 8
#: Candidate hashes that may be broadcast; beyond it the join shuffles.
BROADCAST_HASHES = 1_000_000
_SIGNATURE = "part bigint, doc bigint, h1 bigint, h2 bigint, n_chars int, hashes array<bigint>, places array<int>"
_OCCURRENCE = "doc bigint, place int, lead int, width int, c1 bigint, c2 bigint, around string"
_INDEX_MASK = np.uint64((1 << 24) - 1)
# Odd multipliers of the rolling and of the mixing hash.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0][0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(n + 1, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        _powers[0] = tuple(tables)
    return _powers[0]


def _sliding(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, in three passes: minima from block starts and to block ends meet in each window."""
    n = len(a)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = a
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def pick(texts: list[str], phrase: int = PHRASE, min_chars: int = MIN_CHARS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the (hashes, places) of its picked phrases; a text shorter than min_chars has none.

    In every window of min_chars characters the phrase with the least hash is picked, the last one of equals, so the choice
    depends on nothing outside the window.
    """
    window = min_chars - phrase + 1
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    if n < min_chars:
        return [none] * len(texts)
    power, inverse = _power_tables(n + 1)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * power[:n], out=summed[1:])
    h = (summed[phrase:] - summed[:-phrase]) * inverse[: n - phrase + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    index = np.arange(len(h), dtype=np.uint64)
    least = _sliding((h & ~_INDEX_MASK) | (_INDEX_MASK - index), window)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    out = []
    for end, length in zip(ends, lengths):
        if length < min_chars:
            out.append(none)
            continue
        at = (_INDEX_MASK - (least[end - length : end - min_chars + 1] & _INDEX_MASK)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        out.append((h[at].view(np.int64), (at - (end - length)).astype(np.int32)))
    return out


def _chunks(text: str, min_chars: int) -> Iterator[tuple[int, str]]:
    """A very long text in parts that overlap by a window less one, so that every window lies within a part."""
    for start in range(0, max(1, len(text) - min_chars + 1), CHUNK):
        yield start, text[start : start + CHUNK + min_chars - 1]


def _digests(texts: list[str]) -> np.ndarray:
    """Two 64-bit halves of a hash of each text."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64).reshape(-1, 2)


def _sign(min_chars: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts = pdf["text"].tolist()
            parts = [(i, start, part) for i, t in enumerate(texts) for start, part in _chunks(t, min_chars)]
            picked: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
            lot: list[tuple[int, int, str]] = []
            size = 0
            for k, part in enumerate(parts):
                lot.append(part)
                size += len(part[2])
                if size >= CHUNK or k == len(parts) - 1:
                    for (i, start, _), (hashes, places) in zip(lot, pick([x[2] for x in lot], min_chars=min_chars)):
                        picked[i].append((hashes, places + np.int32(start)))
                    lot, size = [], 0
            h = _digests(texts)
            yield pd.DataFrame(
                {"part": pdf["part"], "doc": pdf["doc"], "h1": h[:, 0], "h2": h[:, 1], "n_chars": np.array([len(t) for t in texts], np.int32),
                 "hashes": [np.concatenate([x[0] for x in p]) for p in picked], "places": [np.concatenate([x[1] for x in p]) for p in picked]}
            )

    return run


def _by_part(batches: Iterator[pd.DataFrame], path: str) -> Iterator[tuple[int, pd.DataFrame, pd.DataFrame | None, bool]]:
    """(part, rows, what the table at path holds for the part, whether the part is new); parts lie one after the other."""
    part, held = None, None
    for pdf in batches:
        for value, rows in pdf.groupby("part", sort=False):
            fresh = value != part
            if fresh:
                table = read_part(path, "part", int(value))
                part, held = value, None if table is None else table.to_pandas(integer_object_nulls=True)
            yield part, rows, held, fresh


def _cut_out(path: str):  # noqa: ANN202
    """Phrases at the candidates' places, where the documents lie: (part, phrase, digest of the text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict[tuple[int, int], list[int]] = {}
        for part, rows, held, fresh in _by_part(batches, path):
            if held is None:
                continue
            if fresh:
                wanted = {(d, h): list(p) for d, h, p in held[["doc", "h1", "places"]].itertuples(index=False, name=None)}
                docs = {d for d, _ in wanted}
            rows = rows[rows["doc"].isin(docs)]
            texts = rows["text"].tolist()
            found = []
            for doc, text, h1 in zip(rows["doc"], texts, _digests(texts)[:, 0].tolist() if texts else ()):
                found += [(part, text[p : p + PHRASE], h1) for p in wanted.get((doc, h1), ())]
            if found:
                yield pd.DataFrame(found, columns=["part", "phrase", "h1"]).drop_duplicates()

    return run


def _locate(min_chars: int, path: str):  # noqa: ANN202
    """Every occurrence of the shard's phrases in the documents of a part, with what stands around it."""
    reach = min_chars - PHRASE

    def automata(phrases: list[str]) -> list:
        import ahocorasick

        out = []
        for start in range(0, len(phrases), AUTOMATON):
            automaton = ahocorasick.Automaton()
            for p in phrases[start : start + AUTOMATON]:
                automaton.add_word(p, None)
            automaton.make_automaton()
            out.append(automaton)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: list = []
        copies: set[tuple[int, int]] = set()
        for _, rows, held, fresh in _by_part(batches, path):
            if held is None:
                continue
            if fresh:
                compiled = automata(held["phrase"].dropna().tolist())
                copies = set(held.loc[held["phrase"].isna(), ["doc", "h1"]].astype("int64").itertuples(index=False, name=None))
                copied = {d for d, _ in copies}
            found, texts = [], []
            for doc, text in zip(rows["doc"], rows["text"]):
                if doc in copied and (doc, int(_digests([text])[0, 0])) in copies:
                    continue
                seen: dict[tuple[int, str], int] = {}
                for automaton in compiled:
                    for end, _ in automaton.iter(text):
                        place = end - PHRASE + 1
                        start = max(0, place - reach)
                        around = text[start : place + PHRASE + reach]
                        key = (place - start, around)
                        if key not in seen:
                            seen[key] = len(texts)
                            texts.append(f"{place - start} {around}")
                            found.append((doc, place, place - start, len(around), seen[key], around))
                        else:  # the same surroundings again in this document prove nothing new about others
                            found.append((doc, place, place - start, len(around), seen[key], None))
            if found:
                out = pd.DataFrame(found, columns=["doc", "place", "lead", "width", "c", "around"])
                h = _digests(texts)[out.pop("c").to_numpy()]
                out["c1"], out["c2"] = h[:, 0], h[:, 1]
                yield out[["doc", "place", "lead", "width", "c1", "c2", "around"]]

    return run


class SharedSpans:
    """The spans of at least min_chars characters that documents have in common.

    df      documents; rows with a null id or text are left out, repeated ids with equal text count once
    A text shorter than min_chars shares nothing.  Characters are code points, line ends included.  Ids are assumed to
    name one text; of several texts under one id each is looked at and the results appear under the id.
    """

    def __init__(self, df: DataFrame, doc: Column, text: Column, min_chars: int = MIN_CHARS) -> None:
        if min_chars < 2 * PHRASE:
            raise ValueError(f"min_chars must be at least {2 * PHRASE}")
        bound_batches(df.sparkSession)
        self.min_chars, self.reach = min_chars, min_chars - PHRASE
        self.given = df.select(doc.cast("long").alias("doc"), text.alias("text"))
        held = self.given.filter(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
        #: the documents as a table, as the same rows must form the same parts whenever it is read
        self.docs = written(held.withColumn("part", F.shiftrightunsigned(F.monotonically_increasing_id(), PART_ROWS.bit_length() - 1)))
        self.signatures = cut(self.docs.mapInPandas(_sign(min_chars), _SIGNATURE))
        #: one row per text: its lowest document stands for all copies
        self.texts = cut(self.signatures.groupBy("h1", "h2", "n_chars").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")))
        self.occurrences = self._occurrences()
        self.classes = cut(
            self.occurrences.groupBy("c1", "c2").agg(
                F.max("around").alias("around"), F.max("lead").alias("lead"), F.max("width").alias("width"), F.min("doc").alias("a"), F.max("doc").alias("b"),
            )
        )

    def members(self) -> DataFrame:
        """(doc, rep): every document and the one that stands for its text, of those texts that have copies."""
        copies = self.texts.filter("rep <> last").select("h1", "h2", "n_chars", "rep")
        return self.signatures.select("doc", "h1", "h2", "n_chars").join(copies, ["h1", "h2", "n_chars"]).select("doc", "rep").distinct()

    def confirmed(self) -> DataFrame:
        """(part, phrase): phrases that two different texts hold, character for character, and the parts that hold them."""
        picks = self.signatures.select("part", "doc", "h1", F.explode(F.arrays_zip("hashes", "places")).alias("x"))
        recurring = cut(picks.groupBy(F.col("x.hashes").alias("h")).agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("h"))
        candidates = picks.select("part", "doc", "h1", F.col("x.hashes").alias("h"), F.col("x.places").alias("place")).join(broadcast_if_small(recurring, BROADCAST_HASHES), "h", "left_semi")
        places = written(candidates.groupBy("part", "doc", "h1").agg(F.collect_set("place").alias("places")).repartition("part"), "part")
        cuts = cut(self.docs.select("part", "doc", "text").mapInPandas(_cut_out(places.path), "part bigint, phrase string, h1 bigint"))
        known = cuts.groupBy("phrase").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("phrase")
        return cuts.select("part", "phrase").distinct().join(known, "phrase", "left_semi")

    def _occurrences(self) -> DataFrame:
        copies = self.texts.filter("rep <> last").select("h1", "h2", "n_chars", "rep")
        skipped = self.signatures.select("part", "doc", "h1", "h2", "n_chars").join(copies, ["h1", "h2", "n_chars"]).filter("doc <> rep").select("part", "doc", "h1")
        none = F.lit(None).cast("long")
        shards = self.confirmed().select("part", "phrase", none.alias("doc"), none.alias("h1")).unionByName(skipped.select("part", F.lit(None).cast("string").alias("phrase"), "doc", "h1"))
        self.shards = written(shards.repartition("part"), "part")
        return cut(self.docs.select("part", "doc", "text").mapInPandas(_locate(self.min_chars, self.shards.path), _OCCURRENCE))

    def cells(self, extremes: bool = False) -> DataFrame:
        """(e1, e2, c1, c2, off, len): sets of classes that share one span, and where it lies relative to the phrase.

        A span around a phrase is named by its lead, the characters before the phrase.  Two classes share a span of some
        lead exactly if they share that of all leads in an interval, so those on a grid are tested first.  Between two
        grid points, the part that all spans there have in common tells which classes may share one; where the grid has
        not settled it for all of them, every lead is tested.  It is settled if all have one of the two grid points'
        spans in common, or, if the extremes of what is shared are wanted, both.
        """
        n, reach = self.min_chars, self.reach
        grid = sorted({*range(0, reach, max(1, reach // INTERVALS)), reach})
        fits = lambda lead, length: (F.col("lead") >= lead) & (F.col("width") - F.col("lead") + lead >= length)
        piece = lambda lead, length: F.substr("around", F.col("lead") - lead + 1, F.lit(length) if isinstance(length, int) else length)
        e1, e2 = lambda text: F.xxhash64(text), lambda text: F.xxhash64(F.lit(7), text)
        own = ["cid", "a", "b"]
        # a number for each class, as it travels often; the classes are a checkpoint, so it stays the same
        classes = self.classes.withColumn("cid", F.monotonically_increasing_id())
        window = {g: F.when(fits(g, n), e1(piece(g, n))) for g in grid}
        inner = [(g, h, n - (h - g)) for g, h in zip(grid, grid[1:])]
        keyed = classes.select(
            *own, "lead", "width", "around",
            F.explode(F.array(*(F.when(fits(g, m), F.struct(F.lit(g).alias("g"), F.lit(h).alias("h"), e1(piece(g, m)).alias("k"), window[g].alias("low"), window[h].alias("high"))) for g, h, m in inner if h - g > 1))).alias("x"),
        ).filter("x is not null").select(*own, "lead", "width", "around", "x.*")
        one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
        settled = one("low") & one("high") if extremes else one("low") | one("high")
        grouped = keyed.groupBy("g", "k").agg((F.min("a") != F.max("b")).alias("shared"), F.coalesce(settled, F.lit(False)).alias("settled"))
        unsettled = cut(grouped.filter("shared and not settled").select("g", "k"))
        spans = lambda rows, leads: rows.select(*own, "lead", "width", "around", F.explode(leads).alias("at")).filter(
            (F.col("lead") >= F.col("at")) & (F.col("width") - F.col("lead") + F.col("at") >= n)
        ).select(*own, "at", e1(piece(F.col("at"), n)).alias("e1"), e2(piece(F.col("at"), n)).alias("e2"))
        between = keyed.join(broadcast_if_small(unsettled), ["g", "k"], "left_semi")
        tested = cut(spans(classes, F.array(*map(F.lit, grid))).unionByName(spans(between, F.sequence(F.col("g") + 1, F.col("h") - 1))))
        shared = tested.groupBy("at", "e1", "e2").agg(F.min("a").alias("x"), F.max("b").alias("y"), F.sum(F.xxhash64("cid").bitwiseAND(F.lit((1 << 40) - 1))).alias("sig"), F.count(F.lit(1)).alias("n"))
        rows = tested.join(shared.filter("x <> y").drop("x", "y"), ["at", "e1", "e2"])
        # spans of two leads that the same classes have, and all between them, are one longer span
        w = Window.partitionBy("cid").orderBy("at")
        follows = (F.lag("sig").over(w) == F.col("sig")) & (F.lag("n").over(w) == F.col("n"))
        runs = rows.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(w)).groupBy("cid", "run").agg(
            F.min("at").alias("low"), F.max("at").alias("high"), F.min_by("e1", "at").alias("e1"), F.min_by("e2", "at").alias("e2")
        )
        found = runs.join(classes.select("cid", "c1", "c2"), "cid").select("e1", "e2", "c1", "c2", (-F.col("high")).alias("off"), (F.col("high") - F.col("low") + n).alias("len"))
        # and a class in itself, if two documents have it
        same = self.classes.filter((F.col("a") != F.col("b")) & (F.col("width") >= n)).select(
            F.col("c1").alias("e1"), F.col("c2").alias("e2"), "c1", "c2", (-F.col("lead")).alias("off"), F.col("width").alias("len")
        )
        return cut(found.unionByName(same))

    def spans(self, extremes: bool = True) -> DataFrame:
        """(doc, cell1, cell2, start, length): where a document has a span that the other documents of the cell have too."""
        places = self.occurrences.select("doc", "c1", "c2", "place")
        return self.cells(extremes).join(places, ["c1", "c2"]).select(
            "doc", F.col("e1").alias("cell1"), F.col("e2").alias("cell2"), (F.col("place") + F.col("off")).alias("start"), F.col("len").alias("length")
        )

    def class_pairs(self) -> DataFrame:
        """(class_a, class_b), class_a < class_b: pairs of texts with a common span, each named by its lowest document."""
        held = cut(self.spans(False).select("cell1", "cell2", "doc").distinct())
        a, b = held.withColumnRenamed("doc", "class_a"), held.withColumnRenamed("doc", "class_b")
        return a.join(b, ["cell1", "cell2"]).filter("class_a < class_b").select("class_a", "class_b").distinct()

    def membership(self) -> DataFrame:
        """(doc_id, class_id) of every document with an id and a text: the lowest document of the same text."""
        texts = self.given.filter("doc is not null and text is not null").select(
            F.col("doc").alias("doc_id"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2"), F.length("text").alias("n")
        )
        lowest = texts.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"))
        return texts.join(lowest, ["d1", "d2", "n"]).select("doc_id", "class_id").distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: all pairs of documents with a common span, copies expanded."""
        pairs = self.class_pairs().select(F.col("class_a").alias("doc_a"), F.col("class_b").alias("doc_b"))
        members = cut(self.members())
        for side in ("doc_a", "doc_b"):
            copies = members.select(F.col("rep").alias(side), F.col("doc").alias("copy"))
            pairs = pairs.join(copies, side, "left").select(F.coalesce("copy", side).alias(side), *(c for c in ("doc_a", "doc_b") if c != side))
        x, y = members.withColumnRenamed("doc", "doc_a"), members.withColumnRenamed("doc", "doc_b")
        within = x.join(y, "rep").filter("doc_a < doc_b").select("doc_a", "doc_b")
        return pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).unionByName(within).filter("doc_a < doc_b").distinct()

    def stretches(self) -> DataFrame:
        """(doc_id, start, length): the maximal stretches of each document that lie in spans other documents have too."""
        w = Window.partitionBy("doc").orderBy("start", "end")
        placed = self.spans().select("doc", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
        reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        begun = placed.withColumn("fresh", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        merged = begun.groupBy("doc", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        copied = cut(self.members())
        whole = self.signatures.select("doc", "n_chars").join(copied, "doc").groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
        parts = merged.join(copied.select("doc"), "doc", "left_anti")
        return parts.select(F.col("doc").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("length")).unionByName(
            whole.select(F.col("doc").alias("doc_id"), F.lit(0).alias("start"), F.col("n_chars").alias("length"))
        )

    def coverage(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars) of every document: its characters, and those in spans that occur elsewhere too.

        A null text has none.  Documents shorter than a span share nothing.
        """
        shared = self.stretches().groupBy("doc_id").agg(F.sum("length").alias("shared"))
        all_docs = self.given.filter("doc is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
        return all_docs.join(shared, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"))
