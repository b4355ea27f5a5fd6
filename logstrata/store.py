"""A persistent log store: segmented Parquet, metadata per segment, and a write-ahead log of what is not in a segment yet.

Layout below the store's path:
    wal/batch=N/                     JSON lines of appended rows; N rises with every append and is claimed by one writer alone
    data/run=R/segment_id=N/         rows (seq, chunk_id, t, s, l, m) in the order of arrival; R names one write
    segments/                        one metadata row per segment: a segment exists once its row does
    chunks/                          one metadata row per chunk
    templates/                       message templates per segment, if they were indexed

A batch appears in the log by one rename.  A flush writes the rows of the batches it takes under a run of its own, then registers
its segments together with what it has used of which batch, in one file, and only then deletes the batches.  A writer that
dies before the registration leaves files that nothing refers to and the batches as they were; one that dies after it leaves
batches that readers know as used.  Neither loses a row or shows one twice, and nobody's segments are ever overwritten.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logstrata.operators import manifest, segments
from logstrata.operators.search import has_keyword, in_range, overlaps
from logstrata.operators.templates import mine
from logstrata.schema import LOG_LINE, PARTS, CorruptSegment, InvalidInput
from logstrata.session import cut, ship

_META = (
    "segment_id long, run string, min_ts long, max_ts long, line_count long, level_mask int, raw_bytes long, trigrams binary, batch string,"
    " used array<struct<b: long, upto: long>>, replaces array<long>, created_at timestamp"
)
_CHUNKS = "segment_id long, run string, chunk_id int, min_ts long, max_ts long, line_count long, level_mask int, trigrams binary"
_WAL = "b LONG, i LONG, t LONG, s STRING, l STRING, m STRING"
_ROWS = "seq long, chunk_id int, t long, s string, l string, m string, run string, segment_id long"


@dataclass(frozen=True)
class StoreConfig:
    """Thresholds; segments are cut when as many rows or bytes wait in the log, and hold at most as many rows."""

    max_buffer_lines: int = 100_000
    max_buffer_bytes: int = 64 << 20
    chunk_size: int = 1024
    codec: str = "zstd"
    #: Segments whose ids are written into the plan as a list; beyond it they are joined.
    listed_segments: int = 5_000


class LogStore:
    """Append log lines and search them.  Reading never changes a store."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None) -> None:
        ship(spark)
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or StoreConfig()
        self._lock = threading.Lock()
        self._waiting: tuple[int, int] | None = None  # rows and bytes in the log, as far as this writer knows

    # -- files

    def _hadoop(self, name: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._hadoop(name)
        return fs.exists(p)

    def _delete(self, name: str) -> None:
        p, fs = self._hadoop(name)
        fs.delete(p, True)

    def _list(self, name: str) -> list[str]:
        p, fs = self._hadoop(name)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    # -- tables

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def segments(self) -> DataFrame:
        """Metadata, one row per segment."""
        rows = self._read("segments", _META)
        if not self._exists("compacted"):
            return rows
        gone = rows.select(F.explode("replaces").alias("segment_id")).distinct()
        return rows.join(gone, "segment_id", "left_anti")

    def chunks(self) -> DataFrame:
        """Metadata, one row per chunk of a segment."""
        return self._read("chunks", _CHUNKS)

    def data(self) -> DataFrame:
        """(segment_id, run, chunk_id, seq, t, s, l, m) of all files; only rows of a registered segment and run are valid."""
        return self._read("data", _ROWS)

    def rows(self) -> DataFrame:
        """The rows of all segments."""
        return self.data().join(self.segments().select("segment_id", "run"), ["segment_id", "run"])

    def _used(self) -> dict[int, int | None]:
        """Of the batches in the log, those that segments hold: None if wholly, else the last row used."""
        waiting = [int(n[6:]) for n in self._list("wal") if n.startswith("batch=")]
        if not waiting or not self._exists("segments"):
            return {}
        each = self._read("segments", _META).select(F.explode("used").alias("u")).select("u.b", "u.upto").filter(F.col("b").isin(waiting))
        found = each.groupBy("b").agg(F.bool_or(F.col("upto").isNull()).alias("whole"), F.max("upto").alias("upto")).collect()  # at most the batches in the log
        return {r.b: None if r.whole else r.upto for r in found}

    def buffered(self) -> DataFrame:
        """(b, i, t, s, l, m): appended rows that no segment holds; unreadable lines are skipped, rows with null fields are not."""
        used = self._used()
        paths = [f"{self.path}/wal/{n}" for n in sorted(self._list("wal")) if n.startswith("batch=") and used.get(int(n[6:]), 0) is not None]
        if not paths:
            return self.spark.createDataFrame([], _WAL)
        log = self.spark.read.schema(_WAL).option("mode", "DROPMALFORMED").json(paths).filter("b is not null and i is not null")
        for b, upto in used.items():
            if upto is not None:
                log = log.filter((F.col("b") != b) | (F.col("i") > upto))
        return log

    # -- writing

    def _claim_batch(self) -> int:
        """A number above that of every batch in the log, claimed by creating its mark: two writers never have the same."""
        last = max((int(n[6:]) for n in [*self._list("wal"), *self._list("marks")] if n.startswith("batch=")), default=0)
        batch = max(last + 1, time.time_ns())
        while not self._create(f"marks/batch={batch}"):
            batch += 1
        return batch

    def _create(self, name: str) -> bool:
        """Create an empty file; false if it is there already."""
        p, fs = self._hadoop(name)
        fs.mkdirs(p.getParent())
        return fs.createNewFile(p)

    def _log(self, rows: DataFrame, batch: int) -> tuple[int, int]:
        """Put a batch into the log at once, and return its rows and bytes."""
        logged = cut(rows.select(F.lit(batch).alias("b"), F.monotonically_increasing_id().alias("i"), "t", "s", "l", "m"))
        logged.write.mode("overwrite").json(f"{self.path}/staged/batch={batch}")
        (src, fs), (dst, _) = self._hadoop(f"staged/batch={batch}"), self._hadoop(f"wal/batch={batch}")
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise OSError(f"cannot move {src} to {dst}")
        return self._size(logged)

    def append(self, rows: DataFrame) -> None:
        """Add rows (t, s, l, m) in their order, and cut segments as far as the thresholds are reached.

        Rows with null fields are kept.  Several writers may append to one store; one at a time may flush.
        """
        with self._lock:
            self._grown(self._log(rows, self._claim_batch()))

    def append_batch(self, rows: DataFrame, batch: str) -> None:
        """Like append(), for a named batch: one that is in the log or in a segment already is skipped, so replays are harmless."""
        name = re.sub(r"[^\w.\-]", "_", batch) + f"-{crc32(batch.encode()):08x}"
        with self._lock:
            # the number a replayed batch had before, if it died on the way
            claimed = [int(x) for x in self._list(f"streams/{name}") if x.isdigit()]
            number = claimed[0] if claimed else self._claim_batch()
            if claimed and (self._exists(f"wal/batch={number}") or self._registered(number)):
                return
            self._create(f"streams/{name}/{number}")
            self._grown(self._log(rows, number))

    def _registered(self, number: int) -> bool:
        return not self._read("segments", _META).filter(F.exists("used", lambda u: u["b"] == number)).isEmpty()

    def _grown(self, size: tuple[int, int]) -> None:
        """Flush if the log has reached a threshold; what waited before this writer came is counted once."""
        self._waiting = self._size(self.buffered()) if self._waiting is None else (self._waiting[0] + size[0], self._waiting[1] + size[1])
        if self._waiting[0] >= self.config.max_buffer_lines or self._waiting[1] >= self.config.max_buffer_bytes:
            self._flush(whole=self._waiting[0] < self.config.max_buffer_lines)

    @staticmethod
    def _size(rows: DataFrame) -> tuple[int, int]:
        n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(segments.row_bytes()), F.lit(0))).first()
        return n, size

    def flush(self) -> None:
        """Put all waiting rows into segments; without any, nothing happens."""
        with self._lock:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        waiting = self.buffered()
        rows = numbered(cut(waiting), ["b", "i"])
        per = {r.b: (r.last, r.at) for r in rows.groupBy("b").agg(F.max("idx").alias("last"), F.max("i").alias("at")).collect()}  # one row per batch
        n = max((last for last, _ in per.values()), default=-1) + 1
        take = n if whole else n - n % self.config.max_buffer_lines
        if take:
            used = [(b, None) for b, (last, _) in per.items() if last < take]
            cutting = [b for b, (last, _) in per.items() if last >= take]
            if cutting and (at := rows.filter((F.col("idx") == take - 1) & (F.col("b") == min(cutting))).select("i").first()):
                used.append((min(cutting), at.i))
            self._write(rows.filter(F.col("idx") < take), "flush-" + uuid.uuid4().hex, used)
        self._waiting = None
        self._clean()

    def _clean(self) -> None:
        """Delete the batches of the log that segments hold wholly."""
        for b, upto in self._used().items():
            if upto is None:
                self._delete(f"wal/batch={b}")
                self._delete(f"marks/batch={b}")

    def next_segment_id(self) -> int:
        return (self._read("segments", _META).agg(F.max("segment_id")).first()[0] or 0) + 1

    def _write(self, rows: DataFrame, batch: str, used: list[tuple[int, int | None]], replaces: list[int] | None = None) -> None:
        """Write rows (idx, t, s, l, m) as new segments under a run of their own, and register them."""
        run, first, size = uuid.uuid4().hex, self.next_segment_id(), self.config.max_buffer_lines
        placed = rows.select(
            (F.floor(F.col("idx") / size) + first).alias("segment_id"), (F.col("idx") % size).alias("seq"),
            F.floor(F.col("idx") % size / self.config.chunk_size).cast("int").alias("chunk_id"), "t", "s", "l", "m",
        )
        placed.repartition("segment_id").sortWithinPartitions("segment_id", "seq").write.partitionBy("segment_id").option("compression", self.config.codec).parquet(f"{self.path}/data/run={run}")
        self._register(self.data().filter(F.col("run") == run), batch, used, replaces)

    def _register(self, rows: DataFrame, batch: str, used: list[tuple[int, int | None]], replaces: list[int] | None = None) -> None:
        rows = rows.select("segment_id", "run", "chunk_id", "t", "s", "l", "m")
        chunk = ["segment_id", "run", "chunk_id"]
        per_chunk = cut(segments.summaries(rows, tuple(chunk)).join(segments.trigram_index(rows, tuple(chunk)), chunk, "left"))
        per_chunk.drop("raw_bytes").coalesce(1).write.mode("append").parquet(f"{self.path}/chunks")
        meta = segments.merged(per_chunk, ("segment_id", "run"))
        # what was used stands with the first segment; one file, so that all of a run's segments appear at once
        alone = F.col("segment_id") == meta.agg(F.min("segment_id")).first()[0]
        listed = F.array(*(F.struct(F.lit(b).cast("long").alias("b"), F.lit(u).cast("long").alias("upto")) for b, u in used)).cast("array<struct<b: long, upto: long>>")
        gone = F.array(*(F.lit(x).cast("long") for x in replaces or [])).cast("array<long>")
        out = meta.withColumns({"batch": F.lit(batch), "used": F.when(alone, listed), "replaces": F.when(alone, gone), "created_at": F.current_timestamp()})
        out.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def rebuild(self) -> None:
        """Make the metadata anew from the data; of a segment that several runs wrote, the fullest counts.

        What the metadata, if there are any left, say about used batches is kept.
        """
        with self._lock:
            known = self._used()
            self._delete("segments")
            self._delete("chunks")
            self._delete("compacted")
            if self._exists("data"):
                counts = self.data().groupBy("segment_id", "run").agg(F.count(F.lit(1)).alias("n"))
                best = counts.groupBy("segment_id").agg(F.max_by("run", F.struct("n", "run")).alias("run"))
                self._register(self.data().join(best, ["segment_id", "run"]), "rebuild-" + uuid.uuid4().hex, list(known.items()))

    def compact(self, lines: int | None = None) -> None:
        """Join segments of fewer than `lines` rows (max_buffer_lines by default) into full ones, in their order.

        The new segments and what they replace are registered together.  Files of replaced segments stay until the next
        call, for readers that began before.
        """
        with self._lock:
            meta = self.segments()
            live = {r.run for r in meta.select("run").distinct().collect()}
            for name in self._list("data"):
                if name.startswith("run=") and name[4:] not in live:
                    self._delete(f"data/{name}")
            small = meta.filter(F.col("line_count") < (lines or self.config.max_buffer_lines)).select("segment_id", "run")
            ids = [r.segment_id for r in small.collect()]
            if len(ids) < 2:
                return
            rows = self.data().join(small, ["segment_id", "run"]).select(F.col("segment_id").alias("b"), F.col("seq").alias("i"), "t", "s", "l", "m")
            self._create("compacted")
            self._write(numbered(cut(rows), ["b", "i"]), "compact-" + uuid.uuid4().hex, [], ids)

    def index_templates(self) -> None:
        """Mine the templates of all segments into templates/; segments written later are unknown to it until the next call."""
        with self._lock:
            found, _ = mine(self.rows().select("segment_id", "seq", "m"))
            found.select("segment_id", "pat_id", "parts", "row_count").write.mode("overwrite").option("compression", self.config.codec).parquet(f"{self.path}/templates")

    def templates(self) -> DataFrame:
        """(segment_id, pat_id, parts, row_count) of the segments whose templates are indexed."""
        return self._read("templates", f"segment_id long, pat_id int, parts {PARTS}, row_count long")

    # -- reading

    def query_range(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return manifest.query_range(self.segments(), start, end)

    def query_by_id(self, segment_id: int) -> DataFrame:
        return manifest.query_by_id(self.segments(), segment_id)

    def may_exist(self, start: int | None = None, end: int | None = None, keyword: str = "") -> bool:
        """False only if no row in the range has the keyword; rows that wait for a segment are looked at."""
        if manifest.may_exist(self.segments(), start, end, keyword).first()[0]:
            return True
        return not self.buffered().filter(in_range(start, end) & has_keyword(keyword)).isEmpty()

    def count_at_least(self, start: int | None = None, end: int | None = None, keyword: str = "", templates: DataFrame | None = None) -> int:
        """A lower bound from metadata; of segments whose templates are not indexed only levels are known."""
        templates = self.templates() if templates is None else templates
        return manifest.count_at_least(self.segments(), templates, start, end, keyword).first()[0]

    def query(self, start: int | None = None, end: int | None = None, keyword: str = "", limit: int | None = 100, order: str = "scan") -> DataFrame:
        """(t, s, l, m), newest first: rows in a time range that hold a keyword.

        Segments and their chunks are pruned by their times and trigrams before any data is opened.  In scan order the
        first `limit` rows are those of the segments with the newest times, then those still waiting.
        """
        if order not in ("scan", "latest"):
            raise InvalidInput("order must be 'scan' or 'latest'")
        if start is not None and end is not None and start > end:
            return self.spark.createDataFrame([], LOG_LINE)
        may = overlaps(start, end) & segments.keyword_possible(keyword)
        possible = self.segments().filter(may).select("segment_id", "run", F.col("max_ts").alias("mx"))
        known = possible.limit(self.config.listed_segments + 1).collect()
        data = self.data()
        if len(known) <= self.config.listed_segments:
            # as literals they prune folders
            data = data.filter(F.col("segment_id").isin([r.segment_id for r in known]) & F.col("run").isin(sorted({r.run for r in known}))) if known else data.limit(0)
        if keyword or start is not None or end is not None:
            chunks = self.chunks().filter(may).join(possible, ["segment_id", "run"])
            stored = data.join(chunks.select("segment_id", "run", "chunk_id", "mx"), ["segment_id", "run", "chunk_id"])
        else:
            stored = data.join(possible, ["segment_id", "run"])
        stored = stored.filter(in_range(start, end) & has_keyword(keyword))
        waiting = self.buffered().filter(in_range(start, end) & has_keyword(keyword))
        rows = stored.select(F.lit(0).alias("w"), "mx", "segment_id", "seq", "t", "s", "l", "m").unionByName(
            waiting.select(F.lit(1).alias("w"), F.lit(0).cast("long").alias("mx"), F.col("b").alias("segment_id"), F.col("i").alias("seq"), "t", "s", "l", "m")
        )
        place = ["w", F.desc("mx"), "segment_id", "seq"]
        if limit is not None:
            rows = rows.orderBy(*([F.desc("t")] if order == "latest" else []), *place).limit(limit)
        return rows.orderBy(F.desc("t"), *place).select("t", "s", "l", "m")

    def stats(self) -> dict[str, int | float | None]:
        """Segments, rows, time range, buffered rows and bytes, raw and stored bytes, and their ratio."""
        s = self.segments().agg(F.count(F.lit(1)), F.sum("line_count"), F.min("min_ts"), F.max("max_ts"), F.sum("raw_bytes")).first()
        n, size = self._size(self.buffered())
        stored = sum(r.bytes for r in self.files())
        return {
            "segment_count": s[0], "line_count": s[1] or 0, "min_ts": s[2], "max_ts": s[3], "buffered_lines": n, "buffered_bytes": size,
            "raw_bytes": s[4] or 0, "stored_bytes": stored, "compression_ratio": (s[4] or 0) / stored if stored else 0.0,
        }

    def files(self) -> list:
        """(segment_id, bytes) of every segment, from the file system; as many rows as segments."""
        out = []
        for r in self.segments().select("segment_id", "run").orderBy("segment_id").collect():
            p, fs = self._hadoop(f"data/run={r.run}/segment_id={r.segment_id}")
            out.append(_Size(r.segment_id, fs.getContentSummary(p).getLength() if fs.exists(p) else 0))
        return out

    def check(self) -> None:
        """Read every segment; raise CorruptSegment if a file cannot be read or rows are missing."""
        try:
            found = self.data().groupBy("segment_id", "run").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("t", "s", "l", "m")))
            bad = self.segments().select("segment_id", "run", "line_count").join(found, ["segment_id", "run"], "left").filter(F.coalesce("n", F.lit(0)) != F.col("line_count")).limit(5).collect()
        except Exception as e:
            raise CorruptSegment(str(e)[:300]) from e
        if bad:
            raise CorruptSegment(f"rows are missing from segments {[r.segment_id for r in bad]}")


@dataclass(frozen=True)
class _Size:
    segment_id: int
    bytes: int


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `idx`, the place of each row from 0.

    Rows are sorted by ranges and numbered within their range; what stands before a range is one number per partition.
    """
    spread = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("mid", 33).alias("part")
    counts = spread.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return spread.withColumn("part", part).join(F.broadcast(before), "part").withColumn("idx", F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "mid")
