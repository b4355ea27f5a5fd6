"""Segments and chunks: how rows are cut, and what is known of each without reading it."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions.scalars import level_bit

#: Bits of a trigram map, which is stored as a bitmap.
TRIGRAM_BITS = 1 << 15
#: Every three characters, also those that overlap.
_PIECES = "(?s)(?=(...))"


def chunk_column(chunk_size: int, seq_in_segment: str = "seq_in_segment") -> Column:
    return F.floor(F.col(seq_in_segment) / chunk_size).cast("int")


def chunked(logs: DataFrame, chunk_size: int, single_lines: int, single_bytes: int, seq_in_segment: str = "seq_in_segment") -> DataFrame:
    """Add `chunk`: a segment of at most single_lines rows and single_bytes bytes of messages is one chunk, others are cut.

    The size of a segment is one number per input partition in the shuffle; the rows themselves stay where they are.
    """
    size = logs.groupBy("segment_id").agg(((F.count(F.lit(1)) <= single_lines) & (F.coalesce(F.sum(F.octet_length("m")), F.lit(0)) <= single_bytes)).alias("single"))
    return logs.join(size, "segment_id").withColumn("chunk", F.when(F.col("single"), 0).otherwise(chunk_column(chunk_size, seq_in_segment))).drop("single")


def pattern_ids(records: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(by..., pattern_ids): the templates whose records a segment or chunk holds, ascending."""
    return records.select(*by, "pat_id").filter("pat_id is not null").distinct().groupBy(*by).agg(F.sort_array(F.collect_list("pat_id")).alias("pattern_ids"))


def may_contain_pattern(pat_id: int) -> Column:
    """Whether a segment or chunk can hold records of a template; without a list it can."""
    return F.col("pattern_ids").isNull() | F.array_contains("pattern_ids", pat_id)


def trigram_bits(text: str) -> set[int]:
    """The bits of all three-character pieces of a text."""
    return {crc32(x.encode("utf-8", "surrogatepass")) % TRIGRAM_BITS for x in {text[i : i + 3] for i in range(len(text) - 2)}}


def row_bytes() -> Column:
    """Bytes of a row as a line of compact JSON."""
    return F.octet_length(F.to_json(F.struct("t", "s", "l", "m"))) + 1


def summaries(logs: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """One row per segment (or chunk): true min_ts and max_ts, line_count, level_mask, raw_bytes."""
    return logs.groupBy(*by).agg(
        F.min("t").alias("min_ts"), F.max("t").alias("max_ts"), F.count(F.lit(1)).alias("line_count"),
        F.bit_or(level_bit(F.col("l"))).cast("int").alias("level_mask"), F.sum(row_bytes()).alias("raw_bytes"),
    )


def trigram_index(logs: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(by..., trigrams): a bitmap of the trigrams of service, level and message, field by field, for rows that have any.

    A task gives each bit of a key once, so at most TRIGRAM_BITS rows of a key leave it; the bitmaps then combine by OR.
    """
    text = F.concat_ws("\0", "s", "l", "m")  # no keyword holds the mark between fields
    pieces = logs.select(*by, F.explode(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(1))).alias("piece"))
    bits = pieces.select(*by, (F.crc32(F.col("piece")) % TRIGRAM_BITS).alias("bit")).distinct()
    return bits.groupBy(*by).agg(F.bitmap_construct_agg("bit").alias("trigrams"))


def merged(chunks: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """Summaries and trigrams of segments from those of their chunks."""
    return chunks.groupBy(*by).agg(
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("line_count").alias("line_count"),
        F.bit_or("level_mask").alias("level_mask"), F.sum("raw_bytes").alias("raw_bytes"), F.bitmap_or_agg("trigrams").alias("trigrams"),
    )


def keyword_possible(keyword: str) -> Column:
    """Whether trigrams allow the keyword; null trigrams are unknown and keywords of less than three characters may always occur."""
    out = F.lit(True)
    for bit in sorted(trigram_bits(keyword)):
        byte = F.conv(F.hex(F.substring("trigrams", bit // 8 + 1, 1)), 16, 10).cast("int")
        out = out & (byte.bitwiseAND(1 << bit % 8) != 0)
    return F.lit(True) if len(keyword) < 3 else F.col("trigrams").isNull() | out


def dual_threshold(logs: DataFrame, max_lines: int, max_bytes: int, order: str = "seq") -> DataFrame:
    """Add `flush`: the buffer fill a row belongs to, when a buffer is emptied at max_lines rows or max_bytes bytes.

    The fold depends on every row before, so it runs over one ordered stream per `stream` column (one writer's buffer);
    a table without that column is one stream.
    """
    keyed = logs if "stream" in logs.columns else logs.withColumn("stream", F.lit(0))
    sized = keyed.withColumn("nbytes", row_bytes())
    schema = sized.drop("nbytes").schema.add("flush", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, lines, used, flush = None, 0, 0, 0
        for pdf in batches:
            out = []
            for key, n in zip(pdf["stream"], pdf["nbytes"]):
                if key != stream:
                    stream, lines, used, flush = key, 0, 0, 0
                out.append(flush)
                lines, used = lines + 1, used + n
                if lines >= max_lines or used >= max_bytes:
                    lines, used, flush = 0, 0, flush + 1
            yield pdf.drop(columns="nbytes").assign(flush=out)

    return sized.repartition("stream").sortWithinPartitions("stream", order).mapInPandas(fold, schema)


def deltas(logs: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """Add `delta`: t less that of the row before in its segment; the first row keeps its time."""
    w = Window.partitionBy(*by).orderBy("seq")
    return logs.withColumn("delta", F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0)))


def restore(with_delta: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """Add `restored`: the times again, from the deltas alone."""
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return with_delta.withColumn("restored", F.sum("delta").over(w))


def constant_delta(logs: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(by..., constant): whether all differences between neighbours are equal, for segments of more than one row."""
    w = Window.partitionBy(*by).orderBy("seq")
    return (
        logs.select(*by, (F.col("t") - F.lag("t").over(w)).alias("delta"))
        .groupBy(*by)
        .agg(((F.count(F.lit(1)) > 1) & (F.min("delta") == F.max("delta"))).alias("constant"))
        .withColumn("constant", F.coalesce("constant", F.lit(False)))
    )


def service_dictionary(logs: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(by..., s, svc_id): services of a segment, numbered by first appearance."""
    first = logs.groupBy(*by, "s").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy(*by).orderBy("first_seq")
    return first.select(*by, "s", (F.row_number().over(w) - 1).alias("svc_id"))


def reference_rows(records: DataFrame, every: int, shape: str, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """Add `ref_seq`: the row against which a row is encoded, renewed after `every` rows of a shape or when it changes."""
    w = Window.partitionBy(*by).orderBy("seq")
    changed = F.coalesce((F.lag(shape).over(w) != F.col(shape)).cast("int"), F.lit(1))
    runs = records.withColumn("_run", F.sum(changed).over(w))
    within = Window.partitionBy(*by, "_run").orderBy("seq")
    numbered = runs.withColumn("_block", F.floor((F.row_number().over(within) - 1) / every))
    return numbered.withColumn("ref_seq", F.min("seq").over(Window.partitionBy(*by, "_run", "_block"))).drop("_run", "_block")
