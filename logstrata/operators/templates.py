"""Message templates by positional alignment within token-type groups, and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions.tokens import tokenize, type_sequence, typed_param
from logstrata.session import cut, partitions


def tokenize_at_most(message: str, max_tokens: int | None = None) -> Column:
    """Tokens of a message; the whole message as one token if they are more than allowed."""
    tokens = tokenize(F.col(message))
    return tokens if max_tokens is None else F.when(F.size(tokens) > max_tokens, F.array(message)).otherwise(tokens)


def _aligned(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., signature, first_seq, fixed): per group, the tokens that all rows share at a position, null elsewhere.

    Every row is compared with the first row of its group; what differs is a bit of a 64-bit word, and the words are
    combined by OR.  So a row costs one number per 64 tokens, combined in a hash table before anything is shuffled,
    however long the group.
    """
    model = rows.groupBy(*key).agg(F.min("seq").alias("first_seq"), F.min_by("tokens", "seq").alias("model"))
    differs = F.zip_with("tokens", "model", lambda t, x: t != x)
    word = lambda w: F.aggregate(
        F.slice(differs, w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("i")),
        lambda acc, d: F.struct(acc["bits"].bitwiseOR(F.when(d, F.call_function("shiftleft", F.lit(1).cast("long"), acc["i"])).otherwise(F.lit(0).cast("long"))).alias("bits"), (acc["i"] + 1).alias("i")),
    )["bits"]
    words = rows.join(model, key).select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("model") - 1) / 64).cast("int")), word)).alias("w", "bits"))
    masks = words.groupBy(*key, "w").agg(F.bit_or("bits").alias("bits")).groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("masks")
    )
    differ = lambda i: F.getbit(F.get("masks", F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64))) == 1
    signature = F.transform("model", lambda t, i: F.when(~differ(i), t))
    return model.join(masks, key).select(*key, signature.alias("signature"), "first_seq").withColumn("fixed", F.size(F.filter("signature", lambda t: t.isNotNull())))


def mine(logs: DataFrame, max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Templates and records of (segment_id, seq, m).

    templates  segment_id, pat_id, parts, signature (array<string>, null for a parameter), row_count
    records    segment_id, seq, pat_id, params
    Rows of a segment with the same sequence of token types are aligned; positions at which all agree stay.  A group that
    shares less than a quarter of its positions, and less than two at least, is split by its first four tokens.  Equal
    templates of different groups are one; ids follow the first row.  Empty messages have an empty template.  With
    max_tokens, longer messages are literal templates of one token.  Null messages have no template.

    Messages are cut into tokens once and shuffled once, by segment; every later step keeps that partitioning.  A
    segment is a bounded set of rows, as it is where segments are written.
    """
    rows = logs.filter("m is not null").select("segment_id", "seq", tokenize_at_most("m", max_tokens).alias("tokens"))
    rows = rows.repartition(partitions(logs), "segment_id")
    # the sequence of types is as long as the message; a hash of it keys the groups, and is found only once
    shape = F.xxhash64(type_sequence(F.col("tokens")), F.size("tokens"))
    typed = cut(rows.select("segment_id", "seq", "tokens", F.size("tokens").alias("n"), shape.alias("shape")))
    # positions exist only where there are tokens; empty messages form a group of their own
    filled, empty = typed.filter("n > 0"), typed.filter("n = 0")
    key = ["segment_id", "shape", "sub"]
    first = cut(_aligned(filled, key[:2])).withColumn("split", F.col("fixed") < F.greatest(F.floor(F.size("signature") / 4), F.lit(2)))
    whole = F.lit(0).cast("long").alias("sub")
    groups = first.filter("not split").select(*key[:2], whole, "signature", "first_seq").unionByName(
        empty.groupBy(*key[:2]).agg(F.min("seq").alias("first_seq")).select(*key[:2], whole, F.array().cast("array<string>").alias("signature"), "first_seq")
    )
    all_rows = typed.withColumn("sub", whole)
    if not first.filter("split").isEmpty():
        shapes = first.select(*key[:2], "split")
        start = F.xxhash64(F.array_join(F.slice("tokens", 1, 4), "\0"))
        all_rows = typed.join(shapes, key[:2], "left").withColumn("sub", F.when(F.col("split"), start).otherwise(F.lit(0).cast("long")))
        groups = groups.unionByName(_aligned(all_rows.filter("split").drop("split"), key).select(groups.columns))
    groups = cut(groups)
    lowest = groups.groupBy("segment_id", "signature").agg(F.min("first_seq").alias("first_seq"))
    ids = lowest.withColumn("pat_id", (F.row_number().over(Window.partitionBy("segment_id").orderBy("first_seq")) - 1).cast("int"))
    keyed = cut(groups.select(*key, "signature").join(ids.select("segment_id", "signature", "pat_id"), ["segment_id", "signature"]))
    found = all_rows.select("segment_id", "seq", "tokens", "shape", "sub").join(keyed, key)
    varying = F.filter(F.arrays_zip(F.col("tokens").alias("tok"), F.col("signature").alias("lit")), lambda x: x["lit"].isNull())
    records = found.select("segment_id", "seq", "pat_id", F.transform(varying, lambda x: typed_param(x["tok"])).alias("params"))
    sizes = all_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    counts = sizes.join(keyed.select(*key, "pat_id"), key).groupBy("segment_id", "pat_id").agg(F.sum("k").alias("row_count"))
    parts = F.transform("signature", lambda t: F.struct(t.isNull().alias("is_param"), F.coalesce(t, F.lit("")).alias("text")))
    templates = ids.join(counts, ["segment_id", "pat_id"]).select("segment_id", "pat_id", parts.alias("parts"), "signature", "row_count")
    return templates, records


def signature_text(signature: Column) -> Column:
    """A template as text, <*> for a parameter."""
    return F.array_join(F.transform(signature, lambda t: F.coalesce(t, F.lit("<*>"))), "")


def rebuild(records: DataFrame, templates: DataFrame) -> DataFrame:
    """(segment_id, seq, m): literals and parameters in order; without a template, the parameters joined by spaces."""
    joined = records.join(templates.select("segment_id", "pat_id", "parts"), ["segment_id", "pat_id"], "left")
    step = lambda acc, p: F.struct(
        F.concat(acc["text"], F.when(p["is_param"], F.coalesce(F.get(F.col("params"), acc["k"])["value"], F.lit(""))).otherwise(p["text"])).alias("text"),
        (acc["k"] + p["is_param"].cast("int")).alias("k"),
    )
    text = F.aggregate("parts", F.struct(F.lit("").alias("text"), F.lit(0).alias("k")), step)["text"]
    loose = F.array_join(F.transform("params", lambda p: p["value"]), " ")
    return joined.select("segment_id", "seq", F.when(F.col("parts").isNull(), loose).otherwise(text).alias("m"))


def quality(templates: DataFrame) -> DataFrame:
    """Per segment: templates, those of one row, the most rows of one, those without literals; mean and median parameters.

    Of an even number of templates the median is the upper of the two in the middle.
    """
    sized = templates.select("segment_id", "row_count", F.size(F.filter("parts", lambda p: p["is_param"])).alias("params"), F.size("parts").alias("n"))
    counts = F.sort_array(F.collect_list("params"))
    return sized.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_templates"), F.count_if(F.col("row_count") == 1).alias("n_single"), F.max("row_count").alias("most_rows"),
        F.count_if(F.col("params") == F.col("n")).alias("n_all_param"), F.avg("params").alias("mean_params"),
        F.get(counts, F.floor(F.size(counts) / 2).cast("int")).alias("median_params"),
    )


def keyword_map(templates: DataFrame, by: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(by..., keyword, pat_id): lower-case words of at least three bytes in the literals of each template."""
    words = F.explode(F.flatten(F.transform(F.filter("parts", lambda p: ~p["is_param"]), lambda p: F.split(F.lower(p["text"]), r"\s+"))))
    return templates.select(*by, words.alias("keyword"), "pat_id").filter(F.octet_length("keyword") >= 3).distinct()


def segments_of_keyword(keyword: str, words: DataFrame, records: DataFrame) -> DataFrame:
    """(segment_id, n_records): segments that hold records of a template one of whose literal words is the keyword.

    words is the keyword map of templates common to all segments.  Their ids reach the scan of the records by a
    semi-join; no message is read.
    """
    ids = words.filter(F.col("keyword") == keyword.lower()).select("pat_id").distinct()
    return records.join(ids, "pat_id", "left_semi").groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_records"))


def literal_contains(keyword: str) -> Column:
    """Whether one literal of a template contains the keyword, so that every row of the template does."""
    return F.exists("parts", lambda p: ~p["is_param"] & p["text"].contains(keyword))
