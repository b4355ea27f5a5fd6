"""Physical lines to log lines: compact JSON, standard JSON, web access lines, and a fallback by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPACT = "t BIGINT, s STRING, l STRING, m STRING"


def infer_level(line: Column) -> Column:
    """E, W, D or I by the keywords in a line; `debug` in lower case does not count."""
    return F.when(line.rlike("ERROR|Error|error"), "E").when(line.rlike("WARN|Warn|warn"), "W").when(line.rlike("DEBUG|Debug"), "D").otherwise("I")


def trim_line(line: Column) -> Column:
    """A line without white space, in the sense of Unicode, at its ends."""
    return F.regexp_replace(line, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def parse_lines(df: DataFrame, line: Column, default_t: Column, default_service: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., rule, t, s, l, m) of every line that is not blank; null lines are blank.

    The first rule that fits is named in `rule`: compact (a JSON object with all of t, s, l, m), standard (any JSON object
    in which those of the long and short names that it has are of the right type; short ones win), nginx (the line
    holds HTTP/), fallback.  Times must be whole numbers from 0, the other fields texts; null counts as absent.
    """
    x = df.select(*keep, trim_line(line).alias("line"), default_t.alias("dt"), default_service.alias("ds")).filter("line <> ''")
    # as the only element of an array, so that nothing may follow the object
    json = F.when(F.col("line").startswith("{") & F.col("line").endswith("}"), F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]"))))
    x = x.withColumn("v", F.when(F.schema_of_variant(json).startswith("ARRAY<OBJECT") & F.try_variant_get(json, "$[1]", "variant").isNull(), F.try_variant_get(json, "$[0]", "variant")))
    kind = lambda c: F.coalesce(F.schema_of_variant(F.variant_get("v", f"$.{c}", "variant")), F.lit("VOID"))
    get = lambda c, t="string": F.try_variant_get("v", f"$.{c}", t)
    text = lambda c: kind(c) == "STRING"
    time = lambda c: (kind(c) == "BIGINT") & (get(c, "bigint") >= 0)
    absent = lambda c: kind(c) == "VOID"
    compact, standard = time("t"), F.col("v").isNotNull()
    for c in ("s", "l", "m"):
        compact = compact & text(c)
    for c in ("timestamp", "ts"):
        standard = standard & (absent(c) | time(c))
    for c in ("service", "level", "message", "s", "l", "m"):
        standard = standard & (absent(c) | text(c))
    web = F.col("line").contains("HTTP/")
    x = x.withColumn("rule", F.when(compact, "compact").when(standard, "standard").when(web, "nginx").otherwise("fallback"))
    r = F.col("rule")
    return x.select(
        *keep,
        "rule",
        F.when(r == "compact", get("t", "bigint")).when(r == "standard", F.coalesce(get("ts", "bigint"), get("timestamp", "bigint"), "dt")).otherwise(F.col("dt")).alias("t"),
        F.when(r == "compact", get("s")).when(r == "standard", F.coalesce(get("s"), get("service"), "ds")).when(r == "nginx", F.lit("nginx")).otherwise(F.col("ds")).alias("s"),
        F.when(r == "compact", get("l")).when(r == "standard", F.coalesce(get("l"), get("level"), F.lit("I"))).when(r == "nginx", F.lit("I")).otherwise(infer_level(F.col("line"))).alias("l"),
        F.when(r == "compact", get("m")).when(r == "standard", F.coalesce(get("m"), get("message"), "line")).otherwise(F.col("line")).alias("m"),
    )
