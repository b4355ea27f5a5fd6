"""Tokens of a message, their types, and typed parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, octets and ports, and the one-letter codes of the types.
SPACE = r"\p{IsWhite_Space}"
RUN = r"\p{IsAlphabetic}\p{N}_.:/-"
TOKEN = rf"{SPACE}|[{RUN}]+|[^{SPACE}{RUN}]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PORT = "(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3}|0)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
TYPE_NAMES = {"P": "ipv4_port", "I": "ipv4", "T": "timestamp", "B": "block_id", "H": "hex", "N": "integer", "h": "path"}
#: Codes of the types as stored in a TypedParam.
TYPE_CODES = {"string": 0, "integer": 1, "hex": 2, "ipv4": 3, "block_id": 4, "ipv4_port": 5, "timestamp": 6, "path": 7}


def tokenize(message: Column) -> Column:
    """array<string>; each white-space character and each other mark is a token, joined they are the message again."""
    return F.regexp_extract_all(message, F.lit(TOKEN), F.lit(0))


def is_integer(t: Column) -> Column:
    """A signed 64-bit integer that prints as it is written: no plus, no leading zero."""
    return t.rlike(r"^(0|-?[1-9][0-9]{0,18})\z") & t.try_cast("bigint").isNotNull()


def is_block_id(t: Column) -> Column:
    return t.rlike(r"^blk_(0|-?[1-9][0-9]{0,18})\z") & F.substr(t, F.lit(5)).try_cast("bigint").isNotNull()


def is_hex(t: Column) -> Column:
    """0x and up to 64 bits without leading zeros."""
    return t.rlike(r"^0x(0|[1-9a-fA-F][0-9a-fA-F]{0,15})\z")


def is_ipv4(t: Column) -> Column:
    return t.rlike(rf"^{IPV4}\z")


def is_ipv4_port(t: Column) -> Column:
    return t.rlike(rf"^{IPV4}:{PORT}\z")


def is_compact_time(t: Column) -> Column:
    """Six ASCII digits; the calendar is not checked."""
    return t.rlike(r"^[0-9]{6}\z")


def is_path(t: Column) -> Column:
    return t.startswith("/") & (F.octet_length(t) > 1)


def type_char(t: Column) -> Column:
    """The type of one token: s P I T B H N h C W, the first that fits."""
    # most tokens of a message are blanks or words, so the tests that need a digit come after one that finds it
    digits = (
        F.when(is_ipv4_port(t), "P").when(is_ipv4(t), "I").when(is_compact_time(t), "T").when(is_block_id(t), "B").when(is_hex(t), "H").when(is_integer(t), "N")
    )
    plain = F.when(is_path(t), "h").when(t.rlike(r"^[!-/:-@\[-`{-~]+\z"), "C").otherwise("W")
    return F.when(t.rlike(rf"^{SPACE}+\z"), "s").when(t.rlike("[0-9]"), F.coalesce(digits, plain)).otherwise(plain)


def type_sequence(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, type_char), "")


def param_type(t: Column) -> Column:
    """Name of a parameter's type."""
    code = type_char(t)
    out = F.lit("string")
    for c, name in TYPE_NAMES.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def typed_param(t: Column) -> Column:
    """struct(ptype, value); value keeps the text as written, so it is lossless for any spelling."""
    return F.struct(param_type(t).alias("ptype"), t.alias("value"))
