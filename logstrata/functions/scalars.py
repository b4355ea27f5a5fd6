"""Scalar functions of the log format: hashes, sizes, names, codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

# FNV-1a and the finaliser of the Bloom hash, the block size of a segment file.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FINALISER = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
BLOOM_BITS = 512
BLOCK = 4096
LEVEL_BITS = {"D": 0, "I": 1, "W": 2, "E": 3}


def format_ts(t: Column) -> Column:
    """secs.ms; the milliseconds are not padded."""
    return F.concat(F.floor(t / 1000).cast("string"), F.lit("."), F.pmod(t, F.lit(1000)).cast("string"))


def format_line(t: Column, s: Column, l: Column, m: Column) -> Column:  # noqa: E741
    """[secs.ms] [service] level: message."""
    return F.concat(F.lit("["), format_ts(t), F.lit("] ["), s, F.lit("] "), l, F.lit(": "), m)


def crc32(c: Column) -> Column:
    return F.crc32(c)


def _fnv(texts: pd.Series) -> np.ndarray:
    """FNV-1a of many strings at once, one byte position after the other."""
    raw = [t.encode() if t is not None else b"" for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(raw) else np.zeros(0, np.int64)
    sorted_lengths = lengths[order]
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    n, position = len(raw), 0
    while n:
        n = int(np.searchsorted(-sorted_lengths, -position, side="left"))
        if n:
            h[:n] = (h[:n] ^ flat[starts[:n] + position]) * np.uint64(FNV_PRIME)
        position += 1
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return out


@F.pandas_udf(LongType())
def hash_path(texts: pd.Series) -> pd.Series:
    """FNV-1a with 64 bits, as a signed number; null stays null."""
    return pd.Series(_fnv(texts).view(np.int64), dtype="Int64").mask(texts.isna().to_numpy())


@F.pandas_udf(IntegerType())
def bloom_hash(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """Bit of a string in a 512-bit filter, for a seed."""
    h = _fnv(texts) + seeds.fillna(0).to_numpy().astype(np.uint64)
    for factor in FINALISER:
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return pd.Series((h % np.uint64(BLOOM_BITS)).astype(np.int32), dtype="Int32").mask(texts.isna().to_numpy())


def zigzag(v: Column) -> Column:
    """Signed to unsigned, kept in the bits of a signed number."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varuint_size(v: Column) -> Column:
    """Bytes of a non-negative number in base 128; a negative one counts as an unsigned number above 2**63."""
    size = F.lit(9)
    for n in range(8, 0, -1):
        size = F.when(v < F.lit(1 << (7 * n)), n).otherwise(size)
    return F.when(v < 0, 10).otherwise(size)


def varint_size(v: Column) -> Column:
    return varuint_size(zigzag(v))


def align_up(v: Column, block: int = BLOCK) -> Column:
    return F.floor((v + (block - 1)) / block) * block


def padding_needed(v: Column, block: int = BLOCK) -> Column:
    return align_up(v, block) - v


def segment_name(segment_id: Column, suffix: str = "seg") -> Column:
    return F.format_string(f"segment-%08d.{suffix}", segment_id)


def parse_segment_name(name: Column) -> Column:
    """The id in a segment's file name, null for any other name."""
    return F.nullif(F.regexp_extract(name, r"^segment-([0-9]{8})", 1), F.lit("")).try_cast("int")


def level_bit(l: Column) -> Column:  # noqa: E741
    """The bit of a level in a mask; unknown levels count as I, as they do on disk."""
    out = F.lit(1 << LEVEL_BITS["I"])
    for code, bit in LEVEL_BITS.items():
        out = F.when(l == code, 1 << bit).otherwise(out)
    return out


def write_varuint(value: int) -> bytes:
    """A non-negative number in base 128, low digits first, the high bit marking that more follow."""
    out = bytearray()
    while True:
        value, low = value >> 7, value & 0x7F
        out.append(low | 0x80 if value else low)
        if not value:
            return bytes(out)


def read_varuint(data: bytes, offset: int = 0) -> tuple[int, int] | None:
    """(value, next offset); None if the data end first or the number has more than 64 bits."""
    value = 0
    for k in range(10):
        if offset + k >= len(data):
            return None
        byte = data[offset + k]
        value |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            return (value, offset + k + 1) if value < 1 << 64 else None
    return None


def xor_param_bytes(current: bytes, base: bytes) -> bytes:
    """The difference of two byte strings: block count and length (16 bits each), a bitmap of the 8-byte blocks that
    differ, and those blocks."""
    blocks = -(-max(len(current), len(base)) // 8)
    if blocks > 0xFFFF or len(current) > 0xFFFF:
        raise ValueError("too long for 16-bit lengths")
    a, b = (np.frombuffer(x.ljust(blocks * 8, b"\0"), "<u8") for x in (current, base))
    x = a ^ b
    bitmap = np.packbits(x != 0, bitorder="little").tobytes()
    return blocks.to_bytes(2, "little") + len(current).to_bytes(2, "little") + bitmap + x[x != 0].tobytes()


def decode_xor_param_bytes(data: bytes, base: bytes) -> bytes:
    """The byte string whose difference from base was taken; data too short for a header give base back."""
    if len(data) < 4:
        return base
    blocks, length = int.from_bytes(data[:2], "little"), int.from_bytes(data[2:4], "little")
    n = -(-blocks // 8)
    changed = np.unpackbits(np.frombuffer(data[4 : 4 + n], np.uint8), bitorder="little")[:blocks].astype(bool)
    out = np.frombuffer(base[: blocks * 8].ljust(blocks * 8, b"\0"), "<u8").copy()
    out[changed] ^= np.frombuffer(data, "<u8", int(changed.sum()), 4 + n)
    return out.tobytes()[:length]
