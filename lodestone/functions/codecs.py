"""Integer codes of inverted lists as functions. Parquet does this work for stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vbyte_size(value: Column) -> Column:
    """Bytes that an unsigned number takes at seven bits a byte."""
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


def vbyte_encode(values: list[int]) -> bytes:
    """Groups of seven bits, the most significant first; the last byte of each number has its high bit set."""
    out = bytearray()
    for v in values:
        if not 0 <= v < 1 << 35:
            raise ValueError(f"out of range: {v}")
        groups = [v & 127 | 128]
        while v := v >> 7:
            groups.append(v & 127)
        out += bytes(reversed(groups))
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    out, v = [], 0
    for b in data:
        v = v << 7 | b & 127
        if b & 128:
            out.append(v)
            v = 0
    return out


def gaps(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def ungap(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def bit_pack(values: list[int], block: int = 128) -> bytes:
    """Blocks of ``block`` numbers, each at the width of its largest, after a byte that holds it; a 0 byte, then the rest as vbytes."""
    out = bytearray()
    whole = len(values) - len(values) % block
    for lo in range(0, whole, block):
        part = values[lo : lo + block]
        width = max(1, max(part).bit_length())
        packed = 0
        for i, v in enumerate(part):
            packed |= v << i * width
        out += bytes([width]) + packed.to_bytes(block * width // 8, "little")
    return bytes(out) + b"\0" + vbyte_encode(values[whole:])


def bit_unpack(data: bytes, block: int = 128) -> list[int]:
    out, at = [], 0
    while width := data[at]:
        n = block * width // 8
        packed = int.from_bytes(data[at + 1 : at + 1 + n], "little")
        out += [packed >> i * width & (1 << width) - 1 for i in range(block)]
        at += 1 + n
    return out + vbyte_decode(data[at + 1 :])


def segment_gaps(segments: DataFrame) -> DataFrame:
    """term, impact, doc_id, gap: differences of ascending ids, which start anew in each segment."""
    rows = segments.select("term", "impact", F.explode("docs").alias("doc_id"))
    w = Window.partitionBy("term", "impact").orderBy("doc_id")
    return rows.withColumn("gap", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(w)).cast("int"))
