"""Dumps of cumulative flow counters: a JSON array of byte-encoded keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import protocol_name

_DUMP = "array<struct<key:string,value:string>>"


def byte_hex(raw: Column) -> Column:
    """Hex text of an encoded byte field.

    Accepted encodings: list of hex strings (with or without 0x), list of integers, one blank-separated hex string.
    Anything outside 0..255 or not hexadecimal makes the text invalid rather than silently shorter.
    """
    from_strings = F.array_join(
        F.transform(
            F.from_json(raw, "array<string>"),
            lambda s: _two_digits(F.regexp_replace(F.lower(F.trim(s)), "^0x", "")),
        ),
        "",
        "??",
    )
    from_numbers = F.array_join(
        F.transform(F.from_json(raw, "array<bigint>"), lambda n: _two_digits(F.lower(F.hex(n)))), "", "??"
    )
    return (
        F.when(raw.rlike(r'^\s*\[\s*"'), from_strings)
        .when(raw.rlike(r"^\s*\["), from_numbers)
        .otherwise(F.lower(F.regexp_replace(raw, r'[\s"]', "")))
    )


def _two_digits(text: Column) -> Column:
    return F.when(F.length(text).between(1, 2), F.lpad(text, 2, "0")).otherwise(F.lit("??"))


def _little_endian(hex_text: Column, at: int, n_bytes: int, signed: bool = False) -> Column:
    swapped = F.concat(*[F.substring(hex_text, 2 * (at + i) + 1, 2) for i in reversed(range(n_bytes))])
    return F.conv(swapped, 16, -10 if signed else 10).cast("bigint")


def _dotted(hex_text: Column, at: int) -> Column:
    octets = [F.conv(F.substring(hex_text, 2 * (at + i) + 1, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *octets)


def decode_counter_dumps(dumps: DataFrame, text_col: str = "dump") -> DataFrame:
    """One row per map entry with the 5-tuple and its totals.

    Entries whose key is not 16 bytes are dropped; a value that is not 16 bytes counts as (0, 0).
    """
    others = [c for c in dumps.columns if c != text_col]
    entries = dumps.select(*others, F.explode(F.from_json(F.col(text_col), _DUMP)).alias("_e"))
    valid = r"^[0-9a-f]{32}$"
    key, value = F.col("_k"), F.col("_v")
    rows = entries.select(
        *others, byte_hex(F.col("_e.key")).alias("_k"), byte_hex(F.col("_e.value")).alias("_v")
    ).where(key.rlike(valid))
    value_ok = F.coalesce(value.rlike(valid), F.lit(False))
    return rows.select(
        *others,
        _dotted(key, 0).alias("src_ip"),
        _dotted(key, 4).alias("dst_ip"),
        _little_endian(key, 8, 2).cast("int").alias("src_port"),
        _little_endian(key, 10, 2).cast("int").alias("dst_port"),
        protocol_name(_little_endian(key, 12, 1)).alias("proto"),
        F.when(value_ok, _little_endian(value, 0, 8, True)).otherwise(F.lit(0)).cast("bigint").alias("total_bytes"),
        F.when(value_ok, _little_endian(value, 8, 8, True)).otherwise(F.lit(0)).cast("bigint").alias("total_packets"),
    )
