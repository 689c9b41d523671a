"""Hash positions of the two Count-Min and the two HyperLogLog families.

The hash of each family is part of its data format (sketches of equal family and shape can be added), so the digest,
the byte order and the bias constants are fixed values.  Everything is a built-in expression inside codegen.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class CmsSpec(NamedTuple):
    """Shape of a Count-Min sketch; sketches add up only when all three fields agree."""

    width: int = 2048
    depth: int = 5
    family: str = "A"

    @property
    def epsilon(self) -> float:
        return math.e / self.width

    @property
    def delta(self) -> float:
        return math.exp(-self.depth)


class HllSpec(NamedTuple):
    """Precision and hash family of a HyperLogLog sketch."""

    precision: int = 14
    family: str = "A"

    @property
    def registers(self) -> int:
        return 1 << self.precision


def check_cms(spec: CmsSpec) -> CmsSpec:
    if spec.family not in ("A", "B"):
        raise ValueError(f"unknown Count-Min family {spec.family!r}")
    if not 1 <= spec.width <= 1 << 30 or spec.depth < 1:
        raise ValueError(f"bad Count-Min shape {spec.width}x{spec.depth}")
    return spec


def check_hll(spec: HllSpec) -> HllSpec:
    if spec.family not in ("A", "B"):
        raise ValueError(f"unknown HyperLogLog family {spec.family!r}")
    if not 4 <= spec.precision <= 16:
        raise ValueError("HyperLogLog precision must lie in 4..16")
    return spec


def _unsigned(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def _signed64(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, -10).cast("bigint")


def _swap_bytes(hex_text: Column, n_bytes: int) -> Column:
    return F.concat(*[F.substring(hex_text, 2 * i + 1, 2) for i in reversed(range(n_bytes))])


def cms_column(key: Column, row: int | Column, spec: CmsSpec) -> Column:
    """Cell of ``key`` in sketch row ``row`` (a number or an integer column).

    Family A: md5 of the key followed by the row number, as a 128-bit big-endian number modulo the width.
    Family B: md5 of the key followed by row*101, first four bytes little-endian modulo the width.
    """
    width = F.lit(spec.width).cast("bigint")
    seed = row * (101 if spec.family == "B" else 1)
    digest = F.md5(F.concat(key, seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))))
    # A power-of-two width only looks at the lowest bits, so only as many digits are converted as it needs.
    bits = spec.width.bit_length() - 1 if spec.width & (spec.width - 1) == 0 else None
    if spec.family == "B":
        n_bytes = 4 if bits is None else max(1, -(-bits // 8))
        return (_unsigned(_swap_bytes(digest, n_bytes)) % width).cast("int")
    if bits is not None:
        digits = max(1, -(-bits // 4))
        return (_unsigned(F.substring(digest, 33 - digits, digits)) % width).cast("int")
    rest = F.lit(0).cast("bigint")
    for chunk in range(4):
        rest = F.pmod(rest * F.lit(1 << 32) + _unsigned(F.substring(digest, 8 * chunk + 1, 8)), width)
    return rest.cast("int")


def hll_word(value: Column, spec: HllSpec) -> Column:
    """The 64-bit hash of a string value, as a signed BIGINT.

    Family A: top 64 bits of sha256.  Family B: first 8 bytes of sha1, little-endian.
    """
    if spec.family == "A":
        return _signed64(F.substring(F.sha2(value, 256), 1, 16))
    return _signed64(_swap_bytes(F.sha1(value), 8))


def hll_register(word: Column, spec: HllSpec) -> Column:
    """Register of a hash: its low ``p`` bits."""
    return word.bitwiseAND(F.lit(spec.registers - 1).cast("bigint")).cast("int")


def hll_rho(word: Column, spec: HllSpec) -> Column:
    """Rank of the remaining bits.

    Family A: leading zeros + 1.  Family B: position of the lowest set bit, 64 when none is set.
    """
    p = spec.precision
    rest = F.shiftrightunsigned(word, p)
    if spec.family == "A":
        rho = F.when(rest == 0, F.lit(64 - p + 1)).otherwise(F.lit(64 - p + 1) - F.length(F.bin(rest)))
    else:
        rho = F.when(rest == 0, F.lit(64)).otherwise(F.length(F.bin(rest.bitwiseAND(-rest))))
    return rho.cast("int")


def hll_alpha(spec: HllSpec) -> float:
    """Bias constant of the estimator (published values for the three smallest sizes)."""
    m = spec.registers
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def hll_estimate_expr(inverse_sum: Column, filled: Column, spec: HllSpec) -> Column:
    """Estimate from ``sum(2^-rho)`` over, and number of, the non-empty registers."""
    m = float(spec.registers)
    zeros = F.lit(m) - filled
    raw = F.lit(hll_alpha(spec) * m * m) / (inverse_sum + zeros)
    linear = F.lit(m) * F.log(F.lit(m) / zeros)
    large = raw
    if spec.family == "A":
        # A 64-bit hash has no collisions to correct for above 2^32, so the 32-bit correction stops there.
        space = float(1 << 32)
        large = F.when(
            (raw > F.lit(space / 30)) & (raw < F.lit(space)), F.lit(-space) * F.log(F.lit(1.0) - raw / F.lit(space))
        ).otherwise(raw)
    return F.floor(F.when((raw <= F.lit(2.5 * m)) & (zeros > 0), linear).otherwise(large)).cast("bigint")
