"""Ethernet / IPv4 / IPv6 / TCP / UDP header fields of a BINARY column, by built-in byte expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed header layout, 1-based byte positions.
ETHERTYPE_AT = 13
IP_AT = 15
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_IPV6 = 0x86DD
TCP, UDP = 6, 17
MIN_L4 = {TCP: 20, UDP: 8}


def uint(frame: Column, at, n_bytes: int) -> Column:
    """Big-endian unsigned number of ``n_bytes`` bytes starting at 1-based position ``at``."""
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(frame, start, F.lit(n_bytes))), 16, 10).cast("bigint")


def ipv4_text(frame: Column, at: int) -> Column:
    return F.concat_ws(".", *[uint(frame, at + i, 1).cast("string") for i in range(4)])


def ipv6_digits(frame: Column, at: int) -> Column:
    """The 32 lower-case hex digits of an IPv6 address."""
    return F.lower(F.hex(F.substring(frame, F.lit(at), F.lit(16))))


def ipv6_text(digits: Column) -> Column:
    """Canonical IPv6 text: lower-case groups, first longest run of two or more zero groups as ``::``.

    The run is found on a mask of zero groups (one character each), so the address text is assembled once.
    """
    groups = [F.substring(digits, 4 * i + 1, 4) for i in range(8)]
    short = F.transform(F.array(*groups), lambda g: F.regexp_replace(g, "^0{1,3}", ""))
    mask = F.array_join(F.transform(short, lambda g: F.when(g == "0", "z").otherwise("x")), "")
    run = F.coalesce(*[F.when(mask.contains("z" * n), F.struct(F.lit(n).alias("n"), F.instr(mask, "z" * n).alias("at")))
                       for n in range(8, 1, -1)])
    tail = F.concat_ws(".", *[F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10) for i in range(4)])
    compressed = F.transform(
        F.array(F.struct(short.alias("g"), run.alias("r"))),
        lambda x: F.when(x["r"].isNull(), F.array_join(x["g"], ":")).otherwise(
            F.concat(
                F.array_join(F.slice(x["g"], 1, x["r"]["at"] - 1), ":"), F.lit("::"),
                F.array_join(F.slice(x["g"], x["r"]["at"] + x["r"]["n"], 8), ":"),
            )
        ),
    )
    return (
        F.when(digits.startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), tail))
        .when(digits.startswith("0" * 24) & (groups[6] != "0000"), F.concat(F.lit("::"), tail))
        .otherwise(F.get(compressed, F.lit(0)))
    )


def l4_ports(frame: Column, proto: Column, start: Column) -> tuple[Column, Column]:
    """Source and destination port, 0 for other protocols and for a cut transport header."""
    left = F.length(frame) - start + 1
    whole = F.lit(False)
    for number, size in MIN_L4.items():
        whole = whole | ((proto == number) & (left >= size))
    return (
        F.when(whole, uint(frame, start, 2)).otherwise(F.lit(0)).cast("int"),
        F.when(whole, uint(frame, start + 2, 2)).otherwise(F.lit(0)).cast("int"),
    )
