"""Addresses, flow keys, prefixes and keyed anonymisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_SHA256_BLOCK = 64


def flow_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", proto="proto") -> Column:
    """``src:sport->dst:dport/proto``, the key of the directed-flow sketches."""
    return F.concat(
        F.col(src_ip), F.lit(":"), F.col(src_port).cast("string"), F.lit("->"),
        F.col(dst_ip), F.lit(":"), F.col(dst_port).cast("string"), F.lit("/"), F.col(proto),
    )


def flow_id(src_ip="src_ip", dst_ip="dst_ip", proto="proto", src_port="src_port", dst_port="dst_port") -> Column:
    """``src|dst|proto|sport|dport``, the key of counter snapshots."""
    return F.concat_ws(
        "|", F.col(src_ip), F.col(dst_ip), F.col(proto),
        F.col(src_port).cast("string"), F.col(dst_port).cast("string"),
    )


def flow_key_endpoints(key: Column) -> tuple[Column, Column]:
    """Source and destination address of a flow key, NULL when malformed.

    Ports are cut from the right-hand end of each half, so colon-separated IPv6 addresses survive.
    """
    pattern = r"^(.+):[0-9]+->(.+):[0-9]+(/[^/]*)?$"
    ok = key.rlike(pattern)
    return (
        F.when(ok, F.regexp_extract(key, pattern, 1)),
        F.when(ok, F.regexp_extract(key, pattern, 2)),
    )


def protocol_name(number: Column) -> Column:
    return F.when(number == 6, "TCP").when(number == 17, "UDP").otherwise(number.cast("string"))


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to an unsigned value in a BIGINT; NULL for anything but strict IPv4."""
    parts = F.split(ip, r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    value = F.shiftleft(octet[0], 24) + F.shiftleft(octet[1], 16) + F.shiftleft(octet[2], 8) + octet[3]
    return F.when(is_ipv4(ip), value)


def long_to_ipv4(value: Column) -> Column:
    octet = lambda shift: F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("string")
    dot = F.lit(".")
    return F.concat(octet(24), dot, octet(16), dot, octet(8), dot, octet(0))


def network_of(value: Column, mask_len: int) -> Column:
    """Network address of an IPv4 value under a fixed mask length."""
    mask = (0xFFFFFFFF << (32 - mask_len)) & 0xFFFFFFFF
    return value.bitwiseAND(F.lit(mask).cast("bigint"))


def cidr(value: Column, mask_len: int) -> Column:
    return F.concat(long_to_ipv4(network_of(value, mask_len)), F.lit(f"/{mask_len}"))


def mask_length(prefix: Column) -> Column:
    """Digits after the slash; 0 when there is no slash."""
    return F.when(prefix.contains("/"), F.substring_index(prefix, "/", -1).cast("int")).otherwise(F.lit(0))


def anonymize_ip(ip: Column, key: str | bytes, length: int = 16) -> Column:
    """Keyed HMAC-SHA256 of an address, cut to ``length`` hex characters.

    Only the two padded keys are prepared on the driver; hashing itself is built-in ``sha2``.
    """
    raw = key.encode("utf-8") if isinstance(key, str) else bytes(key)
    if not raw:
        raise ValueError("an anonymisation key is required")
    if len(raw) > _SHA256_BLOCK:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_SHA256_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in raw))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in raw))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(ip, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer_pad, inner), 256), 1, length)
