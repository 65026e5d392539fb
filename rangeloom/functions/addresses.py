"""IPv4 and IPv6 address functions on columns; IPv4 addresses are BIGINT numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a canonical dotted quad, without boundaries.
QUAD = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
_LAST = 0xFFFFFFFF
_H = "[0-9A-Fa-f]{1,4}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written and computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part_number(part: Column) -> Column:
    """A part of an address: decimal, octal after ``0`` or ``0o``, hexadecimal after ``0x``, binary after ``0b``; null for others and above 32 bits."""
    digits = lambda pattern, base: F.conv(F.regexp_extract(part, pattern, 1), base, 10).cast("bigint")
    value = (F.when(part.rlike(r"^(?:0|[1-9][0-9]{0,9})$"), part.try_cast("bigint"))
             .when(part.rlike(r"^0[oO]?0*[0-7]{1,11}$"), digits(r"^0[oO]?0*([0-7]{1,11})$", 8))
             .when(part.rlike(r"^0[xX]0*[0-9a-fA-F]{1,8}$"), digits(r"^0[xX]0*([0-9a-fA-F]{1,8})$", 16))
             .when(part.rlike(r"^0[bB]0*[01]{1,32}$"), digits(r"^0[bB]0*([01]{1,32})$", 2)))
    return let(value, lambda v: F.when(v <= _LAST, v))


def ipv4_number(text: Column) -> Column:
    """The address of one to four parts between points, as in ``10``, ``10.1``, ``10.0.1`` and ``10.0.0.1``.

    The last part fills the bytes that are left; every other part is one byte.
    """
    def joined(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        chain = F
        for n, top in ((1, _LAST), (2, 0xFFFFFF), (3, 0xFFFF), (4, 0xFF)):
            valid, value = at(n - 1) <= top, at(n - 1)
            for i in range(n - 1):
                valid, value = valid & (at(i) <= 255), value + at(i) * (1 << 24 - 8 * i)
            chain = chain.when((F.size(p) == n) & valid, value)
        return chain.otherwise(F.lit(None).cast("bigint"))

    return let(F.transform(F.split(F.trim(text), r"\.", 6), part_number), joined)


def prefix_length(text: Column) -> Column:
    """0 to 32, as a number or as a netmask whose ones are all in front; null for anything else."""
    number = let(text.try_cast("int"), lambda n: F.when(n <= 32, n))
    mask = let(F.lit(_LAST).cast("bigint") - ipv4_number(text), lambda rest: F.when(rest.bitwiseAND(rest + 1) == 0, 32 - F.bit_count(rest)))
    return F.when(text.rlike(r"^[+]?[0-9]{1,9}$"), number).otherwise(mask)


def netmask(prefix: Column) -> Column:
    """The netmask of a prefix length, as a number."""
    return F.lit(1 << 32).cast("bigint") - _width(prefix)


def _width(prefix: Column) -> Column:
    return F.pow(F.lit(2.0), 32 - prefix).cast("bigint")


def network(address: Column, prefix: Column) -> Column:
    """The first address of the block of that length that holds an address."""
    return address - F.pmod(address, _width(prefix))


def broadcast(address: Column, prefix: Column) -> Column:
    """The last address of the block."""
    return let(_width(prefix), lambda width: address - F.pmod(address, width) + width - 1)


def endpoint(token: Column, default_prefix: int = 32, mask_cidr: bool = True) -> Column:
    """``lo, hi`` of one token: an address, or an address and a prefix; null for anything else.

    Without ``mask_cidr`` the first address is the literal one.
    """
    def placed(parts: Column) -> Column:
        address = ipv4_number(F.get(parts, F.lit(0)))
        prefix = F.when(F.size(parts) == 2, prefix_length(F.get(parts, F.lit(1)))).otherwise(F.lit(default_prefix))
        return let(F.struct(address.alias("a"), prefix.alias("p")), lambda x: F.when(x["a"].isNotNull() & x["p"].isNotNull(), F.struct(
            (network(x["a"], x["p"]) if mask_cidr else x["a"]).alias("lo"), broadcast(x["a"], x["p"]).alias("hi"))))

    return let(F.split(token, "/", 2), placed)


def is_ipv4(text: Column) -> Column:
    """A dotted quad, plain or mapped into IPv6."""
    return text.rlike(rf"^(?:(?i)(?:(?:0{{1,4}}:){{5}}|::(?:0{{1,4}}:)*)ffff:)?{QUAD}$") | mapped(text)


def mapped(text: Column) -> Column:
    """An IPv6 text of an IPv4 address in ``::ffff:0:0/96``."""
    return text.rlike(rf"(?i)^(?:(?:0{{1,4}}:){{5}}|(?:0{{1,4}}(?::0{{1,4}}){{0,3}})?::(?:0{{1,4}}:){{0,4}})ffff:(?:{QUAD}|{_H}:{_H})$")


def _ipv6_shape(text: Column) -> Column:
    plain = F.when(text.rlike(rf":{QUAD}$"), F.regexp_replace(text, rf"{QUAD}$", "0:0")).otherwise(text)
    groups = F.size(F.filter(F.split(plain, ":", -1), lambda g: g != ""))
    full = plain.rlike(rf"^(?:{_H}:){{7}}{_H}$")
    short = plain.rlike(rf"^(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?$") & (groups <= 7)
    return full | short


def is_ipv6(text: Column) -> Column:
    """An IPv6 address that is not an IPv4 one in disguise."""
    return _ipv6_shape(text) & ~mapped(text)


def is_cidr4(text: Column) -> Column:
    return text.rlike(rf"^{QUAD}/(?:3[0-2]|[12]?[0-9])$")


def is_cidr6(text: Column) -> Column:
    return text.rlike(r"/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])$") & is_ipv6(F.substring_index(text, "/", 1)) & (F.size(F.split(text, "/", -1)) == 2)
