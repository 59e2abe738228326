"""The filter language's operators as Column builders.

The language has two truth values: a comparison with null is false, and its negation therefore true. Filters are built
from these functions; Catalyst folds, pushes down and compiles them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once, for use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def known(c: Column) -> Column:
    """A condition with two truth values."""
    return F.coalesce(c, F.lit(False))


def eq(a: Column, b) -> Column:
    return known(a == b)


def ne(a: Column, b) -> Column:
    return known(a != b)


def lt(a: Column, b) -> Column:
    return known(a < b)


def le(a: Column, b) -> Column:
    return known(a <= b)


def gt(a: Column, b) -> Column:
    return known(a > b)


def ge(a: Column, b) -> Column:
    return known(a >= b)


def is_(a: Column, b: Column) -> Column:
    """Compares only whether both are null."""
    return a.isNull() == b.isNull()


def in_(a: Column, values: list) -> Column:
    return known(a.isin(*values))


def not_in(a: Column, values: list) -> Column:
    return known(~a.isin(*values))


def not_(a: Column) -> Column:
    return ~known(a)


def like(a: Column, pattern: str) -> Column:
    """Case-insensitive. % counts only at the ends; _ is any character except between two %; an empty pattern is false."""
    if not pattern:
        return F.lit(False)
    text, p = F.lower(a), pattern.lower()
    head, tail = p.startswith("%"), p.endswith("%") and len(p) > 1
    body = p[1 if head else 0 : -1 if tail else None].replace("\\%23", "%23")
    if head and tail:
        return known(text.contains(body))
    wild = "".join("." if ch == "_" else re.escape(ch) for ch in body)
    return known(text.rlike(f"(?s){'' if head else '^'}{wild}{'' if tail else '\\z'}"))


def divide_int(a: Column, b: Column) -> Column:
    """Whole division towards zero, exact for all of bigint; 0 by zero."""
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0))))


def divide_float(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def if_(c: Column, a: Column, b: Column) -> Column:
    return F.when(known(c), a).otherwise(b)


def inet_aton(text: Column) -> Column:
    """The number of a dotted IPv4 address; null if it isn't one."""
    p = F.split(text, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    number = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    valid = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(p, lambda x: known(x.try_cast("int") <= 255))
    return F.when(valid, number)


def inet6_aton(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, which compare like addresses; null if it isn't one."""
    halves = F.split(F.lower(text), "::")
    groups = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    filled = F.concat(left, F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), right)
    shaped = text.rlike("^[0-9A-Fa-f]{0,4}(::?[0-9A-Fa-f]{1,4})*(::)?$") & (F.size(halves) <= 2)
    right_number = F.when(F.size(halves) == 2, missing > 0).otherwise(missing == 0)
    return F.when(shaped & right_number & ~text.rlike("^:[^:]"), F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def network6(digits: Column, mask: int) -> Column:
    """The leading bits of an IPv6 address, whose digits inet6_aton gives, the others as zeros."""
    whole, bits = divmod(mask, 4)
    digit = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int").bitwiseAND(16 - (1 << (4 - bits)))
    return F.rpad(F.concat(F.substring(digits, 1, whole), F.lower(F.conv(digit.cast("string"), 10, 16)) if bits else F.lit("")), 32, "0")


def inet_ntoa(ip: Column) -> Column:
    byte = lambda shift: F.shiftright(ip, shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def network(ip: Column, mask: int) -> Column:
    return F.shiftleft(F.shiftright(ip, 32 - mask), 32 - mask)


def broadcast_address(ip: Column, mask: int) -> Column:
    return network(ip, mask) + (2 ** (32 - mask) - 1)


def is_private(ip: Column) -> Column:
    return ip.between(167772160, 184549375) | ip.between(2886729728, 2887778303) | ip.between(3232235520, 3232301055)


def classless(ip: int) -> int:
    """The mask of a listed address without one: trailing zero octets make it a network."""
    for mask in (8, 16, 24):
        if ip % (1 << (32 - mask)) == 0:
            return mask
    return 32


def number_matches(number: Column, items: list[str]) -> Column:
    """Exact, prefix%, %suffix, %part%, wildcard with _, or an interval from-to of whole numbers."""
    found = F.lit(False)
    for item in items:
        if m := re.fullmatch(r"(\d+)-(\d+)", item):
            found |= known((F.length(number) == len(m[1])) & number.try_cast("bigint").between(int(m[1]), int(m[2])))
        else:
            found |= like(number, item)
    return found


def listed(value: Column, white: Column | None, black: Column | None) -> Column:
    """Black lists win; without a white list everything else passes."""
    passes = F.lit(True) if white is None else white
    return passes if black is None else passes & ~black


def response_listed(code: Column, white: list[str], black: list[str]) -> Column:
    """Prefixes of digits; black first; without white ones nothing passes."""
    any_of = lambda ps: F.array_contains(F.array(*(code.cast("string").startswith(p) for p in ps)), True) if ps else F.lit(False)
    return ~any_of(black) & any_of(white)


def hour_gate(hour: Column, begin: int, end: int) -> Column:
    """Inclusive hours, past midnight where begin is later than end."""
    return hour.between(begin, end) if begin <= end else (hour >= begin) | (hour <= end)


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= known(c)
    return out


def any_of(*conditions: Column) -> Column:
    """An empty group is false."""
    out = F.lit(False)
    for c in conditions:
        out |= known(c)
    return out


def by_level(items: list[tuple[int, Column]]) -> Column:
    """Conditions by indentation: a deeper one is required beside its parent, those of one level are alternatives."""

    def group(at: int, level: int) -> tuple[Column, int]:
        alternatives = []
        while at < len(items) and items[at][0] >= level:
            own, at = items[at][1], at + 1
            if at < len(items) and items[at][0] > level:
                deeper, at = group(at, items[at][0])
                own = all_of(own, deeper)
            alternatives.append(own)
        return any_of(*alternatives), at

    return group(0, items[0][0])[0] if items else F.lit(False)
