"""Filters of calls and registrations from a record such as a JSON object.

Keys name what is compared; lists are alternatives, keys are all required unless "OR" is set. A key that ends in _type
with the value "0" lets its number, address, domain, agent or country be on either side; one that ends in _group lists
named groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions import semantics as X

c = F.col

#: What each key compares: its kind, and the column of each side that it may mean.
KEYS = {
    "caller": ("number", ["caller"]),
    "called": ("number", ["called"]),
    "src_ip": ("address", ["src_ip"]),
    "dst_ip": ("address", ["dst_ip"]),
    "proxy_ip": ("any_address", ["proxy_ips"]),
    "a_saddr": ("address", ["a_saddr"]),
    "b_saddr": ("address", ["b_saddr"]),
    "src_ip_encaps": ("address", ["src_ip_encaps"]),
    "dst_ip_encaps": ("address", ["dst_ip_encaps"]),
    "caller_domain": ("text", ["domain_src"]),
    "called_domain": ("text", ["domain_dst"]),
    "caller_agent": ("text", ["ua"]),
    "called_agent": ("text", ["ua_called"]),
    "caller_name": ("text", ["caller_name"]),
    "call_id": ("text", ["sip_call_id"]),
    "text": ("text", ["ua"]),
    "country_caller": ("list", ["country_caller"]),
    "country_called": ("list", ["country_called"]),
    "country_src_ip": ("list", ["country_src_ip"]),
    "country_dst_ip": ("list", ["country_dst_ip"]),
    "vlan": ("list", ["vlan"]),
    "codec": ("list", ["codec"]),
    "sensor_id": ("list", ["sensor_id"]),
    "src_port": ("list", ["src_port"]),
    "dst_port": ("list", ["dst_port"]),
    "response": ("response", ["lsr"]),
    "duration": ("seconds", ["dur_us"]),
    "calldate": ("microseconds", ["b_us"]),
    "connected": ("exists", ["connect_us"]),
    "flags": ("bits", ["k"]),
}
#: Keys whose condition may hold on either side if their _type is "0".
OTHER_SIDE = {
    "caller": "called", "called": "caller", "src_ip": "dst_ip", "dst_ip": "src_ip", "a_saddr": "b_saddr", "b_saddr": "a_saddr", "src_ip_encaps": "dst_ip_encaps", "dst_ip_encaps": "src_ip_encaps",
    "caller_domain": "called_domain", "called_domain": "caller_domain", "caller_agent": "called_agent", "called_agent": "caller_agent",
    "country_caller": "country_called", "country_called": "country_caller", "country_src_ip": "country_dst_ip", "country_dst_ip": "country_src_ip", "src_port": "dst_port", "dst_port": "src_port",
}


def _address(column: Column, nets: list) -> Column:
    """Addresses as numbers or (network, mask); an address that ends in zero octets is a network."""
    pairs = [n if isinstance(n, (tuple, list)) else (n, X.classless(n)) for n in nets]
    return X.any_of(*(X.network(column, m) == X.network(F.lit(n), m) for n, m in pairs))


def _listed(column: Column, want: list) -> Column:
    """A list of values, of which those that begin with ! are banned."""
    listed = [w for w in want if not str(w).startswith("!")]
    banned = [str(w)[1:] for w in want if str(w).startswith("!")]
    return X.listed(column, X.in_(column, listed) if listed else None, X.in_(column.cast("string"), banned) if banned else None)


_COMPARE = {
    "number": X.number_matches,
    "address": _address,
    "any_address": lambda column, want: F.exists(column, lambda ip: _address(ip, want)),
    "text": lambda column, want: X.any_of(*(X.like(column, p) for p in want)),
    "list": _listed,
    "response": lambda column, want: X.response_listed(column, want.get("white", []), want.get("black", [])),
    "seconds": lambda column, want: X.known(column.between(want[0] * 1_000_000, want[1] * 1_000_000)),
    "microseconds": lambda column, want: X.all_of(*([column >= want[0]] if want[0] is not None else []), *([column < want[1]] if want[1] is not None else [])),
    "exists": lambda column, want: column.isNotNull() == want,
    "bits": lambda column, want: X.known(column.bitwiseAND(want) != 0),
}


def _one(key: str, want, spec: dict, groups: dict, columns: dict) -> Column:
    if key == "codec_compare":  # both legs have the same codec, or not
        return (c("codec_a") == c("codec_b")) == want
    if key == "exclude_codec":
        return X.not_(X.in_(c("codec"), want))
    if key == "headers":  # name of a column that holds the header, and what it may look like
        return X.all_of(*(X.any_of(*(X.like(c(name), p) for p in patterns)) for name, patterns in want.items()))
    if key.endswith("_group"):  # a list of groups stands for all of their members
        key, want = key.removesuffix("_group"), [w for name in want for w in groups[name]]
    kind, here = KEYS[key]
    either = str(spec.get(f"{key}_type", "")) == "0" and key in OTHER_SIDE
    names = [columns.get(n, n) for n in (here + KEYS[OTHER_SIDE[key]][1] if either else here)]
    return X.any_of(*(_COMPARE[kind](c(n), want) for n in names))


def call_filter(spec: dict, groups: dict | None = None, columns: dict | None = None) -> Column:
    """The condition of a filter record; absent and null values do not restrict.

    groups holds the members of named groups, and columns other names of the columns in KEYS.
    """
    parts = [_one(k, v, spec, groups or {}, columns or {}) for k, v in spec.items() if v is not None and k != "OR" and not k.endswith("_type")]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if spec.get("OR") else (lambda a, b: a & b), map(X.known, parts))


def restriction(addresses: list | None = None, numbers: list | None = None, domains: list | None = None, vlans: list | None = None, headers: dict | None = None, any_of: bool = False) -> Column:
    """Rows that a restricted user may see. Each kind that is given holds if it does on any side; all kinds are required,
    or one of them with `any_of`; a user without restrictions sees every row."""
    kinds = []
    if addresses:
        kinds.append(X.any_of(_address(c("src_ip"), addresses), _address(c("dst_ip"), addresses)))
    if numbers:
        kinds.append(X.any_of(*(X.number_matches(c(n), numbers) for n in ("caller", "called"))))
    if domains:
        kinds.append(X.any_of(*(X.like(c(n), p) for n in ("domain_src", "domain_dst") for p in domains)))
    if vlans:
        kinds.append(X.in_(c("vlan"), vlans))
    if headers:
        kinds.append(X.any_of(*(X.like(c(name), p) for name, patterns in headers.items() for p in patterns)))
    if not kinds:
        return F.lit(True)
    return X.any_of(*map(X.known, kinds)) if any_of else X.all_of(*map(X.known, kinds))
