"""IP addresses as text that sorts as the numbers do: 32 hex digits, IPv4 mapped into IPv6. Built-in functions only."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
_V6 = r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$"


def literal_key(text: str) -> str:
    """The key of an address in a query; ValueError if it is none."""
    a = ipaddress.ip_address(text)
    n = int(a) if a.version == 6 else int(a) + (0xFFFF << 32)
    return f"{n:032x}"


def ip_key(c: Column) -> Column:
    """The key of each address in a string column, null for what is none."""
    parts = F.split(c, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + F.coalesce(p.try_cast("long"), F.lit(0).cast("long")))
    v4 = F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(number)), 8, "0"))
    sides = F.split(c, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
    every = F.when(F.size(sides) == 2, F.concat(left, zeros, right)).otherwise(left)
    wide = F.lower(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(c.rlike(_V4), v4).when(c.rlike(_V6) & (F.length(wide) == 32), wide)
