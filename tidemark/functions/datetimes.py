"""Date parsing and formatting."""

from __future__ import annotations

import datetime as dt
import re
from functools import cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss Z")


def from_unix(c: Column) -> Column:
    """A timestamp from a number, whose magnitude tells seconds, milli-, micro- or nanoseconds."""
    n, size = c.cast("long"), F.abs(c.cast("long"))
    return F.when(size < 100_000_000_000, F.timestamp_micros(n * 1_000_000)).when(size < 100_000_000_000_000, F.timestamp_micros(n * 1000)).when(size < 100_000_000_000_000_000, F.timestamp_micros(n)).otherwise(F.timestamp_micros(F.floor(n / 1000).cast("long")))


_NUMBER = r"[-+]?\d{1,99}"


@cache
def _shape(format: str) -> str | None:
    """A pattern that every text of a format fits, and few others; None where a format has letters that it doesn't know.

    Optional sections stay optional, and numbers without a sign between them are one number.
    """
    out: list[str] = []
    for m in re.finditer(r"'((?:[^']|'')*)'|(([A-Za-z])\3*)|(.)", format, re.S):
        text, run, letter, sign = m.groups()
        if run and (letter in "yudDHhkKmsS" or run in ("M", "MM", "L", "LL")):
            part = _NUMBER
        elif run and letter in "ML":
            part = r"\S+"
        elif run and letter in "XxZ":
            part = ".*"
        elif sign in ("[", "]"):
            part = "(?:" if sign == "[" else ")?"
        elif run or sign in ("{", "}", "#", "'"):
            return None
        else:
            part = re.escape((text.replace("''", "'") or "'") if text is not None else sign)
        if part != _NUMBER or out[-1:] != [part]:
            out.append(part)
    return f"(?isu)^{''.join(out)}$"


def parse(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits; numbers are Unix times; else null.

    A format is tried where the text has its shape: Spark throws and catches an exception for each text that fails.
    """
    bare = F.when(c.rlike(r"^[A-Za-z]{3}, "), F.substring(c, 6, 1 << 30)).otherwise(c)  # a weekday adds nothing
    times = [(F.try_to_timestamp(bare, F.lit(f)), _shape(f)) for f in formats]
    return F.coalesce(*[F.when(bare.rlike(shape), t) if shape else t for t, shape in times], F.when(c.rlike(r"^-?\d{8,19}$"), from_unix(c.try_cast("long"))))


_JAVA = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def literal_time(value: Any, format: str | None = None) -> dt.datetime:
    """A query's date, in UTC."""
    if isinstance(value, dt.datetime):
        t = value
    elif isinstance(value, int | float) or str(value).lstrip("-").isdigit():
        n, scale = int(value), 1
        for limit, s in ((1e11, 1), (1e14, 1e3), (1e17, 1e6), (1e30, 1e9)):
            if abs(n) < limit:
                scale = s
                break
        t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(n * 1_000_000 // scale))
    else:
        text = str(value).strip()
        if format and format not in ("strict_date_optional_time", "epoch_millis", "epoch_second"):
            pattern = format
            for k, v in _JAVA.items():
                pattern = pattern.replace(k, v)
            t = dt.datetime.strptime(text, pattern.replace("'", ""))
        else:
            t = dt.datetime.fromisoformat(text.replace("/", "-").replace("Z", "+00:00"))
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo is not None else t


def parse_literal(value: Any, precision: str = "us", format: str | None = None) -> Column:
    """A query's date as a timestamp, cut to the field's precision."""
    t = literal_time(value, format)
    cut = {"s": 1_000_000, "ms": 1000, "us": 1}[precision]
    t = t.replace(microsecond=t.microsecond // cut * cut)
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def output(c: Column, style: str) -> Column:
    t = c.cast("timestamp")
    return {"rfc3339": lambda: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "rfc2822": lambda: F.concat(F.date_format(t, "EEE"), F.lit(", "), F.date_format(t, "dd MMM yyyy HH:mm:ss Z")), "unix_timestamp_secs": lambda: F.unix_seconds(t), "unix_timestamp_millis": lambda: F.unix_millis(t), "unix_timestamp_micros": lambda: F.unix_micros(t), "unix_timestamp_nanos": lambda: F.unix_micros(t) * 1000}[style]()


def truncate(c: Column, precision: str) -> Column:
    return F.date_trunc({"s": "second", "ms": "millisecond", "us": "microsecond"}[precision], c)


def window_start(seconds: Column, duration: int) -> Column:
    """Start of the window of ``duration`` seconds (a divisor of an hour); floors below zero too."""
    if duration <= 0 or 3600 % duration:
        raise ValueError("a window's duration divides 3600 seconds")
    return seconds - F.pmod(seconds, F.lit(duration))
