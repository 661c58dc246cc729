"""Number formats of workbooks: what a stored number shows.

A format code has up to four sections (positive, negative, zero, text), or
sections with conditions of their own. Each is cut into quoted and escaped
literals, bracketed colours, conditions, currencies and locales, elapsed-time
units, date and time letters, and digits. Only the section that applies to a
number says whether it shows a date, an elapsed time, or a plain number.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache

NUMBER, DATE, ELAPSED = "number", "date", "elapsed"
#: Built-in formats that show dates or times of day, and the one that shows elapsed time.
_BUILT_IN = {**dict.fromkeys([*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)], DATE), 46: ELAPSED}
_TOKEN = re.compile(r"""
    (?P<literal>"[^"]*"?|\\.|_.|\*.)       # shown as it stands, or as space
  | \[(?P<elapsed>[hms]+)\]                # hours, minutes or seconds that run on
  | \[(?P<condition>[<>=]+-?[0-9.]+)\]     # when the section applies
  | \[(?P<bracket>[^\]]*)\]?               # colour, currency, locale
  | (?P<next>;)
  | (?P<plain>general|[0#?]+(?:[.,][0#?]*)*|[.,%]|e[+-][0#?]*|/|@)
  | (?P<day>am/pm|a/p|上午/下午|[ymdhsgeb]+|aaaa?)
  | (?P<other>.)
""", re.X | re.I | re.S)
_MEETS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b,
          "<>": lambda a, b: a != b}


@lru_cache(1024)
def sections(code: str) -> tuple[tuple[str, tuple[str, float] | None], ...]:
    """(what it shows, its condition) of each section."""
    out, kind, when = [], NUMBER, None
    for m in _TOKEN.finditer(code):
        if m.lastgroup == "elapsed":
            kind = ELAPSED
        elif m.lastgroup == "day" and kind == NUMBER:
            kind = DATE
        elif m.lastgroup == "condition":
            sign, limit = re.fullmatch(r"([<>=]+)(.*)", m["condition"]).groups()
            when = (sign, float(limit)) if sign in _MEETS else None
        elif m.lastgroup == "next":
            out.append((kind, when))
            kind, when = NUMBER, None
    return (*out, (kind, when))


def shows(code: str, value: float) -> str:
    """What the code shows of a number: ``NUMBER``, ``DATE`` or ``ELAPSED``."""
    parts = sections(code)[:3]
    if any(when for _, when in parts):
        for kind, when in parts:
            if when is None or _MEETS[when[0]](value, when[1]):
                return kind
        return NUMBER
    at = 1 if value < 0 and len(parts) > 1 else 2 if value == 0 and len(parts) > 2 else 0
    return parts[at][0]


def shows_built_in(number: int) -> str:
    return _BUILT_IN.get(number, NUMBER)


def serial_date(value: str, since_1904: bool) -> str:
    """ISO text of a serial day; below one day the time alone; what is no date stays as it is.

    The day 60 of the epoch of 1900 never was; numbers below it count from one day later.
    """
    try:
        days = float(value)
        if not since_1904 and 0 <= days < 1:
            return (dt.datetime.min + dt.timedelta(seconds=min(round(days * 86400), 86399))).strftime("%H:%M:%S")
        base = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30) if days >= 61 else dt.datetime(1899, 12, 31)
        when = base + dt.timedelta(seconds=round(days * 86400))
    except (ValueError, OverflowError):
        return value
    return when.isoformat(" ")[:10 if when.time() == dt.time() else 19]


def elapsed_time(value: str) -> str:
    """Hours, minutes and seconds of a number of days."""
    try:
        seconds = round(float(value) * 86400)
    except (ValueError, OverflowError):
        return value
    minutes, rest = divmod(abs(seconds), 60)
    return f"{'-' if seconds < 0 else ''}{minutes // 60}:{minutes % 60:02d}:{rest:02d}"


def iso_date(value: str) -> str:
    """A cell that stores an ISO date-time, without a midnight."""
    return re.sub(r" 00:00:00$", "", re.sub(r"(?:\.0+)?Z?$", "", value.strip().replace("T", " ")))
