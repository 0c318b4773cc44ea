"""Spreadsheet values as the text that a user would search for."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

#: Decimal places that are kept: what lies beyond is noise of binary fractions.
PLACES = 10


def number_text(x: float) -> str:
    """Plain decimal notation of the shortest number that reads back as ``x``; nothing for what is no number."""
    if not math.isfinite(x):
        return ""
    exact = Decimal(repr(x))
    if -exact.as_tuple().exponent > PLACES:
        exact = round(exact, PLACES)
    return format(exact.normalize() + 0, "f")  # + 0: no minus before a zero


def moment_text(x: dt.datetime | dt.date | dt.time) -> str:
    """ISO notation; a midnight is its date alone."""
    if isinstance(x, dt.datetime):
        return f"{x:%Y-%m-%d}" if x.time() == dt.time() else f"{x:%Y-%m-%d %H:%M:%S}"
    return f"{x:%H:%M:%S}" if isinstance(x, dt.time) else f"{x:%Y-%m-%d}"


def format_cell(value: object) -> str:
    match value:
        case None:
            return ""
        case bool():
            return "TRUE" if value else "FALSE"
        case float():
            return number_text(value)
        case dt.date() | dt.time():
            return moment_text(value)
        case _:  # text, whole numbers, spans of time
            return str(value)
