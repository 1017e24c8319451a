"""Date-time and interval literals."""

from __future__ import annotations

import datetime as dt
import re

from orweave.errors import QueryError

# A year counts as 52 weeks and a month as 30 days.
UNIT_SECONDS = {"year": 52 * 7 * 86400, "mon": 30 * 86400, "week": 7 * 86400, "day": 86400, "hour": 3600, "minute": 60, "second": 1}


def parse_interval(text: str) -> dt.timedelta:
    """``HH:MM`` or ``<count> <unit>``; a unit is known by how it starts."""
    if m := re.fullmatch(r"\s*(-?\d+):(\d+)\s*", text):
        return dt.timedelta(hours=int(m[1]), minutes=int(m[2]))
    if m := re.fullmatch(r"\s*(-?\d+)\s+([a-z]+)\s*", text):
        for unit, seconds in UNIT_SECONDS.items():
            if m[2].startswith(unit):
                return dt.timedelta(seconds=int(m[1]) * seconds)
    raise QueryError(f"not an interval: {text!r}")


def parse_datetime(text: str) -> dt.datetime:
    """RFC 3339, ``Y-m-d H:M:S`` or ``Y-m-d``; the result is UTC without a zone."""
    try:
        found = dt.datetime.fromisoformat(text.strip())
    except ValueError:
        raise QueryError(f"not a date or time: {text!r}") from None
    return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found
