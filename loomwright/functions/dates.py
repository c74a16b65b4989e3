"""Dates and datetimes of frontmatter texts, as plain numbers (Python dates have no year 0)."""

from __future__ import annotations

import re

_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", re.ASCII)
_TIME = re.compile(r"[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?:([Zz])|([+-])([0-9]{2})(?::?([0-9]{2}))?)?", re.ASCII)
_MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def epoch_day(text: str) -> int | None:
    """Days since 1970-01-01 of a text that is exactly YYYY-MM-DD and names a day, else None."""
    m = _DATE.fullmatch(text)
    if not m:
        return None
    year, month, day = map(int, m.groups())
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if not 1 <= month <= 12 or not 1 <= day <= _MONTH_DAYS[month - 1] + (leap and month == 2):
        return None
    before = 365 * year + (year + 3) // 4 - (year + 99) // 100 + (year + 399) // 400
    return before + sum(_MONTH_DAYS[: month - 1]) + (leap and month > 2) + day - 1 - 719_528


def instant(text: str) -> dict | None:
    """``day, has_time, second, nano, text`` of an ISO date or datetime; seconds count in UTC, no zone means UTC."""
    text = text.strip()
    day = epoch_day(text[:10])
    if day is None or not text.isascii():
        return None
    if len(text) == 10:
        return {"day": day, "has_time": False, "second": day * 86_400, "nano": 0, "text": text}
    m = _TIME.fullmatch(text, 10)
    if not m:
        return None
    hour, minute, second = (int(x or 0) for x in m.group(1, 2, 3))
    zone_hour, zone_minute = (int(x or 0) for x in m.group(7, 8))
    if hour > 23 or minute > 59 or second > 60 or zone_hour > 23 or zone_minute > 59:
        return None
    offset = (zone_hour * 60 + zone_minute) * (-1 if m[6] == "-" else 1)
    nano = int((m[4] or "0")[:9].ljust(9, "0"))
    fraction = f".{nano:09d}".rstrip("0") if nano else ""
    zone = "Z" if m[5] or (m[6] and not offset) else f"{'-' if offset < 0 else '+'}{zone_hour:02d}:{zone_minute:02d}" if m[6] else ""
    shown = f"{text[:10]}T{hour:02d}:{minute:02d}:{second:02d}{fraction}{zone}"
    return {"day": day, "has_time": True, "second": day * 86_400 + hour * 3600 + minute * 60 + second - offset * 60, "nano": nano, "text": shown}
