"""Dates in legal text, and when a text takes effect."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import date

MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name} | {"sept": 9}

_SAID = re.compile(r"(\d{1,2})(?:st|nd|rd|th)?(?:\s+day\s+of)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})", re.IGNORECASE)
_NUMBERS = re.compile(r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?!\d)")
_LEAD = re.compile(r"\b(?:the|dated)\s*:?\s*(?:this\s+the\s+)?$", re.IGNORECASE)
_DATED = re.compile(r"\bdated\s*:?\s*(?:this\s+the\s+)?$", re.IGNORECASE)
#: How sure a date is that is said to be one, and one that only stands there.
EXACT, FALLBACK = 0.95, 0.7


def made(day: str, month: str | int, year: str) -> date | None:
    number = month if isinstance(month, int) else MONTHS.get(month.lower().rstrip("."))
    try:
        return date(int(year), number, int(day)) if number else None
    except ValueError:
        return None


def dates(text: str) -> Iterator[tuple[int, date, bool, str]]:
    """(place, date, whether in words, the 30 characters before it) of each valid date: those in words first, then those in numbers."""
    for m in _SAID.finditer(text):
        if (day := made(m[1], m[2], m[3])) is not None:
            yield m.start(), day, True, text[max(0, m.start() - 30) : m.start()]
    for m in _NUMBERS.finditer(text):
        if (day := made(m[1], int(m[2]), m[3])) is not None:
            yield m.start(), day, False, text[max(0, m.start() - 30) : m.start()]


def parse_day(text: str) -> date | None:
    """The first date in words, else the first in numbers."""
    return next((day for _, day, _, _ in dates(text)), None)


def first_dated(text: str) -> tuple[date, float] | None:
    """The first date that is introduced as one (the, dated), else the first of all, and how sure that is."""
    found = list(dates(text))
    for _, day, said, lead in found:
        if (_LEAD if said else _DATED).search(lead):
            return day, EXACT
    return (found[0][1], FALLBACK) if found else None


def last_dated(text: str) -> date | None:
    """The last date after the word `dated`; one in numbers comes before one in words."""
    own = {said: day for _, day, said, lead in dates(text) if _DATED.search(lead)}
    return own.get(False, own.get(True))


_NOTIFIED = re.compile(r"\bon such date as the (?:central )?government may\b", re.IGNORECASE)
_PUBLISHED = re.compile(r"\b(?:come into force|take effect|be effective) on the date of (?:its |their |the )?publication in the official gazette\b", re.IGNORECASE)
_FORCE = re.compile(r"\b(deemed to have )?comes? into force (?:on|with effect from) ([^;]{0,80})", re.IGNORECASE)


def effective(text: str) -> dict | None:
    """When a text comes into force: on a date to be notified, on publication in the gazette, or on a day."""
    flat = " ".join(text.split())
    for condition, pattern in (("on_notification", _NOTIFIED), ("on_gazette", _PUBLISHED)):
        if m := pattern.search(flat):
            return {"condition": condition, "effective_from": None, "phrase": m[0], "retrospective": False}
    m = _FORCE.search(flat)
    day = parse_day(m[2]) if m else None
    return None if day is None else {"condition": "on_date", "effective_from": day, "phrase": m[0].strip(), "retrospective": bool(m[1])}


def effective_for(unit: dict | None, notification: dict | None, doc_date: date | None) -> dict:
    """The effect of a clause: its own, else its notification's, else the day of the gazette."""
    said = unit or notification or {"condition": "on_gazette", "phrase": None, "retrospective": False}
    day = {"on_date": said.get("effective_from"), "on_gazette": doc_date}.get(said["condition"])
    return {"condition": said["condition"], "effective_from": day, "phrase": said["phrase"], "retrospective": said["retrospective"]}
