"""Canonical identifiers: made of their parts, and taken apart again. What is not valid gives None."""

from __future__ import annotations

import re
from datetime import date

CODE, YEAR, NUMBER = r"[A-Z0-9_]+", r"\d{4}", r"\d+"
#: The kinds of identifiers, their parts in order and how each part looks.
KINDS: dict[str, tuple[str, dict[str, str]]] = {
    "inst": ("{instrument}", {"instrument": CODE}),
    "prov": ("{instrument}:{path}", {"instrument": CODE, "path": r"[a-z0-9][A-Za-z0-9.]*"}),
    "ntf": ("{series}:{number}/{year}", {"series": r"[A-Z()]+", "number": NUMBER, "year": YEAR}),
    "cir": ("{a}/{b}/{year}", {"a": NUMBER, "b": NUMBER, "year": YEAR}),
    "ins": ("{number}/{year}", {"number": NUMBER, "year": YEAR}),
    "ord": ("{number}/{year}", {"number": NUMBER, "year": YEAR}),
    "jdg": ("{court}:{case}:{decided}", {"court": r"[A-Z0-9()_-]+", "case": r".+", "decided": r"\d{4}-\d{2}-\d{2}"}),
    "unk": ("{digest}", {"digest": r"[0-9a-f]{16}"}),
}
FIELDS = ("kind", "instrument", "path", "series", "number", "year", "a", "b", "court", "case", "decided", "digest")
PARTS = ", ".join(f"{name}: string" for name in FIELDS)

_WHOLE = {kind: re.compile(f"{kind}:" + re.sub(r"\{(\w+)\}", lambda m, looks=looks: f"(?P<{m[1]}>{looks[m[1]]})", shape)) for kind, (shape, looks) in KINDS.items()}


def case_number(text: str) -> str:
    """A case number in capitals, without spaces, with plain dashes."""
    return re.sub(r"[‐-―−]", "-", re.sub(r"\s+", "", text)).upper()


def made(kind: str, **parts: object) -> str | None:
    """The identifier of a kind, or None where a part is missing or does not look as it should."""
    shape, looks = KINDS[kind]
    said = {name: "" if value is None else str(value).strip() for name, value in parts.items()}
    if "case" in said:
        said["case"] = case_number(said["case"])
    if set(said) != set(looks) or any(not re.fullmatch(pattern, said[name]) for name, pattern in looks.items()):
        return None
    return f"{kind}:{shape.format(**said)}" if "decided" not in said or _is_day(said["decided"]) else None


def _is_day(text: str) -> bool:
    try:
        return bool(date.fromisoformat(text))
    except ValueError:
        return False


def provisional(digest: str) -> str:
    """The identifier of a document of which only the bytes are known."""
    return f"unk:{digest[:16]}"


def parsed(value: str | None) -> dict | None:
    """The parts of an identifier by name, with its kind, or None where it is none."""
    m = _WHOLE[kind].fullmatch(value) if (kind := (value or "").split(":", 1)[0]) in _WHOLE else None
    return None if m is None else dict.fromkeys(FIELDS) | m.groupdict() | {"kind": kind}
