"""Words of a text as they are searched for, queries in the form people type them, and how well a text fits one."""

from __future__ import annotations

import re
from typing import NamedTuple

import regex

from .stemmer import stem

#: English words that are not searched for.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now""".split()
)
#: Weights of a heading's words and of a text's.
WEIGHTS = {"A": 1.0, "B": 0.4}

#: A word: letters, digits and the marks that belong to them, as the SQL side says it too.
WORD = r"[\p{L}\p{N}\p{M}]+"
_WORD = regex.compile(WORD)


def plain(text: str | None) -> list[str]:
    """The words of a text, lower-case."""
    return [m[0].lower() for m in _WORD.finditer(text or "")]


def words(text: str | None, english: bool = True) -> list[tuple[str, int]]:
    """(term, position) of each word of a text; in English, without stop words (which still have a position) and without endings."""
    return [(stem(w) if english else w, k) for k, w in enumerate(plain(text)) if not (english and w in STOP)]


def postings(heading: str | None, text: str | None, english: bool = True) -> list[tuple[str, list[int], list[float]]]:
    """(term, positions, weights) of a heading followed by a text, in the order of terms."""
    own = words(heading, english)
    offset = len(_WORD.findall(heading or ""))
    places: dict[str, list[tuple[int, float]]] = {}
    for weight, found, shift in ((WEIGHTS["A"], own, 0), (WEIGHTS["B"], words(text, english), offset)):
        for term, at in found:
            places.setdefault(term, []).append((at + shift, weight))
    return [(term, [p for p, _ in at], [w for _, w in at]) for term, at in sorted(places.items())]


class Item(NamedTuple):
    """A phrase: terms with their places in it, wanted or not."""

    terms: tuple[tuple[str, int], ...]
    wanted: bool


Query = list[list[Item]]


def parsed(query: str, english: bool = True) -> Query:
    """Alternatives (OR) of items that must all hold: words, "phrases", and -words or -"phrases" that must not stand there.

    Never fails; quotes left open end with the query, an OR without two sides is nothing, brackets mean nothing.
    """
    out: Query = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(-?)([^\s"]+)', query):
        quoted, negated, said = m[2] is not None, bool(m[1] or m[3]), m[2] if m[2] is not None else m[4]
        if not quoted and said == "OR" and not negated:
            out.append([])
        elif terms := words(said, english):
            first = terms[0][1]
            out[-1].append(Item(tuple((t, p - first) for t, p in terms), not negated))
    return [items for items in out if any(i.wanted for i in items)]


def terms_of(query: Query) -> list[str]:
    return sorted({t for items in query for item in items for t, _ in item.terms})


def _starts(item: Item, places: dict[str, list[int]]) -> list[int]:
    """Where a phrase begins."""
    (first, _), *rest = item.terms
    return [p for p in places.get(first, ()) if all(p + shift in places.get(t, ()) for t, shift in rest)]


def matches(query: Query, places: dict[str, list[int]]) -> bool:
    """Whether a text with these positions of terms fits a query."""
    return any(all(bool(_starts(item, places)) == item.wanted for item in items) for items in query)


def cover_density(query: Query, places: dict[str, list[int]], weights: dict[str, list[float]]) -> float:
    """The sum over the shortest spans that hold a wanted alternative: the harmonic mean of their terms' weights, less for every other word between.

    The published cover-density method, with the weights of heading and text.
    """
    best = 0.0
    for items in query:
        if not all(bool(_starts(item, places)) == item.wanted for item in items):
            continue
        wanted = sorted({t for item in items if item.wanted for t, _ in item.terms})
        events = sorted((p, t, w) for t in wanted for p, w in zip(places[t], weights[t], strict=True))
        last: dict[str, tuple[int, float]] = {}
        total, before = 0.0, -1
        for p, t, w in events:
            last[t] = (p, w)
            if len(last) == len(wanted):
                begin = min(at for at, _ in last.values())
                if begin > before:  # no shorter span begins here
                    total += len(wanted) / sum(1 / x for _, x in last.values()) / (1 + max(0, p - begin - len(wanted) + 1))
                    before = begin
        best = max(best, total)
    return best


def snippet(query: Query, text: str | None, most: int = 35, least: int = 15, english: bool = True) -> str:
    """The passage of at most `most` words with the most different wanted terms, these between <mark> and </mark>."""
    found = list(_WORD.finditer(text or ""))
    wanted = {t for items in query for item in items if item.wanted for t, _ in item.terms}
    hits = [(k, t) for m, k in zip(found, range(len(found)), strict=True) if (t := stem(m[0].lower()) if english else m[0].lower()) in wanted]
    if not hits:
        return (text or "")[:200]
    first = max((k for k, _ in hits), key=lambda a: (len({t for k, t in hits if a <= k < a + most}), -a))
    inside = [k for k, _ in hits if first <= k < first + most]
    end = min(len(found), max(inside[-1] + 1, first + least))
    first = max(0, min(first, end - least))
    marked = {k for k, _ in hits}
    out, at = [], found[first].start()
    for k in range(first, end):
        out += [text[at : found[k].start()], f"<mark>{found[k][0]}</mark>" if k in marked else found[k][0]]
        at = found[k].end()
    return "".join(out)
