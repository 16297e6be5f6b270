"""English stems by the published second Porter algorithm: endings by step, and the regions in which they may go."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words with a stem of their own, words that stay, and words that stay once a plural is gone.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
STAY_SINGULAR = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings after which the first region starts at once.
BEGIN = ("gener", "commun", "arsen")
#: Steps 2 and 3, ending and what takes its place in the first region; * marks endings with a condition of their own.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "*", "fulli": "ful", "lessli": "less", "li": "*",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "*"}
#: Step 4, endings that go in the second region.
STEP_4 = {e: "" for e in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()} | {"ion": "*"}
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
#: A short syllable at the end; Y is a consonant.
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _ending(word: str, endings) -> str:
    """The longest ending of a word among some; empty where there is none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin."""
    first = len(next((b for b in BEGIN if word.startswith(b)), "")) or (m.end() if (m := _REGION.search(word)) else len(word))
    return first, m.end() if (m := _REGION.search(word, first)) else len(word)


def _plural(word: str) -> str:
    ending = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        return word[:-2]
    if ending in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if ending == "s" and _VOWEL.search(word[:-2]) else word


def _past(word: str, first: int) -> str:
    ending = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = word.removesuffix(ending) if ending else word
    if ending in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= first else word
    if not ending or not _VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest[-2:] in DOUBLES:
        return rest[:-1]
    return rest + "e" if first >= len(rest) and _SHORT.search(rest) else rest


def _replaced(word: str, table: dict[str, str], region: int, second: int) -> str:
    """The word with its longest ending of a table replaced, where that lies in a region."""
    ending = _ending(word, table)
    rest = word.removesuffix(ending) if ending else word
    if not ending or len(rest) < region:
        return word
    if (instead := table[ending]) != "*":
        return rest + instead
    fits = {"ogi": rest.endswith("l"), "li": rest.endswith(tuple("cdeghkmnrt")), "ative": len(rest) >= second, "ion": rest.endswith(("s", "t"))}[ending]
    return (rest + "og" if ending == "ogi" else rest) if fits else word


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words with other than ASCII letters and apostrophes stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.replace("'", "").isalpha():
        return word
    word = word.removeprefix("'")
    if word in OWN or word in STAY:
        return OWN.get(word, word)
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = _plural(word.removesuffix(_ending(word, ("'", "'s", "'s'"))))
    if word in STAY_SINGULAR:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP_2, first, second)
    word = _replaced(word, STEP_3, first, second)
    word = _replaced(word, STEP_4, second, second)
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")
