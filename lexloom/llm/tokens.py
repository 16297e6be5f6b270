"""Token ids by a file of the tokenizers library, with words cached inside each task.

Where the file's rules are of the kind of `_BY_WORDS`, white space parts the pieces that they see and none of them looks
across it, so a text's ids are those of its words in a row. A word met before costs one look-up. Texts of plain letters are
lower-cased first, so that both cases share an entry; words with other characters go through the whole tokenizer. The
caches have a fixed size. With a file of other rules each whole text goes through the tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array

import regex
from tokenizers import Tokenizer

from .common import begins, keeps

VOCABULARY = "word_bpe_49k.json"
#: Words in a cache, and the longest word that is kept.
CACHE, LONGEST = 400_000, 100

#: Rules under which words can be coded one by one, with the pattern of their parts left open.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": None}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
_SPACE = re.compile(r"[\t\n\r ]+")
#: How a pattern of parts ends, and the endings with an apostrophe that may stand before that: none of them begins in letters.
_PARTS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = re.compile(r"('[a-z]+\|)*")
_coders: dict[str, Coder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Turns texts into ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pattern = self._pattern(json.loads(self.tokenizer.to_str()))
        self.by_words = pattern is not None
        self.pattern = regex.compile(pattern or "")
        self.letters_alone = bool(_ENDINGS.fullmatch((pattern or "").removesuffix(_PARTS)))
        self.words = _Cache(self._word)
        self.others = _Cache(self._other)
        # one character stands for each byte in the vocabulary: printable ones for themselves, the rest from 256 upwards
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + k for k, b in enumerate(rest)}

    @staticmethod
    def _pattern(rules: dict) -> str | None:
        """The pattern of a word's parts, or None where words cannot be coded one by one."""
        try:
            split = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]
            pattern, split["Regex"] = split["Regex"], None
        except (KeyError, IndexError, TypeError):
            return None
        same = all(rules[k] == v for k, v in _BY_WORDS.items())
        # a part never holds white space: it is letters, one number, or other signs, which the pattern must say itself
        alone = pattern.endswith(_PARTS)
        return pattern if same and alone and rules["model"]["type"] == "BPE" and not rules["post_processor"] else None

    def _part(self, part: str) -> bytes:
        said = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(said)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A lower-cased word of plain characters; its parts are words too, so one cache holds both."""
        if self.letters_alone and word.isalpha():
            return self._part(word)
        parts = self.pattern.findall(word)
        return self._part(word) if parts == [word] else b"".join(map(self.words.__getitem__, parts))

    def _other(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self._other(text)
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return b"".join(map(self.others.__getitem__, filter(None, _SPACE.split(text))))


class _Cache(dict):
    """Values by word in two generations: when the young one is full it becomes the old one, and what is met again returns."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def coder(path: str) -> Coder:
    """This process's coder for a file."""
    begins("tokens")
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


keeps("tokens", _coders.clear)
