"""Pre-splitting of texts the way two public byte-pair tokenizers do it.

A text is split by a compiled pattern of the standard library, whose classes are spelled out for the Latin
scripts. A text with any other character is split by the tokenizer's own pre-tokenizer, as Unicode tables differ
between libraries. Special strings inside a text are cut out first and become one token each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from tokenizers import Tokenizer

# Letters, other digits and white space among the characters for which the short pattern holds.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ȳ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085   "
PLAIN = "\u0000-\u001b -ȳ‐- ‰-⁞₠-₵"
# The contractions that both tokenizers keep together.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

# A character for which the short patterns don't hold.
ODD = re.compile(f"[^{PLAIN}]")
_WITH_SPACE = re.compile(
    f" ?[{LETTERS}]+|{CONTRACTIONS}| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_WORDS = re.compile(f"[{LETTERS}]+|{CONTRACTIONS}|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


_BYTES = byte_letters()


def to_bytes(letters: str) -> bytes:
    return bytes(map(_BYTES.__getitem__, letters))


class Vocabulary:
    """A byte-level BPE file: token bytes, merges in order, special strings, and the split of a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.word_end: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.merges: list[tuple[str, str]] = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the library splits only: without its own copy of the model
        self._library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self._lower = spec["normalizer"] is not None
        self._short = _WORDS if self._lower else _WITH_SPACE

    def plain(self, text: str) -> list:
        """The pre-tokens of a text in which no string is special."""
        lowered = text.lower() if self._lower else text  # some letters leave the plain range when lowered
        if not ODD.search(lowered) and not (self._lower and ODD.search(text)):
            return self._short.findall(lowered)
        if self._lower:
            text = self._library.normalizer.normalize_str(text)
        return [to_bytes(piece).decode("utf-8") for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str, special: Callable[[str], object] = lambda s: (s,)) -> list:
        """All pre-tokens in order; a special string appears as what ``special`` makes of it."""
        if self._special is None or not self._special.search(text):
            return self.plain(text)
        out: list = []
        at = 0
        for m in self._special.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(special(m[0]))
            at = m.end()
        return out + self.plain(text[at:])
