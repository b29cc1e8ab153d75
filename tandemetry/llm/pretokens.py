"""Caches in front of a tokenizer of the tokenizers library, exact for every text.

Two levels: runs of text that the tokenizer never joins across, and within them the pre-tokens that its own pattern cuts.
A run of Latin-1 characters is cut here by that pattern and its pre-tokens go straight to the BPE model; any other run,
or one that may hold a special token, is encoded by the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: Entries of the two levels; a full level starts anew. Together they take some 200 MB.
RUNS, PRE_TOKENS = 600_000, 400_000
#: Longer runs and pre-tokens aren't kept: they hardly repeat, and a cache of them wouldn't be bounded.
LONGEST = 64

_LATIN = [chr(c) for c in range(256)]
_LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
#: How the public tokenizers cut text, here for Latin-1.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BY_WORD = re.compile(rf"{_SHORT}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_BY_BYTE = re.compile(rf"{_SHORT}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")

#: White space that libraries don't agree on.
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
ODD_ASCII = "\x1c\x1d\x1e\x1f"


def plain_space(text: str) -> bool:
    """Whether all of the text's white space is ASCII that every library takes for white space."""
    if text.isascii():
        return not any(c in text for c in ODD_ASCII)
    return not ODD_SPACE.search(text)


def added_strings(tokenizer) -> re.Pattern:
    """Finds the strings that the tokenizer cuts out of a text before its own pattern sees the rest, in any case of letters."""
    strings = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(strings) or "(?!)", re.IGNORECASE)


def ids_as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return np.array(ids, "<u4").tobytes()


def _cut(tokenizer) -> tuple[re.Pattern | None, bool]:
    """The pattern for Latin-1 and whether to lower first; no pattern for a tokenizer of another make."""
    spec = json.loads(tokenizer.to_str())
    kind, norm = spec["pre_tokenizer"], spec["normalizer"]
    if kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and norm is None:
        return _BY_BYTE, False
    names = [n["type"] for n in (norm or {}).get("normalizers", [])]
    parts = kind.get("pretokenizers", [])
    if names == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        pattern = parts[0]["pattern"].get("Regex", "")
        if pattern == rf"{_SHORT}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+":
            return _BY_WORD, True
    return None, False


class _PreTokens(dict):
    def __init__(self, tokenizer, of: Callable):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LATIN}
        self.tokenize, self.of = tokenizer.model.tokenize, of

    def __missing__(self, part: str):
        value = self.of([t.id for t in self.tokenize(part.translate(self.alphabet))])
        if len(part) <= LONGEST:
            if len(self) >= PRE_TOKENS:
                self.clear()
            self[part] = value
        return value


class Runs(dict):
    """Run to what ``of`` makes of its ids; ``join`` adds up the values of its pre-tokens (sum, b"".join)."""

    def __init__(self, tokenizer, of: Callable, join: Callable):
        super().__init__()
        self.encode, self.of, self.join = tokenizer.encode, of, join
        self.pattern, self.lower = _cut(tokenizer)
        self.parts = _PreTokens(tokenizer, of)

    def whole(self, text: str):
        return self.of(self.encode(text, add_special_tokens=False).ids)

    def __missing__(self, run: str):
        if self.pattern is None or "<|" in run or not (run.isascii() or max(run) <= "\xff"):
            value = self.whole(run)
        else:
            value = self.join(map(self.parts.__getitem__, self.pattern.findall(run.lower() if self.lower else run)))
        if len(run) <= LONGEST:
            if len(self) >= RUNS:
                self.clear()
            self[run] = value
        return value
