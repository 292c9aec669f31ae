"""Shared text handling for the operators of this sub-package."""

from __future__ import annotations

import re
import unicodedata

#: Zero-width characters, soft hyphen and byte-order mark.
INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
LIST_NUMBER = re.compile(r"(?m)^[^\S\n]*(?:[-*•–]+|\(?\d{1,3}[.)]+)(?=\s|$)")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def plain(text: str) -> str:
    """Compatibility form without invisible characters, one kind of apostrophe, case folded."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).replace("’", "'")
    return text.casefold()


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))


def line_words(line: str) -> list[str]:
    """Words of a line without the list number at its start."""
    return WORD.findall(LIST_NUMBER.sub(" ", plain(line), count=1))
