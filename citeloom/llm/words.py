"""Word streams shared by the text operators."""

from __future__ import annotations

import re

#: Code points that show nothing: soft hyphen, joiners, directional marks, word joiner, byte order mark.
INVISIBLE = dict.fromkeys([0x00AD, 0x034F, 0x061C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)])
_WORD = re.compile(r"[a-z0-9]+")
_BROKEN = re.compile(r"([a-z0-9]+)[-\u2010\u2011\u00ac][ \t]*\r?\n[ \t]*([a-z0-9]+)")


def plain_words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 after lower-casing; null has none."""
    return _WORD.findall(text.lower()) if text else []


def normal_words(text: str | None, known=frozenset()) -> list[str]:
    """``plain_words`` without invisible characters and with words broken at line ends rejoined.

    A hyphen at a line end belongs to a compound, and splits it, only if ``known``
    holds both parts and not the joined word.
    """
    if not text:
        return []
    if not text.isascii():
        text = text.translate(INVISIBLE)
    text = text.lower()
    if "\n" in text:
        text = _BROKEN.sub(lambda m: f"{m[1]} {m[2]}" if m[1] + m[2] not in known and m[1] in known and m[2] in known else m[1] + m[2], text)
    return _WORD.findall(text)
