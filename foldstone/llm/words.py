"""Words of a text, ignoring case, accents, width, punctuation, markup, entities and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")
#: Characters that show nothing and separate nothing: the format category and those Unicode lets a renderer ignore.
_INVISIBLE = {c: None for plane in (range(0x20000), range(0xE0000, 0xE1000)) for c in plane if unicodedata.category(chr(c)) == "Cf"} | dict.fromkeys([0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
_HIDDEN = frozenset(map(chr, _INVISIBLE))


def _untagged(text: str) -> str:
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out.append(text[at:start])
        at = end + 3
    return _TAG.sub(" ", " ".join([*out, text[at:]]))


def visible(text: str) -> str:
    """The text without markup, entities and invisible characters; a tag separates, an invisible character does not."""
    if not text.isascii():
        text = text if _HIDDEN.isdisjoint(text) else text.translate(_INVISIBLE)
    if "<" in text:
        text = _untagged(text)
    if "&" in text:
        text = html.unescape(text)
        text = _untagged(text) if "<" in text else text
        text = text.translate(_INVISIBLE) if not text.isascii() else text
    return text


def folded(text: str) -> str:
    """Case, accents and width folded."""
    if text.isascii():
        return text.lower()
    plain = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    if plain.isascii():
        return plain.lower()
    plain = "".join([c for c in plain if c < "\u0370" or not (unicodedata.combining(c) or unicodedata.category(c) == "Mn")])
    return unicodedata.normalize("NFKC", plain.casefold())


def words(text: str | None) -> list[str]:
    """The words in order; none for NULL or an empty text."""
    return _WORD.findall(folded(visible(text))) if text else []
