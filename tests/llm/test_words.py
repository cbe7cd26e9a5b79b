import sys
import unicodedata

from foldstone.llm import words


def test_every_invisible_character_separates_nothing():
    assert [hex(c) for c in words._INVISIBLE if words.words(f"wo{chr(c)}rd") != ["word"]] == []


def test_the_format_category_has_no_character_elsewhere():
    assert {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"} <= set(words._INVISIBLE)
