"""Splitting text into words with built-in expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pieces into which a word breaker cuts a text, and the test that a piece is a word.
# Letters joined by a dash, connector, quote or dot form one piece, and so do letters next to
# digits; a piece that is not all letters is dropped whole ("don't", "state-of-the-art", "abc1").
# Marks and format characters belong to the character before them. Ideographs, hiragana and katakana
# form pieces of their own. A word has at least three UTF-16 units, so that two letters suffice
# where one lies beyond the basic plane.
KANJI = r"\x{3005}\x{4E00}-\x{9FA5}\x{F900}-\x{FA2D}"
HIRAGANA = r"\x{3041}-\x{3094}\x{309D}\x{309E}"
KATAKANA = r"\x{30A1}-\x{30FA}\x{30FD}\x{30FE}"
KANA_MARKS = r"\x{3099}-\x{309C}\x{30FB}\x{30FC}"
JOINER = r"""[\p{Pd}\p{Pc}\x{AD}\x{2027}"'.]"""
NUMBER_JOINER = r"""["',.\x{66B}]"""
DANDA = r"[\x{964}\x{965}]"
WORD = r"^(?:\p{L}{3,}|\p{L}[\x{10000}-\x{10FFFF}]|[\x{10000}-\x{10FFFF}]\p{L})$"

# The pattern in the dialect of Spark's expressions: no step ever has to be taken back, and plain
# Latin letters are tested first.
_CJK = KANJI + HIRAGANA + KATAKANA + KANA_MARKS
_LETTERS = rf"[a-zA-Z[\p{{L}}\p{{Mc}}&&[^{_CJK}]]][a-zA-Z[\p{{L}}\p{{M}}\p{{Cf}}&&[^\x{{AD}}{_CJK}]]]*+"
_DIGITS = r"\p{N}[\p{N}[\p{Mn}\p{Me}\p{Cf}&&[^\x{AD}]]]*+"
_MARKS = r"[\p{Mn}\p{Me}\p{Cf}&&[^\x{AD}]]*+"
_KANA = rf"[{HIRAGANA}][{HIRAGANA}{KANA_MARKS}]*+|[{KATAKANA}][{KATAKANA}{KANA_MARKS}]*+"
_FORMAT = r"[\p{Cf}&&[^\x{AD}]]"
PIECE = (rf"(?:\A{_FORMAT}++)?+"
         rf"(?:{_LETTERS}(?:{JOINER}{_FORMAT}*+{_LETTERS})*+"
         rf"|{_DIGITS}(?:{NUMBER_JOINER}{_FORMAT}*+{_DIGITS})*+)++{DANDA}?+"
         rf"|[{KANJI}]++{_MARKS}"
         rf"|(?:{_KANA}|[{KANA_MARKS}]++(?:{_KANA})?+){_MARKS}")

# Nearly all pieces are plain letters before a blank or a sign after which no piece goes on; PIECE would cut them alike. Listed
# one by one, Latin letters are tested in one step. Blanks and signs after a piece begin none, and are passed over with it.
PLAIN = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
PIECE_FIRST = rf"([{PLAIN}]+(?=[ \n\r\t,;:!?()]|[.][ \n]|\z)|{PIECE})[ \n\r\t,;:!?().]*+"


def pieces(text: Column) -> Column:
    """All word-breaker pieces of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE_FIRST), F.lit(1))


def is_word(term: Column, stopwords: Collection[str] = ()) -> Column:
    """Only letters, at least three of them, and not a stopword."""
    keep = term.rlike(WORD)
    # a word list beyond a few thousand entries belongs in a table; see operators.terms
    return keep & ~term.isin(sorted(stopwords)) if stopwords else keep


def words(text: Column, stopwords: Collection[str] = ()) -> Column:
    """The array of lower-cased words of a text."""
    return F.filter(F.transform(pieces(text), F.lower), lambda t: is_word(t, stopwords))
