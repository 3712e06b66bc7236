"""Column functions shared by the operators: base forms, syllables, variants."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles of the Korean profile and endings of the Latin profile, longest first.
KO_PARTICLES = ("에서는", "으로는", "에게서", "에서", "에게", "으로", "까지", "부터", "처럼", "은", "는", "이", "가", "을", "를", "의", "에", "도", "만", "로", "와", "과")
LATIN_ENDINGS = ("ing", "ion", "ed", "es", "ly", "er", "s")
NOTABLE_REGISTERS = ("dialect", "archaic", "north", "obsolete")

INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}\x{FEFF}]"
LETTERS = r"\p{L}+"


def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode normal form C, in Arrow batches; Spark has no built-in for it."""
    return F.pandas_udf(_nfc, "string")(text)


def normalise_text(text: Column) -> Column:
    """NFC and no invisible characters. The Python step runs only on texts with combining or compatibility marks."""
    composed = F.when(text.rlike(r"[\p{M}\x{1100}-\x{11FF}]"), nfc(text)).otherwise(text)
    return F.regexp_replace(composed, INVISIBLE, "")


def base_form(word: Column, endings: tuple[str, ...] = LATIN_ENDINGS, least: int = 2) -> Column:
    """``word`` without one trailing ending, if at least ``least`` characters are left."""
    return F.regexp_replace(word, f"^(.{{{least},}}?)({'|'.join(endings)})\\z", "$1")


#: Line ends as Spark's patterns have them, which a dot leaves out.
_BASE = re.compile(f"([^\n\r\x85\u2028\u2029]{{2,}}?)(?:{'|'.join(LATIN_ENDINGS)})")


def base_of(word: str) -> str:
    """``base_form`` of one word, with its defaults."""
    found = _BASE.fullmatch(word)
    return found[1] if found else word


def literal(text: Column) -> Column:
    """A pattern that matches ``text`` as it stands, whatever it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def has_final_consonant(char: Column) -> Column:
    """Whether a Hangul syllable ends in a consonant: syllables of one vowel are 28 code points apart."""
    return (F.ascii(char) - 44032) % 28 != 0


def letters_of(text: Column) -> Column:
    """``text`` with each Hangul syllable as its two or three letters; other characters stay.

    Syllables stand in order of first letter, vowel and last letter: 21 vowels, 28 endings of which the first is none.
    """
    first, vowel, last = (F.array(*[F.lit(chr(base + i)) for i in range(n)]) for base, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))

    def letters(char: Column) -> Column:
        at = F.ascii(char) - 44032
        end = at % 28
        spelt = F.concat(F.get(first, F.floor(at / 588).cast("int")), F.get(vowel, F.floor(at % 588 / 28).cast("int")), F.when(end > 0, F.get(last, end)).otherwise(""))
        return F.when(at.between(0, 11171), spelt).otherwise(char)

    return F.when(text.rlike("[가-힣]"), F.array_join(F.transform(F.split(text, ""), letters), "")).otherwise(text)


def letter_distance(a: Column, b: Column) -> Column:
    """Edits between two texts, counted in letters: a changed ending of a syllable is one."""
    return F.levenshtein(letters_of(a), letters_of(b))


def distance_of(a: str, b: str) -> int:
    """``letter_distance`` of two texts."""

    def spelt(text: str) -> str:
        if text.isascii():
            return text
        at = [ord(c) - 44032 for c in text]
        return "".join(chr(0x1100 + k // 588) + chr(0x1161 + k % 588 // 28) + (chr(0x11A7 + k % 28) if k % 28 else "") if 0 <= k <= 11171 else c for k, c in zip(at, text, strict=True))

    a, b = spelt(a), spelt(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, above + (x != y))
    return row[-1]
