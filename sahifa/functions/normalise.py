"""Normalisation of Arabic and English text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sahifa.functions import rules
from sahifa.functions.language import block_language
from sahifa.functions.text import LINE_END, SPACE, or_empty, present, replaced, rewritten, strip

TATWEEL = "ـ"
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"
TIGHT = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


def arabic_scanned(c: Column) -> Column:
    """Tatweel goes, hamza carriers become alef, final ya and ta marbuta their plain forms; spaces are single."""
    return strip(rewritten(F.translate(c, f"أإآىة{TATWEEL}", "ااايه"), TIGHT))


def english_scanned_basic(c: Column) -> Column:
    return strip(rewritten(c, TIGHT))


def arabic_letters(c: Column) -> Column:
    """As ``arabic_scanned``, with alef wasla too, without diacritics, and ta marbuta kept."""
    return F.regexp_replace(F.translate(c, f"أإآٱى{TATWEEL}", "ااااي"), DIACRITICS, "")


def arabic_punctuation(c: Column, language: Column) -> Column:
    return F.when(language == "en", c).otherwise(F.translate(c, "?,;", "؟،؛"))


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, LINE_END), strip), "\n")


def spacing(c: Column, decimal_safe: bool = False) -> Column:
    """Single spaces, two line ends at most, none before punctuation and one after it.

    A space also comes between a point and a digit, so 309.5 becomes 309. 5, unless ``decimal_safe``.
    """
    marks = "[،؟؛.,!]"
    number = r"(?!(?<=\d[.,])\d)" if decimal_safe else ""
    steps = [(r"[ \t\r\f\x0b]+", " "), (r"\n{3,}", "\n\n"), (rf"(?U){SPACE}+({marks})", "$1"), (rf"(?U)({marks}){number}([^\s\x1c-\x1f])", "$1 $2")]
    return strip(strip_lines(rewritten(c, steps)))


def ligatures(c: Column) -> Column:
    return replaced(rewritten(c, rules.LIGATURE_PREFIXES), rules.LIGATURE_WORDS)


def arabic_repairs(c: Column) -> Column:
    """All rules for a broken text layer, in order."""
    fixed = replaced(ligatures(c), rules.TEXT_LITERALS)
    return rewritten(fixed, [("(?U)" + p, r) for p, r in rules.TEXT_CHARACTERS + rules.TEXT_WORDS + rules.TEXT_TAIL])


def block_text(c: Column, block_type: Column) -> Column:
    """Arabic side of a block of the text layer: tables stay, headers are tightened, the rest goes by its language."""
    language = block_language(c)
    arabic = spacing(arabic_punctuation(arabic_letters(arabic_repairs(c)), language))
    whole = F.when(language == "en", spacing(c)).otherwise(arabic)
    header = strip(strip_lines(F.regexp_replace(c, r"[ \t]+", " ")))
    return F.when(present(c).isNull(), "").when(block_type == "table", c).when(block_type == "header", header).otherwise(whole)


def english_text(c: Column, block_type: Column) -> Column:
    return F.when(present(c).isNull() | (block_type == "table"), c).otherwise(spacing(c))


def scanned_repairs(c: Column) -> Column:
    return replaced(c, rules.OCR_LITERALS)


def arabic_ocr(c: Column) -> Column:
    return F.when(strip(or_empty(c)) == "", "").otherwise(arabic_scanned(scanned_repairs(c)))


def english_ocr(c: Column) -> Column:
    """No space before punctuation, one between punctuation and a letter; digits are left alone."""
    fixed = rewritten(english_scanned_basic(c), [(rf"(?U){SPACE}+([,.;:!?])", "$1"), (r"([,.;:!?])([A-Za-z])", "$1 $2")])
    return F.when(strip(or_empty(c)) == "", "").otherwise(fixed)
