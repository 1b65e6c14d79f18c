"""String helpers as column expressions. ``(?U)`` makes Java's classes Unicode's, as the rules need them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode and the four separators that count as white space as well.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
ARABIC, LATIN = r"[؀-ۿ]", "[A-Za-z]"


def present(c: Column) -> Column:
    """Null where empty: an empty string counts as absent."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count_matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(or_empty(c), LINE_END), strip), lambda line: line != "")


def words(c: Column) -> Column:
    return F.filter(F.split(or_empty(c), rf"(?U){SPACE}+"), lambda word: word != "")


def word_count(ar: Column, en: Column) -> Column:
    """Words of both languages together."""
    return F.size(words(F.concat(or_empty(ar), F.lit(" "), or_empty(en))))


def sentences(c: Column) -> Column:
    """Cut after . ! ? ؟ and white space; the terminator and the white space are lost."""
    return F.filter(F.transform(F.split(or_empty(c), rf"(?U)[.!?؟]{SPACE}+"), strip), lambda s: s != "")


def slug(c: Column) -> Column:
    """Lower case with runs of anything but a-z and 0-9 as one underline, none at the ends; absent is ``unknown``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(present(c), F.lit("unknown"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chunk_id(chapter: Column, section: Column, page: Column, tail: Column, prefix: str = "yearbook2025") -> Column:
    return F.concat(F.lit(f"{prefix}_"), slug(chapter), F.lit("_"), slug(section), F.lit("_p"), page.cast("string"), F.lit("_"), tail)


def table_id(chapter: Column, page: Column) -> Column:
    return F.concat(F.lit("table_"), F.coalesce(present(chapter), F.lit("unknown")), F.lit("_"), page.cast("string"))


def join_texts(a: Column, b: Column, sep: str = "\n\n") -> Column:
    """Both, stripped, parted by a blank line; or the one that is present as it is."""
    both = F.concat(strip(a), F.lit(sep), strip(b))
    return F.when(present(a).isNull(), b).when(present(b).isNull(), a).otherwise(both)


def isolated_letters(c: Column) -> Column:
    """Arabic letters between white space, counted without overlap."""
    return count_matches(c, rf"(?U){SPACE}{ARABIC}{SPACE}")


def table_lines(rows: Column) -> Column:
    """A matrix of cells as lines of cells parted by tabs; null cells are empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, or_empty), "\t")), "\n")


def table_markdown(rows: Column) -> Column:
    """A matrix of cells as a Markdown table, its first row the head; short rows are filled up. Empty gives ''."""
    width = F.array_max(F.transform(rows, F.size))
    full = F.transform(rows, lambda r: F.concat(F.transform(r, or_empty), F.array_repeat(F.lit(""), width - F.size(r))))
    shown = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    out = F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, F.lit(2), F.greatest(F.size(shown), F.lit(1))))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(out, "\n")).otherwise("")


def percent_off(original: Column, other: Column) -> Column:
    return F.when(original > 0, F.abs(original - other) / original * 100).otherwise(F.lit(0.0))


def file_name(c: Column) -> Column:
    """Letters, digits, space, - and _ of a document's name, stripped, with spaces as underlines."""
    return F.replace(strip(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "")), F.lit(" "), F.lit("_"))


def replaced(c: Column, pairs) -> Column:
    """Literal substitutions in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def rewritten(c: Column, rules) -> Column:
    """Regular expression substitutions in order."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), rules, c)


def joined(rows: Column, sep: str) -> Column:
    """``collect_list`` of (order, text) structs as one text in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), sep)
