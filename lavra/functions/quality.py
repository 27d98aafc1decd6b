"""Predicates on lines and pages of extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that count as text beside ASCII ones; upper-case accented letters do not.
TEXT_CHARACTERS = "A-Za-z0-9áéíóúâêôãõç "
# What marks an e-mail address, a web address and the header of a slide.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = r"\b(?:https?://|www\.)"
HEADER = r"\bprof\.|professor|p[áa]gin|slide"
# What may follow the first digit of a line of figures.
FIGURES = r"\d\s.,:/%–—-"


def has_email(line: Column) -> Column:
    return line.rlike(EMAIL)


def has_url(line: Column) -> Column:
    return line.rlike(f"(?i){URL}")


def is_numeric(line: Column) -> Column:
    """A digit, and after it nothing but digits, white space and the marks of page, time, share and range."""
    return line.rlike(rf"^\d[{FIGURES}]*\z")


def is_short_header(line: Column) -> Column:
    """Up to 60 characters that name a teacher, page or slide."""
    return (F.length(line) <= 60) & line.rlike(f"(?iu){HEADER}")


def text_ratio(line: Column) -> Column:
    """Share of textual characters; 1 for an empty line."""
    return F.when(F.length(line) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(line, f"[^{TEXT_CHARACTERS}]", "")) / F.length(line))


def has_control(line: Column) -> Column:
    return line.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")


def words(line: Column) -> Column:
    """Words between white space; none for a blank line."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def badly_spaced(line: Column) -> Column:
    """More than 20 characters a word on average, fewer than 3 in a line of five words or more, or no word."""
    parts = words(line)
    size = F.aggregate(parts, F.lit(0), lambda n, w: n + F.length(w))
    return F.when(F.size(parts) == 0, True).otherwise((size > F.size(parts) * 20) | ((F.size(parts) >= 5) & (size < F.size(parts) * 3)))


def reject_reason(line: Column) -> Column:
    """Why the page cleaner drops a trimmed line; null if it keeps it."""
    return (
        F.when(F.length(line) < 3, "curta")
        .when(has_email(line), "email")
        .when(has_url(line), "url")
        .when(is_numeric(line), "numerica")
        .when(is_short_header(line), "cabecalho")
        .when(has_control(line), "controle")
        .when(text_ratio(line) < 0.70, "simbolos")
        .when(badly_spaced(line), "espacamento")
    )


def page_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\r\n|\r|\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))


def clean_page(text: Column) -> Column:
    """The kept lines of a page, one below the other."""
    return F.array_join(F.filter(page_lines(text), lambda line: reject_reason(line).isNull()), "\n")


def letter_spaced(text: Column) -> Column:
    """More than a quarter of the words are single characters."""
    parts = words(text)
    return (F.size(parts) > 0) & (F.size(F.filter(parts, lambda w: F.length(w) <= 1)) * 4 > F.size(parts))


def title(text: Column) -> Column:
    """The first of the first five non-blank lines that is in capitals and longer than three characters."""
    head = F.slice(F.filter(page_lines(text), lambda line: line != ""), 1, 5)
    return F.try_element_at(F.filter(head, lambda line: (F.length(line) > 3) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")), F.lit(1))
