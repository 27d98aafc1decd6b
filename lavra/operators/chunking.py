"""Splitting texts into chunks at natural boundaries, as folds over paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXTS = "array<string>"


def normalized(text: Column) -> Column:
    """Line ends as \\n, runs of blanks as one, at most one blank line, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines."""
    return _kept(F.split(text, r"\n\s*\n"))


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, question or exclamation mark."""
    return _kept(F.split(text, r"(?<=[.!?])\s+"))


def _state(current: Column, done: Column) -> Column:
    return F.struct(current.alias("atual"), done.alias("feitos"))


def packed(parts: Column, longest: int) -> Column:
    """Sentences in groups of at most ``longest`` characters; a longer sentence stays whole."""
    start = _state(F.lit(""), F.array().cast(_TEXTS))

    def step(s: Column, part: Column) -> Column:
        fits = F.length(s["atual"]) + F.length(part) + 1 <= longest
        return F.when(s["atual"] == "", _state(part, s["feitos"])).when(fits, _state(F.concat_ws(" ", s["atual"], part), s["feitos"])).otherwise(_state(part, F.concat(s["feitos"], F.array(s["atual"]))))

    return F.aggregate(parts, start, step, lambda s: F.when(s["atual"] == "", s["feitos"]).otherwise(F.concat(s["feitos"], F.array(s["atual"]))))


def tail(text: Column, size: int) -> Column:
    """The last ``size`` characters, without a broken word at the front where a space stands among the first twenty."""
    whole = F.regexp_replace(text, r"\s+$", "")
    cut = F.right(whole, F.lit(size))
    space = F.locate(" ", cut)
    short = F.when((space > 0) & (space <= 20), F.substring(cut, space + 1, F.length(cut))).otherwise(cut)
    return F.when(F.length(whole) <= size, whole).otherwise(F.regexp_replace(short, r"^\s+", ""))


def boundary_chunks(text: Column, least: int = 300, longest: int = 1200, overlap: int = 100) -> Column:
    """Chunks of whole paragraphs; an overflowing chunk of ``least`` characters is closed and hands its tail on, a shorter one runs over.

    A paragraph beyond ``longest`` is packed sentence by sentence, each group
    after the tail of the one before.
    """
    start = _state(F.lit(""), F.array().cast(_TEXTS))

    def step(s: Column, par: Column) -> Column:
        now, done = s["atual"], s["feitos"]
        flushed = F.when(now == "", done).otherwise(F.concat(done, F.array(now)))
        groups = packed(sentences(par), longest)
        giant = F.transform(groups, lambda g, i: F.when(i == 0, g).otherwise(F.concat(tail(F.get(groups, i - 1), overlap), F.lit(" "), g)))
        joined = F.concat(now, F.lit("\n\n"), par)
        return (
            F.when(F.length(par) > longest, _state(F.lit(""), F.concat(flushed, giant)))
            .when(now == "", _state(par, done))
            .when(F.length(joined) <= longest, _state(joined, done))
            .when(F.length(now) >= least, _state(F.concat(tail(now, overlap), F.lit("\n\n"), par), F.concat(done, F.array(now))))
            .otherwise(_state(joined, done))
        )

    return F.aggregate(paragraphs(normalized(text)), start, step, lambda s: F.when(s["atual"] == "", s["feitos"]).otherwise(F.concat(s["feitos"], F.array(s["atual"]))))


def chunk_rows(pages: DataFrame, id: str, text: str, least_chars: int = 100, least_words: int = 2) -> DataFrame:
    """(id, n, texto, tokens, chars) of every chunk dense enough; n counts the kept chunks of a page from 1.

    ``chars`` is measured before trimming, as the tables have it. Null and blank
    texts have no chunk.
    """
    made = pages.where(F.col(text).isNotNull()).select(F.col(id), F.posexplode(boundary_chunks(F.col(text))).alias("pos", "cru"))
    trimmed = F.regexp_replace("cru", r"^\s+|\s+$", "")
    words = F.size(F.filter(F.split(trimmed, r"\s+"), lambda w: w != ""))
    from pyspark.sql import Window

    rows = made.select(id, "pos", trimmed.alias("texto"), words.alias("tokens"), F.length("cru").alias("chars")).where((F.length("texto") >= least_chars) & (F.col("tokens") > least_words))
    return rows.select(id, F.row_number().over(Window.partitionBy(id).orderBy("pos")).alias("n"), "texto", "tokens", "chars")


def fixed_windows(text: Column, size: int = 1000) -> Column:
    """Windows of ``size`` characters over the whole text; the last may be shorter."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast(_TEXTS))


def slide_prefix(text: Column, size: int = 160) -> Column:
    """Leading lines joined by spaces until ``size`` characters are reached, cut there."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    joined = F.aggregate(lines, F.lit(""), lambda s, line: F.when(F.length(s) >= size, s).otherwise(F.trim(F.concat_ws(" ", s, line))))
    return F.substring(joined, 1, size)
