"""Cleaning and quality scores of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, ends_with_terminator, starts_mid_sentence, stripped, whitespace_words

BROKEN = r"[\x{FFFD}\x{FFFE}\x{FFFF}]|\\x[A-Fa-f0-9]{2}"
BOILERPLATE = r"(?i)^(?:page\s+\d+|\d+\s*/\s*\d+|copyright|©|\(c\)|all rights reserved|confidential|table of contents|목차|[-=_*]{3,})"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), stripped), lambda x: x != "")


def document_quality(text: Column) -> Column:
    """0 to 1 from length (.3), broken characters (.3), density (.2) and repeated lines (.2)."""
    size, n = F.length(stripped(text)), F.greatest(F.length(text), F.lit(1))
    length = F.when(size < 10, 0.3).when(size < 100, 0.7).otherwise(1.0)
    broken = count_of(text, BROKEN) / n
    encoding = F.when(broken == 0, 1.0).when(broken > 0.1, 0.1).when(broken > 0.05, 0.3).when(broken > 0.01, 0.6).otherwise(0.8)
    ink = F.length(F.translate(text, " \n\t", "")) / n
    density = F.when(ink < 0.1, 0.2).when(ink < 0.3, 0.5).when(ink > 0.95, 0.7).otherwise(1.0)
    lines = _lines(text)
    unique = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    repeat = F.when(F.length(text) < 100, 1.0).when(F.size(lines) == 0, 0.5).when(unique < 0.3, 0.2).when(unique < 0.5, 0.5).otherwise(1.0)
    return F.when(size == 0, 0.0).otherwise(F.round(0.3 * length + 0.3 * encoding + 0.2 * density + 0.2 * repeat, 3))


def chunk_quality(text: Column) -> Column:
    """.1 under 15 words, .2 for boilerplate, .4 for short ends of sentences, else 1; chunks of at least .3 are kept."""
    words, lines = F.size(whitespace_words(text)), _lines(text)
    plate = F.size(F.filter(lines, lambda x: x.rlike(BOILERPLATE))) / F.greatest(F.size(lines), F.lit(1))
    return F.when(words < 15, 0.1).when(plate > 0.7, 0.2).when((words < 30) & ~ends_with_terminator(text), 0.4).otherwise(1.0)


def completeness(text: Column) -> Column:
    """How well a chunk stands alone, .1 to 1; 0 without words."""
    words = F.size(whitespace_words(text))
    score = 1.0 - F.when(starts_mid_sentence(text), 0.3).otherwise(0.0) - F.when(ends_with_terminator(text), 0.0).otherwise(0.15)
    score = score - F.when(words < 20, 0.2).when(words < 50, 0.1).otherwise(0.0)
    return F.when(words == 0, 0.0).otherwise(F.greatest(F.lit(0.1), F.round(score, 2)))


def denoised(text: Column) -> Column:
    """Without image blocks, lone page numbers (kept beside table lines), footnote marks, control characters, decoration."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)|\[(?:image|이미지|그림)[^\]]*\]", "")
    lines = F.split(text, "\n")
    piped = lambda i: F.coalesce(F.get(lines, i).contains("|"), F.lit(False))
    number = F.lit(r"^\s*\d{1,4}\s*$")
    kept = F.filter(lines, lambda x, i: ~F.rlike(x, number) | piped(i - 1) | piped(i + 1))
    text = F.array_join(kept, "\n")
    text = F.regexp_replace(text, r"\[\^?\d{1,3}\]", "")
    text = F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*[-=_*~#.]{3,}[ \t]*$", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")
