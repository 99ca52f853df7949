"""String expressions with fixed semantics: path suffix, Unicode strip, terms, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
#: What str.strip() of Python removes.
_WHITE = r"(?U:[\s\x1c-\x1f])+"


def suffix(name: Column) -> Column:
    """Last suffix of the final path component in lower case, as pathlib has it: none for dotfiles and trailing dots."""
    base = F.regexp_extract(F.regexp_replace(name, r"(/\.?)+$", ""), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]+)$", 1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_WHITE}|{_WHITE}$", "")


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Texts between full stops and line ends, stripped of spaces, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.\n]"), lambda s: F.trim(s)), lambda s: s != "")


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct items that b has; 0 for an empty a."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def chunk_starts(text: Column, length: int = 1000, stride: int = 800) -> Column:
    """Numbers of the chunks that cover a text."""
    n = F.char_length(text)
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - length) / F.lit(stride).cast("double")).cast("int")))
