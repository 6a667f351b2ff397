"""Tokenisers and text scalars as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, in a form that Java and RE2 both read.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{Nd}\p{Nl}\p{No}]+"
NOT_ASCII_ALNUM = "[^A-Za-z0-9]+"
#: The label codes and their names.
LABELS = {4: "POSITIF", 2: "NEUTRE", 0: "NÉGATIF"}
UNKNOWN_LABEL = "INCONNU"
#: Words of n-grams have at least this many characters.
NGRAM_WORD = 4


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern, -1), lambda x: x != "")


def words_ws(text: Column) -> Column:
    """Words between white space, lower-cased, in order, repeats kept."""
    return _split(F.lower(text), WS)


def tokens_ws(text: Column) -> Column:
    """The set of words between white space, lower-cased; punctuation stays on them."""
    return F.array_distinct(words_ws(text))


def tokens_alnum(text: Column) -> Column:
    """Runs of Unicode letters and digits, lower-cased, repeats kept."""
    return F.transform(_split(text, NOT_ALNUM), F.lower)


def tokens_ascii(text: Column) -> Column:
    """The set of runs of ASCII letters and digits, lower-cased afterwards: accented letters cut words."""
    return F.array_distinct(F.transform(_split(text, NOT_ASCII_ALNUM), F.lower))


def tokens_space(text: Column) -> Column:
    """Pieces between single spaces, trimmed, case and empty ones kept."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), " ", -1), lambda x: F.trim(x))


def ngrams(text: Column, mode: str = "unibi") -> Column:
    """Words of four characters or more (``uni``), neighbours among those (``bi``), or both (``unibi``)."""
    uni = F.filter(words_ws(text), lambda x: F.char_length(x) >= NGRAM_WORD)
    if mode == "uni":
        return uni
    if mode not in ("bi", "unibi"):
        raise ValueError(f"mode {mode!r}: uni, bi or unibi")

    def both(u: Column) -> Column:
        n = F.greatest(F.size(u) - 1, F.lit(0))
        bi = F.zip_with(F.slice(u, 1, n), F.slice(u, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
        return bi if mode == "bi" else F.concat(u, bi)

    return F.transform(F.array(uni), both)[0]  # the words are bound to a name, so they are split once


def representation(tokens: Column, mode: str = "frequency") -> Column:
    """``presence``: different tokens; ``frequency``: all of them."""
    if mode not in ("presence", "frequency"):
        raise ValueError(f"mode {mode!r}: presence or frequency")
    return F.array_distinct(tokens) if mode == "presence" else tokens


def label_name(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(names[label], F.lit(UNKNOWN_LABEL))
