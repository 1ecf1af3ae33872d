"""Analyzers: the same terms from a column, inside Spark, and from a query's text, on the driver.

A token is (term, increment, start, end). Positions begin at -1 and add each increment: 1 is the next
position, 0 an alternative at the same one, more a gap. Offsets are half-open and count UTF-16 units.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

WORD = r"[\p{L}\p{Nd}]+"
#: Texts of these code points alone, Latin, Cyrillic, kana and Han that neither decompose nor join with a neighbour, are in NFKC.
STABLE = r"\A[\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u0482\u048A-\u052F\u2010\u2012-\u2016\u2018-\u2023\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FFF]*+\z"
_WORD = regex.compile(WORD)
#: Of the array column that analysis makes.
TOKENS = "array<struct<term:string,pos:int>>"


@dataclass(frozen=True)
class Token:
    term: str
    increment: int = 1
    start: int = -1
    end: int = -1


class Analyzer:
    """Subclasses give ``tokens`` (driver) and may give ``column`` (Spark); without one an Arrow UDF calls ``tokens``."""

    #: Whether tokens have offsets.
    offsets = False
    #: Whether terms are the runs of letters and digits of ``clean(text)``, so that patterns count and find them.
    by_pattern = False

    def tokens(self, text: str | None) -> list[Token]:
        raise NotImplementedError

    def column(self, text: Column) -> Column:
        """Array of (term, pos)."""
        analyzer = self

        @F.pandas_udf(TOKENS)
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"term": term, "pos": pos} for term, pos in positions(analyzer.tokens(t))])

        return run(text)

    def terms(self, text: str | None) -> list[str]:
        """Distinct terms, by first encounter."""
        return list(dict.fromkeys(t.term for t in self.checked(text)))

    def checked(self, text: str | None, name: str = "query") -> list[Token]:
        out = self.tokens(text)
        check_tokens(out, name)
        return out


def check_tokens(tokens: Sequence[Token], name: str) -> None:
    """Raise unless increments begin with at least 1, are not negative and terms are not empty."""
    at = -1
    for i, t in enumerate(tokens):
        if not isinstance(t, Token) or not t.term:
            raise InvalidArgument(f"field {name!r}, token {i}: no term")
        if t.increment < (1 if i == 0 else 0):
            raise InvalidArgument(f"field {name!r}, token {i}: increment {t.increment}")
        at += t.increment
        if at > 2**31 - 1:
            raise InvalidArgument(f"field {name!r}, token {i}: position too large")


def positions(tokens: Sequence[Token]) -> list[tuple[str, int]]:
    out, at = [], -1
    for t in tokens:
        at += t.increment
        out.append((t.term, at))
    return out


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC of a column; ASCII texts are in it already."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def utf16(text: str) -> list[int]:
    """The UTF-16 offset of each code point, and of the end."""
    out, at = [], 0
    for c in text:
        out.append(at)
        at += 2 if ord(c) > 0xFFFF else 1
    return [*out, at]


class SimpleAnalyzer(Analyzer):
    """NFKC, lower case, then maximal runs of letters and decimal digits. No stems, stop words or synonyms.

    ``normalized`` says that the corpus is in NFKC already (as any ASCII or ingest-normalised corpus is):
    the column is then built-in functions only, with no Arrow round trip. Query texts are always normalised.
    """

    offsets = True
    by_pattern = True

    def __init__(self, normalized: bool = False):
        self.normalized = normalized

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SimpleAnalyzer) and self.normalized == other.normalized

    def __hash__(self) -> int:
        return hash((SimpleAnalyzer, self.normalized))

    def clean(self, text: Column) -> Column:
        """NFKC, lower case. Only texts that may not be in NFKC leave the JVM."""
        if not self.normalized:
            sure = F.coalesce(text.rlike(STABLE), F.lit(True))
            text = F.when(sure, text).otherwise(nfkc(F.when(~sure, text)))
        return F.lower(text)

    def terms_column(self, text: Column) -> Column:
        """Array of terms; positions are their places."""
        return words(self.clean(text))

    def column(self, text: Column) -> Column:
        return F.transform(self.terms_column(text), lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("pos")))

    def tokens(self, text: str | None) -> list[Token]:
        if not text:
            return []
        clean, origin = _normalized(text)
        at = utf16(text)
        return [Token(m[0], 1, at[origin[m.start()][0]], at[origin[m.end() - 1][1]]) for m in _WORD.finditer(clean)]


def _normalized(text: str) -> tuple[str, list[tuple[int, int]]]:
    """NFKC and lower case, and for each code point of the result the range of ``text`` it comes from.

    A cluster is a starter and what normalises together with it: it ends where normalising what is before and what
    is behind apart gives the same as together."""
    whole = unicodedata.normalize("NFKC", text).lower()
    if text.isascii():
        return whole, [(i, i + 1) for i in range(len(text))]
    out, origin, a = [], [], 0
    while a < len(text):
        b = a + 1
        while b < len(text) and (unicodedata.combining(text[b]) or unicodedata.normalize("NFKC", text[a : b + 1]) != unicodedata.normalize("NFKC", text[a:b]) + unicodedata.normalize("NFKC", text[b])):
            b += 1
        part = unicodedata.normalize("NFKC", text[a:b]).lower()
        out.append(part)
        origin += [(a, b)] * len(part)
        a = b
    joined = "".join(out)
    if len(joined) == len(whole):  # the same but for letters whose lower case depends on their neighbours
        return whole, origin
    return joined, origin


def words(clean: Column) -> Column:
    """The runs of letters and digits of a clean text."""
    return F.coalesce(F.regexp_extract_all(clean, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_count(clean: Column) -> Column:
    """Their number."""
    return F.coalesce(F.regexp_count(clean, F.lit(WORD)), F.lit(0))


def whole(term: str) -> str:
    """A pattern for a term that stands alone. The term comes first, which is what a matcher finds fast."""
    return rf"\Q{term}\E(?![\p{{L}}\p{{Nd}}])(?<![\p{{L}}\p{{Nd}}]\Q{term}\E)"


def frequency(clean: Column, term: str) -> Column:
    """How often a term is in a clean text."""
    return F.when(clean.contains(term), F.regexp_count(clean, F.lit(whole(term)))).otherwise(0)


def contains(clean: Column, term: str) -> Column:
    return F.coalesce(clean.contains(term) & clean.rlike(whole(term)), F.lit(False))


class FunctionAnalyzer(Analyzer):
    """An analyzer from a function of a text to tokens (or to terms)."""

    def __init__(self, run: Callable[[str], Sequence[Token | str]], offsets: bool = False):
        self.run, self.offsets = run, offsets

    def tokens(self, text: str | None) -> list[Token]:
        return [] if not text else [t if isinstance(t, Token) else Token(t) for t in self.run(text)]
