"""Column helpers for keys and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank at the ends of a key or a name.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufeff"
)


def trimmed(col: Column | str) -> Column:
    """Without surrounding blanks of any kind."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def key(col: Column | str) -> Column:
    """Comparison form of a key: lower case, trimmed, null where blank."""
    return F.nullif(F.lower(trimmed(col)), F.lit(""))


# White space that is stripped from texts.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bare(text: Column) -> Column:
    """Without white space of any kind at the ends; zero-width characters stay."""
    return F.btrim(text, F.lit(WHITE))
