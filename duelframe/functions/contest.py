"""Column builders of the contest statistics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Z95 = 1.959964
# Lower edges and names of the rating bands; below the first edge and without rating.
BAND_EDGES = ((1500, "1500_plus"), (1400, "1400_1499"), (1200, "1200_1399"))
LOWEST_BAND, NO_BAND, ALL_BANDS = "below_1200", "unknown", "all"
#: Format ids in scope start with one of these.
SCOPE_PREFIXES = ("gen9vgc", "gen9championsvgc")


def in_scope_format(format_id: Column) -> Column:
    hit = F.lit(False)
    for prefix in SCOPE_PREFIXES:
        hit = hit | format_id.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def segment(format_id: Column) -> Column:
    """Format id without the best-of-three suffix in either spelling."""
    return F.replace(F.replace(format_id, F.lit("(bo3)"), F.lit("")), F.lit("bo3"), F.lit(""))


def rating_band(rating: Column) -> Column:
    """Band of a side's own rating; null and NaN are 'unknown'."""
    out = F.when(rating.isNull() | F.isnan(rating.cast("double")), NO_BAND)
    for edge, name in BAND_EDGES:
        out = out.when(rating >= edge, name)
    return out.otherwise(LOWEST_BAND)


def month_of(epoch: Column) -> Column:
    """UTC month YYYY-MM of epoch seconds, 'unknown' for null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM"), F.lit("unknown"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Double quotient, null where the divisor is 0 or null."""
    return F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"), F.col(b).cast("double") if isinstance(b, str) else b.cast("double"))


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of wins out of n; null for n = 0, the share is cut at 1."""
    p = F.least(ratio(wins, n), F.lit(1.0))
    m = F.when(n > 0, n.cast("double"))
    z2 = Z95 * Z95
    centre, spread = p + z2 / (2 * m), Z95 * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    return (centre - spread) / (1 + z2 / m), (centre + spread) / (1 + z2 / m)


def log5(a: Column, b: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Expected rate of a against b from their overall rates, each cut to [low, high]."""
    x, y = (F.least(F.greatest(c, F.lit(low)), F.lit(high)) for c in (a, b))
    return x * (1 - y) / (x * (1 - y) + y * (1 - x))


def parse_segment(name: Column) -> dict[str, Column]:
    """game, season_year, reg_letter and label of a segment id; others get game 'Other' and their id as label."""
    pattern = r"^gen9(champions)?vgc(\d{4})reg([a-z](?:-[a-z])?)$"
    fits = name.rlike(pattern)
    letter = F.upper(F.regexp_extract(name, pattern, 3))
    champions = F.regexp_extract(name, pattern, 1) == "champions"
    year = F.regexp_extract(name, pattern, 2)
    return {
        "game": F.when(~fits, "Other").when(champions, "Champions").otherwise("Scarlet/Violet"),
        "season_year": F.when(fits, year.try_cast("int")),
        "reg_letter": F.when(fits, letter).otherwise(""),
        "label": F.when(fits, F.concat(F.when(champions, "Champions ").otherwise(""), F.lit("Reg "), letter, F.lit(" "), year)).otherwise(name),
    }


def _ascii(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() if s is not None else None)


def slug(name: Column) -> Column:
    """Name as slug: compatibility-decomposed ASCII, lower case, without .':%, blanks and _ as single '-'.

    Decomposition has no built-in, so it is an Arrow-batched function: use it on distinct names.
    """
    plain = F.pandas_udf(_ascii, StringType())(name)
    text = F.regexp_replace(F.regexp_replace(F.lower(plain), r"^\s+|\s+$", ""), "[.'’:%]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\s_]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def ability_slug(name: Column) -> Column:
    """Ability in lower case without blanks at the ends, blanks and _ as '-'; '' for null."""
    return F.translate(F.lower(F.btrim(F.coalesce(name, F.lit("")))), " _", "--")


def id_string(name: Column) -> Column:
    """Only the letters a-z and digits of a name in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def id_of_url(url: Column) -> Column:
    """The number after the last '/' of a url, whatever slashes end it; null where there is none."""
    return F.regexp_extract(url, r"(?:^|/)(\d+)/*$", 1).try_cast("int")


def english_text(entries: Column, language: str = "en") -> Column:
    """The text of the first entry of a language, '' where that entry has none, null without such an entry.

    entries: an array of (language, short_effect).
    """
    first = F.get(F.filter(entries, lambda e: e["language"] == language), F.lit(0))
    return F.when(first.isNotNull(), F.coalesce(first["short_effect"], F.lit("")))
