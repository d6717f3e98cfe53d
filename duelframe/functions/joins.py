"""Joins of facts with small or skewed sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A look-up table of at most so many counted rows goes to all tasks.
BROADCAST_ROWS = 300_000
#: Beyond, every key of the facts is split over so many tasks.
SALTS = 16


def look_up(facts: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", spread: str | list[str] | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Facts joined with a look-up table, whatever share of the facts one key holds.

    The look-up table is counted (give a written or cached one): up to `limit` rows it is broadcast; a larger one is copied once
    per salt and the facts are salted by a digest of the `spread` columns (all columns if none are given),
    so a hot key is split over SALTS tasks. Both ways give the same rows. Null keys meet nothing.
    """
    on = [on] if isinstance(on, str) else on
    if small.limit(limit + 1).count() <= limit:
        return facts.join(F.broadcast(small), on, how)
    columns = [spread] if isinstance(spread, str) else spread or facts.columns
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
