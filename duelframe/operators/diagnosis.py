"""Diagnosis of masked names and completeness of raw logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.contest import id_string
from duelframe.functions.text import bare

# Line patterns of the log, and the names of which a complete log must be free.
MASKED = r"\|poke\|(p[12])\|([^,|]+?)-\*"
SHOWN = r"(?m)^\|showteam\|(p[12])\|(.*)$"
SEEN = r"\|(?:switch|drag|detailschange|-formechange)\|(p[12])[ab]: [^|]*\|([^,|]+)"
SWITCHED = r"(?m)^\|(?:switch|drag|detailschange|replace)\|[^|]*\|([^|\n]+)"
LISTED = r"(?m)^\|poke\|p[12]\|([^|\n]+)"
DISGUISED = ("Zoroark", "Zorua")
MEMBERS = 6


def packed_species(body: Column) -> Column:
    """The species of a packed team: members between ']', fields between '|', a blank species is the nickname."""
    species = lambda f: bare(F.coalesce(F.nullif(F.get(f, F.lit(1)), F.lit("")), F.get(f, F.lit(0))))
    return F.transform(F.split(body, "]", -1), lambda m: species(F.split(m, "\\|", -1)))


def _pairs(pattern: str) -> Column:
    """(side, text) of every match of a pattern with two groups in the log."""
    found = [F.regexp_extract_all("log", F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*found, lambda a, b: F.struct(a.alias("side"), b.alias("text")))


def masked_slots(logs: DataFrame) -> DataFrame:
    """(battle_id, side, base, by_team, by_events): every masked roster line with the forms that the shown team and the events of its side have for it.

    Of several shown teams of a side the last counts. Logs without masked lines give no rows.
    """
    rows = logs.select("battle_id", F.explode(_pairs(MASKED)).alias("m"), _pairs(SHOWN).alias("teams"), _pairs(SEEN).alias("events"))
    base = F.col("m.text")
    fits = lambda s: (s == base) | F.startswith(s, F.concat(base, F.lit("-")))
    own = lambda c: F.filter(c, lambda x: x["side"] == F.col("m.side"))
    team = packed_species(F.try_element_at(own(F.col("teams")), F.lit(-1))["text"])
    return rows.select(
        "battle_id", F.col("m.side").alias("side"), base.alias("base"), F.coalesce(F.filter(team, fits), F.array().cast("array<string>")).alias("by_team"),
        F.array_sort(F.array_distinct(F.filter(F.transform(own(F.col("events")), lambda x: x["text"]), fits))).alias("by_events"),
    )


def resolvability(slots: DataFrame) -> DataFrame:
    """(base, slots, logs, by_team, by_events, unresolved): counts of the masked slots per base."""
    team, events = F.size("by_team") > 0, F.size("by_events") > 0
    return slots.groupBy("base").agg(
        F.count(F.lit(1)).alias("slots"), F.countDistinct("battle_id").alias("logs"), F.count_if(team).alias("by_team"), F.count_if(events).alias("by_events"), F.count_if(~team & ~events).alias("unresolved")
    )


def detail_frequency(logs: DataFrame, needle: str) -> DataFrame:
    """(kind, detail, n): how often the details of roster lines and of entries that hold a needle in any case occur."""
    out = None
    for kind, pattern in (("poke", LISTED), ("switch", SWITCHED)):
        details = logs.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("log", F.lit(pattern), F.lit(1))).alias("detail"))
        out = details if out is None else out.unionByName(details)
    return out.where(F.contains(F.lower("detail"), F.lit(needle.lower()))).groupBy("kind", bare(F.col("detail")).alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def is_complete(log: Column, members: int = MEMBERS, free_of: tuple[str, ...] = DISGUISED) -> Column:
    """Whether a log holds all that later steps need.

    That is: the given number of roster lines of both sides, a first turn, a shown team of both sides in the header of which just one
    nickname, as a whole or between its hyphens, is that of each roster line's base form, and none of the disguised names.
    """
    head = F.substring_index(log, "\n|\n", 1)
    fits = F.contains(log, F.lit("|turn|1"))
    for side in ("p1", "p2"):
        listed = F.regexp_extract_all(head, F.lit(rf"\|poke\|{side}\|([^,|]+)"), F.lit(1))
        body = F.get(F.regexp_extract_all(head, F.lit(rf"(?m)^\|showteam\|{side}\|(.*)$"), F.lit(1)), F.lit(0))
        names = F.transform(F.split(body, "]", -1), lambda m: F.substring_index(m, "|", 1))
        base = lambda p: id_string(F.substring_index(p, "-", 1))
        is_of = lambda n, p: (id_string(n) == base(p)) | F.exists(F.split(n, "-"), lambda x: id_string(x) == base(p))
        told = F.forall(listed, lambda p: F.size(F.filter(names, lambda n: is_of(n, p))) == 1)
        fits = fits & body.isNotNull() & (F.regexp_count(log, F.lit(rf"\|poke\|{side}\|")) == members) & told
    for name in free_of:
        fits = fits & ~F.contains(log, F.lit(name))
    return F.coalesce(fits, F.lit(False))
