"""Data quality: name map, masked forms, coverage, profiles and id checks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from duelframe.functions.contest import ratio, slug
from duelframe.session import Scratch

#: White space that Python's strip takes away.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
MASK = "-*"


def stripped(name: Column) -> Column:
    return F.btrim(name, F.lit(WHITE))


def name_counts(*columns: DataFrame) -> DataFrame:
    """(showdown_name, n_rows): counts of one-column tables of names, null and blank dropped."""
    rows = None
    for c in columns:
        one = c.select(stripped(F.col(c.columns[0])).alias("showdown_name")).where("showdown_name <> ''")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("showdown_name").agg(F.count(F.lit(1)).alias("n_rows"))


def split_fakes(counts: DataFrame, fakes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical and ignored names."""
    keys = fakes.select(stripped(F.col("showdown_name")).alias("showdown_name")).dropna().distinct()
    return counts.join(keys, "showdown_name", "left_anti"), counts.join(keys, "showdown_name", "left_semi")


def _master(master: DataFrame, strict: bool) -> DataFrame:
    m = master.where("pokemon IS NOT NULL").select(slug(F.col("pokemon")).alias("slug"), "poke_id", "pokemon", "species_id")
    if strict and m.groupBy("slug").count().where("count > 1").limit(1).count():
        raise ValueError("two master rows have one slug")
    return m.groupBy("slug").agg(F.min(F.struct("poke_id", "pokemon", "species_id")).alias("r")).select("slug", "r.*")


def families(m: DataFrame) -> DataFrame:
    """(base, species_id): every hyphen prefix of the slugs whose whole family is one species (Q2), without a theta join."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("slug", "-"))), lambda i: F.array_join(F.slice(F.split("slug", "-"), 1, i), "-"))
    rows = m.where("species_id IS NOT NULL").select("species_id", F.explode(prefixes).alias("base"))
    return rows.groupBy("base").agg(F.min("species_id").alias("low"), F.max("species_id").alias("high")).where("low = high").select("base", F.col("low").alias("species_id"))


def build_mapping(counts: DataFrame, master: DataFrame, overrides: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mapping, unmatched): override, exact slug, masked family, unlisted family, else unmatched (Q1).

    A form is never guessed: masked and unlisted names only get their species. strict raises on two master
    rows of one slug and on overrides that point to nothing; else the first row counts and such overrides are left out. Of several
    overrides of a name the first in order counts.
    """
    m = _master(master, strict)
    names = counts.withColumn("slug", slug(F.col("showdown_name")))
    if overrides is not None:
        o = overrides.dropna(subset=["showdown_name", "pokemon"]).select(stripped(F.col("showdown_name")).alias("showdown_name"), slug(F.col("pokemon")).alias("to"))
        if strict and o.join(m, o["to"] == m["slug"], "left_anti").limit(1).count():
            raise ValueError("overrides point to names that are not in the master data")
        o = o.join(m.select(F.col("slug").alias("to")), "to").groupBy("showdown_name").agg(F.min("to").alias("to"))
        names = names.join(o, "showdown_name", "left")
    else:
        names = names.withColumn("to", F.lit(None).cast("string"))
    hit = names.withColumn("key", F.coalesce("to", "slug")).join(m.withColumnRenamed("slug", "key"), "key", "left")
    fam = families(m)
    masked = F.when(F.col("showdown_name").endswith(MASK), F.regexp_replace(F.col("slug"), r"-?\*$", ""))
    first = F.when(F.col("slug").contains("-"), F.substring_index("slug", "-", 1))
    hit = hit.withColumn("masked_base", masked).withColumn("first_base", first)
    hit = hit.join(fam.select(F.col("base").alias("masked_base"), F.col("species_id").alias("masked_species")), "masked_base", "left")
    hit = hit.join(fam.select(F.col("base").alias("first_base"), F.col("species_id").alias("first_species")), "first_base", "left")
    known = F.col("pokemon").isNotNull()
    method = F.when(known & F.col("to").isNotNull(), "override").when(known, "exact").when(F.col("masked_species").isNotNull(), "masked").when(F.col("first_species").isNotNull(), "unlisted")
    out = hit.withColumn("method", method)
    mapping = out.where("method IS NOT NULL").select(
        "showdown_name", "poke_id", "pokemon", F.when(known, F.col("species_id")).otherwise(F.coalesce("masked_species", "first_species")).alias("species_id"),
        "method", F.when(known, "known").otherwise(F.col("method")).alias("form_status"), "n_rows",
    )
    return mapping, out.where("method IS NULL").select("showdown_name", "n_rows")


def suggestions(unmatched: DataFrame, master: DataFrame, limit: int = 3) -> DataFrame:
    """Unmatched names with up to `limit` similar slugs (F28), most frequent first.

    Uses a sequence-ratio match, which has no built-in, on the distinct unmatched names only. The
    master list is fixed and goes along with the function.
    """
    slugs = sorted(r[0] for r in master.where("pokemon IS NOT NULL").select(slug(F.col("pokemon"))).distinct().collect())

    def near(names: pd.Series) -> pd.Series:
        def one(s: str) -> str:
            base = s.split("-")[0]
            fitting = [x for x in slugs if x.startswith(s + "-")] + difflib.get_close_matches(s, slugs, n=limit, cutoff=0.6) + [x for x in slugs if x == base or x.startswith(base + "-")]
            return "; ".join(list(dict.fromkeys(fitting))[:limit])

        return names.map(one)

    return unmatched.withColumn("suggestions", F.pandas_udf(near, StringType())(slug(F.col("showdown_name")))).orderBy(F.desc("n_rows"), "showdown_name")


def coverage(mapping: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Row-weighted shares of the mapping methods in percent."""
    rows = mapping.select("method", "form_status", "n_rows").unionByName(unmatched.select(F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("form_status"), "n_rows"))
    total = F.greatest(F.coalesce(F.sum("n_rows"), F.lit(0)), F.lit(1))
    part = lambda cond: (100 * F.coalesce(F.sum(F.when(cond, F.col("n_rows"))), F.lit(0)) / total)
    return rows.agg(
        F.count(F.lit(1)).alias("names"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), part(F.col("form_status") == "known").alias("exact_form_pct"),
        part(F.col("form_status").isin("masked", "unlisted")).alias("species_only_pct"), part(F.col("method").isNull()).alias("unmatched_pct"),
    )


def side_coverage(slots: DataFrame, players: DataFrame) -> DataFrame:
    """(sides, covered, share): distinct (battle, side) of the rosters found among the players (Q4, J12); share 0 when empty."""
    have = slots.select("battle_id", F.col("player_side").alias("side")).distinct()
    keys = players.select("battle_id", "side").distinct().withColumn("known", F.lit(1))
    on = have["battle_id"].eqNullSafe(keys["battle_id"]) & have["side"].eqNullSafe(keys["side"])
    g = have.join(keys, on, "left").agg(F.count(F.lit(1)).alias("sides"), F.count("known").alias("covered"))
    return g.withColumn("share", F.coalesce(ratio("covered", "sides"), F.lit(0.0)))


def resolve_masked(slots: DataFrame, players: DataFrame, events: DataFrame) -> DataFrame:
    """One row per masked slot with candidates, status and resolved name.

    An event of the same battle and user fits if its name is the base or starts with the prefix.
    Slots without a user are 'no_player'. Of several users of a side the first in order counts.
    """
    masked = slots.where(F.col("pokemon_name").endswith(MASK)).select("battle_id", "player_side", "slot_no", "pokemon_name").withColumn("slot_key", F.monotonically_increasing_id())
    owner = players.groupBy("battle_id", F.col("side").alias("player_side")).agg(F.min("username").alias("username"))
    # written once, since the number of a slot must be the same in both branches below
    masked = Scratch(slots.sparkSession, "masked").save(masked.join(owner, ["battle_id", "player_side"], "left"))
    ev = events.select("battle_id", "username", F.col("pokemon_name").alias("seen")).dropna().distinct().where(~F.col("seen").endswith(MASK))
    brought = ev.groupBy("battle_id", "username").agg(F.countDistinct(F.substring_index(F.lower("seen"), "-", 1)).alias("brought_n"))
    prefix = F.lower(F.expr("substr(pokemon_name, 1, length(pokemon_name) - 1)"))
    fits = (F.lower("seen") == F.rtrim(F.regexp_replace(prefix, "-+$", ""))) | F.startswith(F.lower("seen"), prefix)
    found = masked.join(ev, ["battle_id", "username"]).where(fits).groupBy("slot_key").agg(F.array_sort(F.collect_set("seen")).alias("candidates"))
    out = masked.join(found, "slot_key", "left").join(brought, ["battle_id", "username"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).withColumn("n_candidates", F.size("candidates"))
    status = F.when(F.col("username").isNull(), "no_player").when(F.col("n_candidates") == 1, "resolved").when(F.col("n_candidates") > 1, "ambiguous").otherwise("unknown")
    return out.select(
        "battle_id", "player_side", "slot_no", "pokemon_name", "username", F.coalesce("brought_n", F.lit(0)).alias("brought_n"), F.array_join("candidates", ";").alias("candidates"), "n_candidates",
        status.alias("status"), F.when(F.col("n_candidates") == 1, F.col("candidates")[0]).alias("resolved_name"),
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """Masked names by status, as a pivot with zeros."""
    states = ["resolved", "ambiguous", "unknown", "no_player"]
    return resolved.groupBy("pokemon_name").pivot("status", states).agg(F.count(F.lit(1))).fillna(0, states)


def species_profile(rows: DataFrame) -> DataFrame:
    """Counts of empty, masked, differing species and of rows without user over all rows."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank("species")).alias("empty"), F.count_if(F.col("species").endswith("*")).alias("masked"),
        F.count_if(F.col("species") != F.col("pokemon_name")).alias("nickname"), F.count_if(blank("username")).alias("no_user"),
    )


def probe_values(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Values that contain a needle in any case, most frequent first."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(needle.lower()))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def sent_out_histogram(slots: DataFrame) -> DataFrame:
    """How many members each roster sent out and led with (Q6)."""
    per = slots.groupBy("battle_id", "player_side").agg(F.sum(F.coalesce(F.col("was_sent_out").cast("int"), F.lit(0))).alias("sent"), F.sum(F.coalesce(F.col("is_lead").cast("int"), F.lit(0))).alias("leads"))
    return per.groupBy("sent", "leads").agg(F.count(F.lit(1)).alias("sides"))


def id_collisions(rows: DataFrame, id_col: str, text_col: str, head: int = 500) -> DataFrame:
    """Rows, distinct ids and distinct digests of the text heads."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(id_col).alias("ids"), F.countDistinct(F.md5(F.left(F.col(text_col), F.lit(head)))).alias("head_digests"))


def whole_contest_sample(rows: DataFrame, every: int, id_col: str = "battle_id") -> DataFrame:
    """A systematic sample of whole contests by the digest of their id."""
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)


def first_per_id(rows: DataFrame, id_col: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with the first of each id, and the number of skipped duplicates per id."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").groupBy(id_col).agg(F.count(F.lit(1)).alias("skipped_duplicate"))


def without_edge_contests(rows: DataFrame, group: str, order: list[Column], id_col: str = "battle_id", at_least: int = 20) -> DataFrame:
    """Rows without the first and the last contest of each group of more than `at_least` contests (J16): a group that was cut out of a larger table may hold them in part.

    order: order of the rows inside a group; groups are row groups or files, so bounded.
    """
    key = F.struct(*order)
    ends = rows.groupBy(group).agg(F.countDistinct(id_col).alias("n"), F.min_by(id_col, key).alias("low"), F.max_by(id_col, key).alias("high")).where(F.col("n") > at_least)
    edge = ends.select(group, F.explode(F.array_distinct(F.array("low", "high"))).alias(id_col))
    return rows.join(edge, [group, id_col], "left_anti")


def of_contests(rows: DataFrame, ids: DataFrame, id_col: str = "battle_id") -> DataFrame:
    """Rows of the listed contests (S5); the list may be of any size."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def rows_per_contest(rows: DataFrame, id_col: str = "battle_id") -> DataFrame:
    """(rows, contests): how many rows the contests have (Q6); rows without an id are one contest without id."""
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).groupBy("rows").agg(F.count(F.lit(1)).alias("contests"))


def odd_ratings(players: DataFrame, below: float = 800) -> DataFrame:
    """(ratings, low): known ratings and those too low to be ratings (Q6)."""
    return players.agg(F.count("rating_before").alias("ratings"), F.count_if(F.col("rating_before") < below).alias("low"))


def coverage_gate(covered: DataFrame, least: float = 0.99) -> DataFrame:
    """The side coverage with whether it is enough to go on (Q4)."""
    return covered.withColumn("passes", F.col("share") >= least)


def first_rows(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, such as a file, in an order (O8); 0 for all."""
    if not n:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_contests(rows: DataFrame, n: int, id_col: str = "battle_id") -> DataFrame:
    """Rows of the first n contests in order of their ids (O8); rows without an id are of none."""
    return of_contests(rows, rows.select(id_col).dropna().distinct().orderBy(id_col).limit(n), id_col)


def invariants(usage: DataFrame, pairs: DataFrame, matchups: DataFrame, events: DataFrame) -> DataFrame:
    """(invariant, value, holds): what must be true of sound aggregate tables (Q8).

    The bands of a usage row add up to 'all'; win and sent-out counts do not exceed appearances; a pair stands in no more
    rosters than either member; match-ups are antisymmetric; events do not exceed those sent out.
    """
    bands = usage.groupBy("regulation", "species_id", "poke_id", "form_basis").agg(
        F.sum(F.when(F.col("rating_band") == "all", F.col("appearances")).otherwise(0)).alias("whole"), F.sum(F.when(F.col("rating_band") != "all", F.col("appearances")).otherwise(0)).alias("parts")
    )
    mirror = matchups.select("regulation", "rating_band", F.col("species_a_id").alias("species_b_id"), F.col("species_b_id").alias("species_a_id"), F.col("battles").alias("m"), F.col("wins").alias("w"))
    faced = matchups.where("rating_band = 'all'").join(mirror, ["regulation", "rating_band", "species_a_id", "species_b_id"], "left")
    broken = {
        "bands add up to all": bands.where("whole <> parts"),
        "no more wins, sent out or leads than appearances": usage.where("wins > appearances OR sent_out > appearances OR leads > appearances OR sent_out_wins > sent_out"),
        "no more rosters with a pair than with a member": pairs.where("teams_both > teams_a OR teams_both > teams_b OR wins_both > teams_both"),
        "match-ups are antisymmetric": faced.where("m IS NULL OR m <> battles OR wins + w <> battles"),
        "no more events than sent out with one": events.where("event_wins > event_count"),
    }
    out = None
    for name, rows in broken.items():
        one = rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("invariant"), "value", (F.col("value") == 0).alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out
