"""Contest scope and aggregate tables: usage, partners, match-ups, events, trend, dimensions.

All operators take and return DataFrames. Facts are joined with the scope by contest and with the
name map by `look_up`, which holds for hot names. The counts are summed
with map-side aggregation and rolled up to the 'all' band by grouping sets before enrichment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import contest as X
from duelframe.functions.joins import look_up

TAIL_SHARE = 0.05
COUNTS = ("appearances", "wins", "sent_out", "sent_out_wins", "leads")


def scope(battles: DataFrame, players: DataFrame) -> DataFrame:
    """Completed contests in scope (P1, P2, J1, A1, A2, F8): one row per battle_id.

    Complete means just two player rows, one WIN and one LOSS. Of several battle rows with one id the
    highest values count. A side without a row has a null rating and user.
    """
    b = battles.groupBy("battle_id").agg(F.max("format_id").alias("format_id"), F.max("turn_count").alias("turn_count"), F.max("upload_time").alias("upload_time"))
    b = b.where(X.in_scope_format(F.col("format_id")) & (F.coalesce("turn_count", F.lit(0)) >= 1))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    p = players.groupBy("battle_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("result") == "WIN").alias("w"), F.count_if(F.col("result") == "LOSS").alias("l"),
        F.coalesce(F.bool_or((F.col("side") == "p1") & (F.col("result") == "WIN")), F.lit(False)).alias("p1_win"),
        of("p1", "rating_before").alias("p1_rating"), of("p2", "rating_before").alias("p2_rating"), of("p1", "username").alias("p1_user"), of("p2", "username").alias("p2_user"),
    ).where("rows = 2 AND w = 1 AND l = 1")
    return b.join(p, "battle_id").select(
        "battle_id", X.segment(F.col("format_id")).alias("regulation"), X.month_of(F.col("upload_time")).alias("month"), "p1_win", "p1_rating", "p2_rating", "p1_user", "p2_user"
    )


def sides(contests: DataFrame) -> DataFrame:
    """(battle_id, side, regulation, month, rating_band, won, username): one row per side."""
    each = F.array(*[
        F.struct(F.lit(s).alias("side"), X.rating_band(F.col(f"{s}_rating")).alias("rating_band"), (F.col("p1_win") if s == "p1" else ~F.col("p1_win")).cast("int").alias("won"), F.col(f"{s}_user").alias("username"))
        for s in ("p1", "p2")
    ])
    return contests.select("battle_id", "regulation", "month", F.explode(each).alias("s")).select("battle_id", "regulation", "month", "s.*")


def with_all_band(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums per (keys, rating_band) and, as band 'all', per keys (A3, A7): one pass by grouping sets."""
    bands = rows.select("rating_band", *keys, *sums)
    out = bands.groupingSets([[*keys, "rating_band"], keys], *keys, "rating_band").agg(*[F.sum(c).alias(c) for c in sums], F.grouping("rating_band").alias("_all"))
    return out.withColumn("rating_band", F.when(F.col("_all") == 1, X.ALL_BANDS).otherwise(F.col("rating_band"))).drop("_all")


def band_totals(contests: DataFrame) -> DataFrame:
    """(regulation, rating_band, battles, player_battles); battles only on band 'all'."""
    t = with_all_band(sides(contests).withColumn("player_battles", F.lit(1)), ["regulation"], ["player_battles"])
    return t.select("regulation", "rating_band", F.when(F.col("rating_band") == X.ALL_BANDS, F.expr("player_battles div 2")).alias("battles"), "player_battles")


def slot_facts(slots: DataFrame, contests: DataFrame, names: DataFrame) -> DataFrame:
    """In-scope roster rows with side values, species, form and basis (J2, J3, P4, P5); species_id null if unmapped.

    names: one row per showdown_name. Listed rows are known by their name, observed ones by what was
    seen; a form that the map does not know is no form. Any side but p1 is the other side. The map is counted: it is
    broadcast up to a bound, else its keys are salted, since one name may hold a third of all rows (give a written map).
    """
    side = F.when(F.col("player_side") == "p1", "p1").otherwise("p2")
    facts = slots.select("battle_id", "player_side", "pokemon_name", "species_observed", "form_status", "was_sent_out", "is_lead", side.alias("side"))
    facts = facts.join(sides(contests), ["battle_id", "side"])
    form_name = F.when(F.col("form_status") == "listed", F.col("pokemon_name")).when(F.col("form_status") == "observed", F.col("species_observed"))
    facts = facts.withColumn("form_name", form_name)
    facts = look_up(facts, names.select(F.col("showdown_name").alias("pokemon_name"), "species_id"), "pokemon_name", "left", "battle_id")
    # rows without a form meet nothing: their null key is spread with the salts
    facts = look_up(facts, names.select(F.col("showdown_name").alias("form_name"), "poke_id"), "form_name", "left", "battle_id")
    basis = F.when(F.col("poke_id").isNotNull(), F.col("form_status")).when(F.col("form_status").isin("unobserved", "ambiguous"), "unobserved").otherwise("species_only")
    sent = F.coalesce(F.col("was_sent_out").cast("int"), F.lit(0))
    return facts.select(
        "battle_id", "player_side", "side", "regulation", "month", "rating_band", "username", "species_id", "poke_id", basis.alias("form_basis"), F.lit(1).alias("appearances"),
        F.col("won").alias("wins"), sent.alias("sent_out"), (sent * F.col("won")).alias("sent_out_wins"), F.coalesce(F.col("is_lead").cast("int"), F.lit(0)).alias("leads"),
    )


def species_labels(names: DataFrame) -> DataFrame:
    """(species_id, species): the shortest name of a species without its mask, first in order."""
    label = F.replace(F.col("showdown_name"), F.lit("-*"), F.lit(""))
    return names.where("species_id IS NOT NULL").groupBy("species_id").agg(F.min(F.struct(F.length(label).alias("n"), label.alias("label"))).alias("m")).select("species_id", F.col("m.label").alias("species"))


def with_interval(df: DataFrame, wins: str = "wins", n: str = "appearances", low: str = "win_ci_low", high: str = "win_ci_high") -> DataFrame:
    a, b = X.wilson(F.col(wins), F.col(n))
    return df.withColumn(low, a).withColumn(high, b)


def usage(slots: DataFrame, contests: DataFrame, names: DataFrame) -> DataFrame:
    """Usage table (A4, A7, A8, J4, W1, F1): rates with their denominators per regulation, band, species, form and basis."""
    facts = slot_facts(slots, contests, names).where("species_id IS NOT NULL")
    counts = with_all_band(facts, ["regulation", "species_id", "poke_id", "form_basis"], list(COUNTS))
    out = counts.join(band_totals(contests).select("regulation", "rating_band", "player_battles"), ["regulation", "rating_band"])
    band = Window.partitionBy("regulation", "rating_band")
    out = out.withColumns({
        "usage_share": X.ratio("appearances", "player_battles"), "win_rate": X.ratio("wins", "appearances"),
        "band_win_rate": X.ratio(F.sum("wins").over(band), F.sum("appearances").over(band)),
        "sent_out_rate": X.ratio("sent_out", "appearances"), "lead_rate": X.ratio("leads", "appearances"),
    }).withColumn("win_rate_delta", F.col("win_rate") - F.col("band_win_rate"))
    forms = names.where("poke_id IS NOT NULL").groupBy("poke_id").agg(F.min("pokemon").alias("form"))
    out = with_interval(out).join(species_labels(names), "species_id", "left").join(forms, "poke_id", "left")
    return out.select(
        "regulation", "rating_band", "species", "species_id", "form", "poke_id", "form_basis", *COUNTS, "player_battles", "usage_share", "win_rate", "band_win_rate", "win_rate_delta",
        "win_ci_low", "win_ci_high", "sent_out_rate", "lead_rate",
    )


def unmapped_slots(slots: DataFrame, contests: DataFrame, names: DataFrame) -> DataFrame:
    """(unmapped): in-scope roster rows whose name is not in the map."""
    return slot_facts(slots, contests, names).agg(F.count_if(F.col("species_id").isNull()).alias("unmapped"))


def species_level(usage_table: DataFrame, band: str = X.ALL_BANDS) -> DataFrame:
    """Species roll-up over forms for one band."""
    rows = usage_table.where(F.col("rating_band") == band)
    return rows.groupBy("regulation", "species_id", "species").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("player_battles").alias("player_battles"))


def top_species(usage_table: DataFrame, regulation: str, n: int = 15, band: str = X.ALL_BANDS) -> DataFrame:
    """Most used species of a regulation and band with percentages of one decimal."""
    rows = usage_table.where((F.col("regulation") == regulation) & (F.col("rating_band") == band))
    base = rows.agg((100 * X.ratio(F.sum("wins"), F.sum("appearances"))).alias("base"))
    g = species_level(rows, band).join(F.broadcast(base))  # one row
    percent = lambda a, b: F.bround(100 * X.ratio(a, b), 1)
    return (
        g.select("species_id", "species", "appearances", percent("appearances", "player_battles").alias("usage_pct"), percent("wins", "appearances").alias("win_pct"), F.bround(percent("wins", "appearances") - F.col("base"), 1).alias("vs_band_pp"), percent("sent_out", "appearances").alias("sent_out_pct"), percent("leads", "appearances").alias("lead_pct"))
        .orderBy(F.desc("appearances"), "species_id").limit(n)
    )


def team_items(slots: DataFrame, contests: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (team, species) of in-scope rosters (A16) with the side's values; any side but p1 is p2."""
    return slot_facts(slots, contests, names).where("species_id IS NOT NULL").select("battle_id", F.col("side").alias("player_side"), "regulation", "rating_band", "species_id", "wins").distinct()


def partners(slots: DataFrame, contests: DataFrame, names: DataFrame, min_support: int = 100) -> DataFrame:
    """Pair table (J6, J8, A11, A12, P7): same roster, a < b, with shares, lift, win rate and band delta.

    Pairs are made inside each roster's sorted species array (at most some fifteen a roster), so
    the facts are shuffled once. The support filter comes after the roll-up and before the enrichment.
    """
    items = team_items(slots, contests, names)
    teams = items.groupBy("battle_id", "player_side", "regulation", "rating_band", "wins").agg(F.array_sort(F.collect_list("species_id")).alias("ids"))
    pairs = teams.select("regulation", "rating_band", "wins", "ids", F.posexplode("ids").alias("i", "species_a_id")).select("regulation", "rating_band", "wins", "species_a_id", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("species_b_id"))
    counts = with_all_band(pairs.withColumn("teams_both", F.lit(1)).withColumnRenamed("wins", "wins_both"), ["regulation", "species_a_id", "species_b_id"], ["teams_both", "wins_both"])
    single = with_all_band(items.withColumn("teams", F.lit(1)), ["regulation", "species_id"], ["teams"])
    total = with_all_band(teams.select("regulation", "rating_band", F.lit(1).alias("teams_total"), F.col("wins").alias("wins_total")), ["regulation"], ["teams_total", "wins_total"])
    labels = species_labels(names)
    key = ["regulation", "rating_band"]
    out = counts.where(F.col("teams_both") >= min_support)
    for s in "ab":
        out = out.join(single.withColumnRenamed("species_id", f"species_{s}_id").withColumnRenamed("teams", f"teams_{s}"), [*key, f"species_{s}_id"])
        out = out.join(labels.select(F.col("species_id").alias(f"species_{s}_id"), F.col("species").alias(f"species_{s}")), f"species_{s}_id", "left")
    out = with_interval(out.join(total, key), "wins_both", "teams_both")
    return out.select(
        *key, "species_a", "species_b", "species_a_id", "species_b_id", "teams_both", "teams_a", "teams_b", "teams_total", "wins_both", X.ratio("teams_both", "teams_a").alias("share_of_a"), X.ratio("teams_both", "teams_b").alias("share_of_b"),
        X.ratio(F.col("teams_both").cast("double") * F.col("teams_total"), F.col("teams_a").cast("double") * F.col("teams_b")).alias("lift"), X.ratio("wins_both", "teams_both").alias("win_rate"), "win_ci_low", "win_ci_high",
        X.ratio("wins_total", "teams_total").alias("band_win_rate"), (X.ratio("wins_both", "teams_both") - X.ratio("wins_total", "teams_total")).alias("win_rate_delta"),
    )


def partners_of(pairs: DataFrame, regulation: str, species_id: int, n: int = 10, band: str = X.ALL_BANDS) -> DataFrame:
    """The other members that stand most often beside one species (O2)."""
    rows = pairs.where((F.col("regulation") == regulation) & (F.col("rating_band") == band) & ((F.col("species_a_id") == species_id) | (F.col("species_b_id") == species_id)))
    own = F.col("species_a_id") == species_id
    pick = lambda a, b: F.when(own, F.col(b)).otherwise(F.col(a))
    return rows.select(pick("species_a_id", "species_b_id").alias("partner_id"), pick("species_a", "species_b").alias("partner"), "teams_both", F.bround(100 * F.when(own, F.col("share_of_a")).otherwise(F.col("share_of_b")), 1).alias("share_pct"), "lift").orderBy(F.desc("share_pct"), "partner_id").limit(n)


def matchups(slots: DataFrame, contests: DataFrame, names: DataFrame, min_support: int = 200) -> DataFrame:
    """Ordered match-up table (J7, J8, A13, A14, F2, P7) against a log5 expectation.

    Both rosters of a contest come together in one row, so no self-join: every a of one side meets every
    other b of the other side. a's rate is that of its own band, b's always that of all bands.
    """
    items = team_items(slots, contests, names)
    other = F.when(F.col("player_side") == "p1", "p2").otherwise("p1")
    team = items.groupBy("battle_id", "player_side", "regulation", "rating_band", "wins").agg(F.collect_list("species_id").alias("ids"))
    one = team.select("battle_id", "player_side", "regulation", "rating_band", "wins", "ids")
    two = team.select("battle_id", other.alias("player_side"), F.col("ids").alias("rivals"))
    met = one.join(two, ["battle_id", "player_side"]).select("regulation", "rating_band", "wins", F.explode("ids").alias("species_a_id"), "rivals").select("regulation", "rating_band", "wins", "species_a_id", F.explode("rivals").alias("species_b_id"))
    met = met.where("species_a_id <> species_b_id").withColumn("battles", F.lit(1))
    counts = with_all_band(met, ["regulation", "species_a_id", "species_b_id"], ["battles", "wins"]).where(F.col("battles") >= min_support)
    single = with_all_band(items.withColumn("teams", F.lit(1)), ["regulation", "species_id"], ["teams", "wins"]).withColumn("rate", X.ratio("wins", "teams"))
    a = single.select("regulation", "rating_band", F.col("species_id").alias("species_a_id"), F.col("teams").alias("teams_a"), F.col("rate").alias("a_win_rate"))
    b = single.where(F.col("rating_band") == X.ALL_BANDS).select("regulation", F.col("species_id").alias("species_b_id"), F.col("rate").alias("b_win_rate"))
    labels = species_labels(names)
    out = counts.join(a, ["regulation", "rating_band", "species_a_id"]).join(b, ["regulation", "species_b_id"])
    for s in "ab":
        out = out.join(labels.select(F.col("species_id").alias(f"species_{s}_id"), F.col("species").alias(f"species_{s}")), f"species_{s}_id", "left")
    expected = X.log5(F.col("a_win_rate"), F.col("b_win_rate"))
    out = with_interval(out.withColumn("win_rate", X.ratio("wins", "battles")).withColumn("expected_win_rate", expected), "wins", "battles")
    vs = F.col("win_rate") - F.col("expected_win_rate")
    return out.select(
        "regulation", "rating_band", "species_a", "species_b", "species_a_id", "species_b_id", "battles", "wins", "teams_a", "win_rate", "win_ci_low", "win_ci_high", "a_win_rate", (F.col("win_rate") - F.col("a_win_rate")).alias("win_rate_delta"), "b_win_rate",
        "expected_win_rate", vs.alias("win_rate_vs_expected"), (vs / F.sqrt(F.col("expected_win_rate") * (1 - F.col("expected_win_rate")) / F.col("battles"))).alias("z_vs_expected"),
    )


def asymmetric_matchups(table: DataFrame) -> DataFrame:
    """Rows of band 'all' whose mirror is missing or does not add up (J9); none in a sound table."""
    rows = table.where(F.col("rating_band") == X.ALL_BANDS).select("regulation", "species_a_id", "species_b_id", "battles", "wins")
    mirror = rows.select("regulation", F.col("species_a_id").alias("species_b_id"), F.col("species_b_id").alias("species_a_id"), F.col("battles").alias("m_battles"), F.col("wins").alias("m_wins"))
    return rows.join(mirror, ["regulation", "species_a_id", "species_b_id"], "left").where("m_battles IS NULL OR m_battles <> battles OR wins + m_wins <> battles").select("regulation", "species_a_id", "species_b_id", "battles", "wins")


def opponents_of(table: DataFrame, regulation: str, species_id: int, band: str = X.ALL_BANDS, min_battles: int = 500, n: int = 8) -> DataFrame:
    """The n best and, from worst on, the n worst opponents of a species (O4); short lists overlap."""
    rows = table.where((F.col("regulation") == regulation) & (F.col("rating_band") == band) & (F.col("species_a_id") == species_id) & (F.col("battles") >= min_battles))
    cols = ["species_b_id", "species_b", "battles", "win_rate", "win_rate_vs_expected"]
    best = rows.orderBy(F.desc("win_rate_vs_expected"), "species_b_id").limit(n).select(F.lit("best").alias("end"), *cols)
    return best.unionByName(rows.orderBy("win_rate_vs_expected", F.desc("species_b_id")).limit(n).select(F.lit("worst").alias("end"), *cols))


def special_events(events: DataFrame, contests: DataFrame, names: DataFrame, order: list[Column]) -> DataFrame:
    """First event of each side with its outcome (J14, W3): attribution by user, then first, then species.

    events: battle_id, username, species, label. species_id is null where unmapped (counted after the
    dedupe); events of users of neither side vanish. Equal users on both sides count for p1.
    """
    owners = sides(contests).where("username IS NOT NULL").groupBy("battle_id", "username").agg(F.min(F.struct("side", "regulation", "rating_band", "won")).alias("s")).select("battle_id", "username", "s.*")
    owned = events.withColumn("username", F.coalesce("username", F.lit(""))).join(owners, ["battle_id", "username"])
    first = Window.partitionBy("battle_id", "side").orderBy(*order)
    kept = owned.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return look_up(kept, names.select(F.col("showdown_name").alias("species"), "species_id"), "species", "left", "battle_id").select("battle_id", "side", "regulation", "rating_band", "species_id", "label", "won")


def unattributed_events(events: DataFrame, contests: DataFrame) -> DataFrame:
    """(events, unattributed): in-scope events and those of users of neither side."""
    users = sides(contests).where("username IS NOT NULL").select("battle_id", "username").distinct().withColumn("known", F.lit(1))
    inside = events.withColumn("username", F.coalesce("username", F.lit(""))).join(contests.select("battle_id"), "battle_id", "left_semi").join(users, ["battle_id", "username"], "left")
    return inside.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("known").isNull()).alias("unattributed"))


def event_labels(firsts: DataFrame, names: DataFrame) -> DataFrame:
    """Label table (A9, A10): events and wins per species and label, with the label's share."""
    rows = firsts.where("species_id IS NOT NULL AND label IS NOT NULL").select("regulation", "rating_band", "species_id", "label", F.lit(1).alias("events"), F.col("won").alias("wins"))
    counts = with_all_band(rows, ["regulation", "species_id", "label"], ["events", "wins"])
    w = Window.partitionBy("regulation", "rating_band", "species_id")
    return counts.withColumns({"all_events": F.sum("events").over(w), "all_wins": F.sum("wins").over(w)}).withColumn("label_share", X.ratio("events", "all_events")).join(species_labels(names), "species_id", "left")


def event_summary(labels: DataFrame, usage_table: DataFrame) -> DataFrame:
    """Per species with usage (J5, A10): event rate with interval, win rates with and without the event (null for 0)."""
    sent = usage_table.groupBy("regulation", "rating_band", "species_id", "species").agg(F.sum("sent_out").alias("sent_out"), F.sum("sent_out_wins").alias("sent_out_wins"))
    e = labels.groupBy("regulation", "rating_band", "species_id").agg(F.sum("events").alias("event_count"), F.sum("wins").alias("event_wins"))
    out = sent.join(e, ["regulation", "rating_band", "species_id"], "left").fillna(0, ["event_count", "event_wins"])
    out = with_interval(out.where("sent_out > 0"), "event_count", "sent_out", "event_rate_ci_low", "event_rate_ci_high")
    return out.select(
        "regulation", "rating_band", "species", "species_id", "sent_out", "sent_out_wins", "event_count", "event_wins", X.ratio("event_count", "sent_out").alias("event_rate"), "event_rate_ci_low", "event_rate_ci_high", X.ratio("event_wins", "event_count").alias("win_rate_with"),
        X.ratio(F.col("sent_out_wins") - F.col("event_wins"), F.greatest(F.col("sent_out") - F.col("event_count"), F.lit(0))).alias("win_rate_without"),
    )


def top_labels(labels: DataFrame) -> DataFrame:
    """The most frequent label of each species (W4), first in order on ties."""
    w = Window.partitionBy("regulation", "rating_band", "species_id").orderBy(F.desc("events"), "label")
    return labels.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("regulation", "rating_band", "species_id", "label", "events", "label_share")


def monthly_totals(contests: DataFrame) -> DataFrame:
    """(regulation, month, battles, player_battles, share_of_peak, tail)."""
    t = contests.groupBy("regulation", "month").agg(F.count(F.lit(1)).alias("battles")).withColumn("player_battles", F.col("battles") * 2)
    t = t.withColumn("share_of_peak", X.ratio(F.col("battles"), F.max("battles").over(Window.partitionBy("regulation"))))
    return t.withColumn("tail", F.col("share_of_peak") < TAIL_SHARE)


def monthly_usage(slots: DataFrame, contests: DataFrame, names: DataFrame) -> DataFrame:
    """Monthly usage of each species with rates, interval and the month's tail flag."""
    facts = slot_facts(slots, contests, names).where("species_id IS NOT NULL")
    g = facts.groupBy("regulation", "month", "species_id").agg(*[F.sum(c).alias(c) for c in ("appearances", "wins", "sent_out")])
    out = with_interval(g.join(monthly_totals(contests).select("regulation", "month", "player_battles", "tail"), ["regulation", "month"])).join(species_labels(names), "species_id", "left")
    return out.select("regulation", "month", "species", "species_id", "appearances", "wins", "sent_out", "player_battles", "tail", X.ratio("appearances", "player_battles").alias("usage_share"), X.ratio("wins", "appearances").alias("win_rate"), "win_ci_low", "win_ci_high", X.ratio("sent_out", "appearances").alias("sent_out_rate"))


def species_trend(monthly: DataFrame, regulation: str, species_id: int) -> DataFrame:
    """One species of a regulation month by month (O2)."""
    return monthly.where((F.col("regulation") == regulation) & (F.col("species_id") == species_id)).orderBy("month")


def dim_regulation(contests: DataFrame) -> DataFrame:
    """Segments with parsed names, known months, busiest month and a fixed sort order."""
    m = monthly_totals(contests)
    known = F.when(F.col("month") != "unknown", F.col("month"))
    # on ties the earliest month is the busiest
    rank = Window.partitionBy("regulation").orderBy(F.desc("battles"), "month")
    g = m.withColumn("_r", F.row_number().over(rank)).groupBy("regulation").agg(F.min(known).alias("first_month"), F.max(known).alias("last_month"), F.max(F.when(F.col("_r") == 1, F.col("month"))).alias("busiest_month"), F.sum("battles").alias("battles"), F.sum("player_battles").alias("player_battles"))
    g = g.withColumns(X.parse_segment(F.col("regulation")))
    # segments are few; the order over all of them is one small sort
    order = F.row_number().over(Window.orderBy("busiest_month", "regulation"))
    return g.withColumn("sort_order", order).select("regulation", "sort_order", "label", "game", "season_year", "reg_letter", "first_month", "last_month", "busiest_month", "battles", "player_battles")


def dim_month(contests: DataFrame) -> DataFrame:
    """Known months with date, year, number and label."""
    m = contests.select("month").distinct().where("month <> 'unknown'")
    start = F.to_date(F.concat("month", F.lit("-01")))
    return m.select("month", start.alias("month_start"), F.year(start).alias("year"), F.month(start).alias("month_number"), F.date_format(start, "MMM yyyy").alias("label"))


def dim_species(names: DataFrame) -> DataFrame:
    """Species with label and whether some name of it hides its form."""
    masked = names.where("species_id IS NOT NULL").groupBy("species_id").agg(F.bool_or(F.col("form_status") == "masked").alias("has_masked_form"))
    return masked.join(species_labels(names), "species_id").select("species_id", "species", "has_masked_form")


def dim_rating_band(spark) -> DataFrame:
    """Bands in order with their edges."""
    edges = sorted(X.BAND_EDGES)
    lows = [None, *[e for e, _ in edges]]
    names = [X.LOWEST_BAND, *[n for _, n in edges]]
    rows = [(X.ALL_BANDS, "All ratings", None, None)]
    rows += [(n, n.replace("_", " "), low, lows[i + 1] - 1 if i + 1 < len(lows) else None) for i, (n, low) in enumerate(zip(names, lows, strict=True))]
    rows.append((X.NO_BAND, "No rating", None, None))
    return spark.createDataFrame([(b, i + 1, *r) for i, (b, *r) in enumerate(rows)], "rating_band string, sort_order int, label string, rating_min long, rating_max long")
