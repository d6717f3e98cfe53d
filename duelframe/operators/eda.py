"""Exploratory summaries on the aggregate tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.contest import ALL_BANDS, BAND_EDGES, LOWEST_BAND, ratio
from duelframe.operators.contest import species_level


def average_rank(value: Column, *partition: str) -> Column:
    """Rank with the mean of ties."""
    w = Window.partitionBy(*partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): rank correlation per group; null without variance, as the division by zero would raise."""
    ranked = rows.withColumn("_x", average_rank(F.col(x), *keys)).withColumn("_y", average_rank(F.col(y), *keys))
    g = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_x", "_y").alias("c"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"))
    return g.select(*keys, "n", F.try_divide("c", F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))).alias("rho"))


def concentration(usage: DataFrame) -> DataFrame:
    """Per regulation: top species and its use, mean of the top five, species from 5 %, effective number."""
    g = species_level(usage).withColumn("usage", ratio("appearances", "player_battles"))
    w = Window.partitionBy("regulation")
    g = g.withColumn("place", F.row_number().over(w.orderBy(F.desc("usage"), "species_id"))).withColumn("p", ratio(F.col("appearances"), F.sum("appearances").over(w)))
    return g.groupBy("regulation").agg(
        F.max(F.when(F.col("place") == 1, F.col("species_id"))).alias("top_species_id"), F.max("usage").alias("top1_usage"), F.avg(F.when(F.col("place") <= 5, F.col("usage"))).alias("top5_mean_usage"),
        F.count_if(F.col("usage") >= 0.05).alias("species_over_5_pct"), (1 / F.sum(F.col("p") * F.col("p"))).alias("effective_species"),
    )


def stability(monthly: DataFrame, top: int = 30, min_player_battles: int = 20000) -> DataFrame:
    """Rank correlation of species use between following months, mean and least per regulation.

    Months of the tail, unknown or small months do not count; a species that is absent in a month has
    use 0; only the `top` species by appearances are ranked. Months without variance are passed over.
    """
    g = monthly.where(~F.col("tail") & (F.col("player_battles") >= min_player_battles) & (F.col("month") != "unknown"))
    months = g.select("regulation", "month").distinct().withColumn("m", F.dense_rank().over(Window.partitionBy("regulation").orderBy("month")))
    kept = g.groupBy("regulation", "species_id").agg(F.sum("appearances").alias("a")).withColumn("_r", F.row_number().over(Window.partitionBy("regulation").orderBy(F.desc("a"), "species_id"))).where(F.col("_r") <= top).select("regulation", "species_id")
    # every kept species in every month of its regulation: at most `top` rows a month
    grid = kept.join(months, "regulation").join(g.select("regulation", "month", "species_id", "usage_share"), ["regulation", "month", "species_id"], "left").fillna(0.0, ["usage_share"])
    ahead = grid.select("regulation", "species_id", (F.col("m") - 1).alias("m"), F.col("usage_share").alias("after"))
    rho = spearman(grid.join(ahead, ["regulation", "species_id", "m"]), ["regulation", "m"], "usage_share", "after")
    n = months.groupBy("regulation").agg(F.count(F.lit(1)).alias("months")).where("months >= 2")
    return rho.groupBy("regulation").agg(F.avg("rho").alias("mean_rank_corr"), F.min("rho").alias("min_rank_corr")).join(n, "regulation").select("regulation", "months", "mean_rank_corr", "min_rank_corr")


def band_shift(usage: DataFrame, regulation: str, low: str = "below_1200", high: str = "1500_plus", min_teams: int = 2000, n: int = 8) -> DataFrame:
    """Use in the high band minus use in the low band, the n least and n most."""
    def of(band: str, tag: str) -> DataFrame:
        g = species_level(usage, band).where((F.col("regulation") == regulation) & (F.col("appearances") >= min_teams))
        return g.select("species_id", "species", ratio("appearances", "player_battles").alias(f"usage_{tag}"))

    m = of(low, "low").join(of(high, "high").drop("species"), "species_id").withColumn("shift_pp", F.bround(100 * (F.col("usage_high") - F.col("usage_low")), 1))
    up = m.orderBy("shift_pp", "species_id").limit(n).select(F.lit("head").alias("end"), "*")
    return up.unionByName(m.orderBy(F.desc("shift_pp"), F.desc("species_id")).limit(n).select(F.lit("tail").alias("end"), "*"))


def popularity_vs_success(usage: DataFrame, min_teams: int = 2000, band: str = ALL_BANDS, least: int = 10) -> DataFrame:
    """Rank correlation of use and win rate per regulation with at least `least` species."""
    # the baseline of a regulation is one number, so ranking the win rate ranks the delta
    g = species_level(usage, band).where(F.col("appearances") >= min_teams)
    g = g.select("regulation", ratio("appearances", "player_battles").alias("usage"), ratio("wins", "appearances").alias("rate"))
    return spearman(g, ["regulation"], "usage", "rate").where(F.col("n") >= least).select("regulation", F.col("n").alias("species"), F.col("rho").alias("usage_vs_win"))


def popularity_by_band(usage: DataFrame, bands: list[str], min_teams: int = 2000, min_teams_band: int = 500, least: int = 10) -> DataFrame:
    """The same inside each band, one column per band."""
    out = None
    for b in bands:
        t = popularity_vs_success(usage, min_teams if b == ALL_BANDS else min_teams_band, b, least).select("regulation", F.col("usage_vs_win").alias(b))
        out = t if out is None else out.join(t, "regulation", "full_outer")
    return out


def label_profile(summary: DataFrame, labels: DataFrame, min_events: int = 5000) -> DataFrame:
    """Adoption of the event, and how predictable its label is."""
    s = summary.where(F.col("rating_band") == ALL_BANDS)
    adoption = s.groupBy("regulation").agg(F.sum("event_count").alias("e"), F.sum("sent_out").alias("o")).where("e > 0")
    big = s.where(F.col("event_count") >= min_events).select("regulation", "species_id")
    top = labels.where(F.col("rating_band") == ALL_BANDS).join(big, ["regulation", "species_id"], "left_semi").groupBy("regulation", "species_id").agg(F.max("label_share").alias("top"))
    g = top.groupBy("regulation").agg(F.count(F.lit(1)).alias("species_analysed"), F.median("top").alias("median_top_share"), F.avg((F.col("top") >= 0.5).cast("int")).alias("share_with_half"))
    return adoption.join(g, "regulation", "left").select("regulation", ratio("e", "o").alias("event_per_sent_out"), F.coalesce("species_analysed", F.lit(0)).alias("species_analysed"), "median_top_share", "share_with_half")


def top_pairs(pairs: DataFrame, regulation: str, min_teams: int = 5000, n: int = 10) -> DataFrame:
    """Pairs of highest lift with enough rosters."""
    rows = pairs.where((F.col("regulation") == regulation) & (F.col("rating_band") == ALL_BANDS) & (F.col("teams_both") >= min_teams))
    return rows.orderBy(F.desc("lift"), "species_a_id", "species_b_id").limit(n).select("species_a_id", "species_b_id", "teams_both", "lift")


def matchup_spread(table: DataFrame, min_battles: int = 2000) -> DataFrame:
    """How far match-ups lie from their expectation: median and 95th percentile in points, share of |z| > 4."""
    g = table.where((F.col("rating_band") == ALL_BANDS) & (F.col("battles") >= min_battles))
    dev = F.abs(100 * F.col("win_rate_vs_expected"))
    return g.groupBy("regulation").agg(F.count(F.lit(1)).alias("pairs"), F.median(dev).alias("median_abs_pp"), F.percentile(dev, F.lit(0.95)).alias("p95_abs_pp"), F.avg((F.abs("z_vs_expected") > 4).cast("int")).alias("share_abs_z_gt_4"))


def ordered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """Rows in the order of an external list, unknown labels last, stable by label."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def md_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table: thousands separated, null blank (K15, F29). For reports only.

    A result of more than `limit` rows ends with a line that says how many are left out.
    """
    def cell(v: object) -> str:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:,.4g}" if isinstance(v, float) else str(v)

    rows = df.limit(limit + 1).collect()
    if not rows:
        return "_(no data)_"
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit]]
    if len(rows) > limit:
        lines += ["", f"{df.count() - limit:,} further rows are left out."]
    return "\n".join(lines)


def enough_sides(usage_table: DataFrame, min_sides: int) -> tuple[DataFrame, DataFrame]:
    """(kept, left out): the (regulation, player_battles) with and without enough sides for a report."""
    sizes = usage_table.where(F.col("rating_band") == ALL_BANDS).groupBy("regulation").agg(F.max("player_battles").alias("player_battles"))
    return sizes.where(F.col("player_battles") >= min_sides), sizes.where(F.col("player_battles") < min_sides)


def report(usage_table: DataFrame, monthly: DataFrame | None = None, summary: DataFrame | None = None, labels: DataFrame | None = None, pairs: DataFrame | None = None,
           table: DataFrame | None = None, dim: DataFrame | None = None, min_sides: int = 50_000, min_teams: int = 5_000, min_events: int = 5_000, min_battles: int = 2_000) -> str:
    """The report of all summaries that the given aggregate tables allow, as Markdown.

    Regulations below `min_sides` are named and left out; tables that are not given leave their sections out. The regulations stand in the order
    of the dimension, under its labels. The aggregate tables are small beside the facts; only finished summaries come to the driver.
    """
    kept, small = enough_sides(usage_table, min_sides)
    of_kept = lambda df: None if df is None else df.join(kept.select("regulation"), "regulation", "left_semi")
    usage_table, monthly, summary, labels, pairs, table = (of_kept(d) for d in (usage_table, monthly, summary, labels, pairs, table))
    sizes = {r.regulation: r.player_battles for r in kept.collect()}  # regulations are few
    named = {r.regulation: r.label for r in dim.orderBy("sort_order").collect()} if dim is not None else {}
    order = list(named) or sorted(sizes)
    label = lambda r: named.get(r, r)
    parts = ["# Findings", "All figures are descriptive and hold for the completed contests of the regulation shown."]
    out = [f"{label(r.regulation)} ({r.player_battles:,})" for r in small.orderBy("regulation").collect()]
    if out:
        parts.append(f"Left out with fewer than {min_sides:,} sides: " + ", ".join(out) + ".")
    if not sizes:
        return "\n\n".join([*parts, "No regulation is large enough."]) + "\n"
    biggest = max(sizes, key=lambda r: (sizes[r], r))
    bands = {r[0] for r in usage_table.select("rating_band").distinct().collect()}
    top_band = BAND_EDGES[0][1]
    sections: list[tuple[str, DataFrame]] = [("Concentration of use", ordered(concentration(usage_table), order, "regulation"))]
    if monthly is not None:
        sections.append(("Stability of the ranking from month to month", ordered(stability(monthly), order, "regulation")))
    if {LOWEST_BAND, top_band} <= bands:
        sections.append((f"Use in the highest band against the lowest, {label(biggest)}", band_shift(usage_table, biggest, LOWEST_BAND, top_band)))
    sections.append(("Popularity and success", ordered(popularity_vs_success(usage_table), order, "regulation")))
    sections.append(("Popularity and success inside each band", ordered(popularity_by_band(usage_table, sorted(bands)), order, "regulation")))
    if summary is not None and labels is not None:
        sections.append(("Special events and how far their label can be told", ordered(label_profile(summary, labels, min_events), order, "regulation")))
    if pairs is not None:
        sections.append((f"Pairs beyond chance, {label(biggest)}", top_pairs(pairs, biggest, min_teams)))
    if table is not None:
        sections.append(("Match-ups against their expectation", ordered(matchup_spread(table, min_battles), order, "regulation")))
    for n, (title, rows) in enumerate(sections, start=1):
        parts += [f"## {n}. {title}", md_table(rows)]
    return "\n\n".join(parts) + "\n"
