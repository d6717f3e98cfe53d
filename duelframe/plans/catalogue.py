"""Registered queries of the contest operators on the contest tables, with equivalent SQL.

Doubles are rounded to nine places on both sides, so that the order of additions does not matter.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions import contest as X
from duelframe.operators import contest as C
from duelframe.operators import diagnosis as D
from duelframe.operators import eda as E
from duelframe.operators import quality as Q
from duelframe.operators import similarity
from duelframe.plans import catalogue_sql as S
from duelframe.plans import logs_sql, sample_logs
from duelframe.session import Scratch, table
from duelframe.sources import crawl, logs

#: Support limits and segment of the registered queries, fit for the size of the test tables.
PAIRS, MATCHES, TEAMS, MONTH_SIDES = 30, 20, 40, 40
SEGMENT = "gen9vgc2024regx"
PLACES = 9


class Tables:
    """The tables of one folder and what is derived from them.

    The scope and the name map are read by several branches of most plans: each is written once to the shared folder when
    it is first asked for. All else is lazy.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.folder = spark, d
        self.battle, self.players, self.slots, self.leads, self.stats, self.overrides, self.fakes = (
            table(spark, d, t) for t in ("battle", "battle_players", "battle_team_slot", "battle_leads", "pokemon_stats", "showdown_overrides", "showdown_non_canonical")
        )

    @functools.cached_property
    def scratch(self) -> Scratch:
        return Scratch(self.spark, "contest")

    @functools.cached_property
    def scope(self) -> DataFrame:
        return self.scratch.save(C.scope(self.battle, self.players))

    @functools.cached_property
    def counts(self) -> DataFrame:
        return Q.split_fakes(Q.name_counts(self.slots.select("pokemon_name"), self.slots.select("species_observed")), self.fakes)[0]

    @functools.cached_property
    def mapping(self) -> tuple[DataFrame, DataFrame]:
        mapped, unmatched = Q.build_mapping(self.scratch.save(self.counts), self.stats, self.overrides, strict=False)
        return self.scratch.save(mapped), unmatched

    @property
    def names(self) -> DataFrame:
        return self.mapping[0]

    @property
    def logs(self) -> DataFrame:
        return sample_logs.composed_logs(self.spark, {"battle": self.battle, "battle_players": self.players, "battle_leads": self.leads, "battle_team_slot": self.slots})

    @property
    def usage(self) -> DataFrame:
        return C.usage(self.slots, self.scope, self.names)

    @property
    def events(self) -> DataFrame:
        """Opening deployments as once-per-side events, labelled by their slot."""
        return self.leads.select("battle_id", "username", "species", F.concat(F.lit("slot"), F.col("lead_slot").cast("string")).alias("label"), "lead_slot", "pokemon_name")

    @property
    def labels(self) -> DataFrame:
        return C.event_labels(self.firsts, self.names)

    @property
    def firsts(self) -> DataFrame:
        return C.special_events(self.events, self.scope, self.names, [F.col("lead_slot"), F.col("species"), F.col("pokemon_name")])

    @property
    def summary(self) -> DataFrame:
        return C.event_summary(self.labels, self.usage)

    @property
    def monthly(self) -> DataFrame:
        return C.monthly_usage(self.slots, self.scope, self.names)

    def pairs(self) -> DataFrame:
        return C.partners(self.slots, self.scope, self.names, PAIRS)

    def matchups(self) -> DataFrame:
        return C.matchups(self.slots, self.scope, self.names, MATCHES)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LOG_TABLES = {
    "log_battles": "battle", "log_accounts": "players", "log_players": "battle_players", "log_rosters": "battle_team_slot", "log_leads": "battle_leads", "log_moves": "battle_move",
    "log_damage": "battle_damage", "log_kos": "battle_ko", "log_faints": "battle_faint", "log_switches": "battle_switch", "log_weather": "battle_weather", "log_status": "battle_status",
    "log_abilities": "battle_ability", "log_special_events": "battle_tera", "log_field_states": "battle_field_state", "log_errors": "errors",
}


def log_table(name: str) -> Callable[[Tables], DataFrame]:
    """One fact table of the logs that are composed from the contest tables."""
    drop = {"battle_players": "rating_after", "errors": "source_file"}.get(name)
    # tables of several branches read a written state, the others project it
    branched = name in ("battle_team_slot", "battle_damage", "battle_ko")

    def build(t: Tables) -> DataFrame:
        facts = logs.fact_tables(t.logs, t.scratch.save if branched else None)[name]
        return facts.drop(drop) if drop else facts

    return build


def crawl_next(t: Tables) -> DataFrame:
    """What a crawl of one segment would fetch next if it held every fifth second of half a year."""
    listing = t.battle.select(F.col("battle_id").alias("id"), F.col("upload_time").alias("uploadtime"))
    held = listing.where(F.startswith("id", F.lit(SEGMENT)) & F.col("uploadtime").between(1711929600, 1727740800) & (F.col("uploadtime") % 5 == 0)).distinct()
    return crawl.next_ids(listing, held, SEGMENT, 4000)


_BUILD: dict[str, Callable[[Tables], DataFrame]] = {
    "scope_contests": lambda t: C.scope(t.battle, t.players),
    "band_totals": lambda t: C.band_totals(t.scope),
    "usage_share": lambda t: t.usage,
    "usage_unmapped": lambda t: C.unmapped_slots(t.slots, t.scope, t.names),
    "usage_top_n": lambda t: C.top_species(t.usage, SEGMENT, 15).select("species_id", "appearances", "usage_pct", "win_pct", "sent_out_pct", "lead_pct"),
    "species_level": lambda t: C.species_level(t.usage),
    "pair_lift": lambda t: t.pairs(),
    "pair_partners_of": lambda t: C.partners_of(t.pairs(), SEGMENT, 1, 10).select("partner_id", "teams_both", "share_pct"),
    "pair_top": lambda t: E.top_pairs(t.pairs(), SEGMENT, TEAMS, 10),
    "matchup_log5": lambda t: t.matchups(),
    "matchup_antisymmetry": lambda t: C.asymmetric_matchups(t.matchups()),
    "matchup_extremes": lambda t: C.opponents_of(t.matchups(), SEGMENT, 1, min_battles=25, n=8).select("end", "species_b_id", "battles", "win_rate", "win_rate_vs_expected"),
    "matchup_spread": lambda t: E.matchup_spread(t.matchups(), 25),
    "monthly_totals": lambda t: C.monthly_totals(t.scope),
    "monthly_trend": lambda t: t.monthly,
    "species_trend": lambda t: C.species_trend(t.monthly, SEGMENT, 1).select("month", "appearances", "wins", "usage_share"),
    "dim_segment": lambda t: C.dim_regulation(t.scope),
    "dim_band": lambda t: C.dim_rating_band(t.spark),
    "dim_month": lambda t: C.dim_month(t.scope).withColumn("month_start", F.col("month_start").cast("string")),
    "dim_item": lambda t: C.dim_species(t.names),
    "first_event_attribution": lambda t: t.firsts,
    "event_unattributed": lambda t: C.unattributed_events(t.events, t.scope),
    "event_label_share": lambda t: t.labels.select("regulation", "rating_band", "species_id", "label", "events", "wins", "label_share"),
    "event_top_label": lambda t: C.top_labels(t.labels),
    "event_summary": lambda t: t.summary,
    "label_profile": lambda t: E.label_profile(t.summary, t.labels, 20),
    "concentration": lambda t: E.concentration(t.usage),
    "rank_stability": lambda t: E.stability(t.monthly, 30, MONTH_SIDES),
    "popularity_vs_success": lambda t: E.popularity_vs_success(t.usage, TEAMS),
    "popularity_by_band": lambda t: E.popularity_by_band(t.usage, [X.ALL_BANDS, X.LOWEST_BAND, "1200_1399"], TEAMS, 10),
    "band_shift": lambda t: E.band_shift(t.usage, SEGMENT, X.LOWEST_BAND, "1200_1399", 10, 8).select("end", "species_id", "shift_pp"),
    "name_normalize": lambda t: t.counts.select("showdown_name", X.slug(F.col("showdown_name")).alias("slug")),
    "name_mapping": lambda t: t.names,
    "name_unmatched": lambda t: t.mapping[1],
    "name_suggestions": lambda t: Q.suggestions(t.mapping[1], t.stats),
    "mapping_coverage": lambda t: Q.coverage(*t.mapping),
    "side_coverage": lambda t: Q.side_coverage(t.slots, t.players),
    "masked_resolution": lambda t: Q.resolve_masked(t.slots, t.players, t.events.select("battle_id", "username", F.col("species").alias("pokemon_name"))),
    "masked_summary": lambda t: Q.resolution_summary(Q.resolve_masked(t.slots, t.players, t.events.select("battle_id", "username", F.col("species").alias("pokemon_name")))),
    "lead_profile": lambda t: Q.species_profile(t.leads),
    "name_probe": lambda t: Q.probe_values(t.leads, "species", "klo"),
    "sent_out_histogram": lambda t: Q.sent_out_histogram(t.slots),
    "id_collisions": lambda t: Q.id_collisions(t.battle, "battle_id", "replay_path"),
    "first_per_id": lambda t: Q.first_per_id(t.battle, "battle_id", [F.col("loaded_at"), F.col("turn_count")])[1],
    "item_similarity": lambda t: similarity.most_similar(similarity.train(similarity.corpus(t.slots)), "Nioholkrir", 20),
    **{query: log_table(name) for query, name in LOG_TABLES.items()},
    "log_complete": lambda t: t.logs.select("battle_id", D.is_complete(F.col("log")).alias("complete")),
    "masked_resolvability": lambda t: D.resolvability(D.masked_slots(t.logs)),
    "detail_frequency": lambda t: D.detail_frequency(t.logs, "klo"),
    "packed_team": lambda t: t.logs.select("battle_id", F.explode(D._pairs(D.SHOWN)).alias("s")).select("battle_id", "s.side", F.array_join(D.packed_species(F.col("s.text")), ";").alias("species")),
    "edge_contests": lambda t: Q.without_edge_contests(t.slots.where("battle_id IS NOT NULL").withColumn("month", F.date_format("loaded_at", "yyyy-MM")), "month", [F.col("loaded_at"), F.col("battle_id")]).groupBy("month").agg(F.count(F.lit(1)).alias("rows")),
    "listed_contests": lambda t: Q.of_contests(t.slots, t.battle.where("turn_count = 0")).groupBy("battle_id").agg(F.count(F.lit(1)).alias("rows")),
    "rows_per_contest": lambda t: Q.rows_per_contest(t.players),
    "odd_ratings": lambda t: Q.odd_ratings(t.players, 1000),
    "coverage_gate": lambda t: Q.coverage_gate(Q.side_coverage(t.slots, t.players)),
    "first_rows": lambda t: Q.first_rows(t.battle.select("format_id", "battle_id", "loaded_at").distinct(), "format_id", [F.col("loaded_at"), F.col("battle_id")], 3),
    "first_contests": lambda t: Q.first_contests(t.slots.where("battle_id IS NOT NULL"), 50).groupBy("battle_id").agg(F.count(F.lit(1)).alias("rows")),
    "invariants": lambda t: Q.invariants(t.usage, t.pairs(), t.matchups(), t.summary).where("NOT holds").select("invariant"),
    "item_corpus": lambda t: similarity.corpus(t.slots).select("battle_id", "player_side", F.array_join("team", ";").alias("team")),
    "crawl_next": lambda t: crawl_next(t),
    "rating_histogram": lambda t: t.players.where("rating_before IS NOT NULL").groupBy((F.floor(F.col("rating_before") / 100) * 100).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("sides")),
}


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rounded(build(Tables(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(build) for name, build in _BUILD.items()}
SQL: dict[str, str] = {**S.SQL, **logs_sql.SQL}
