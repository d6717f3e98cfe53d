"""Registered queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import arrivals, cooccur, glyphs, leaks, mixing, naming, queries_sql, ranking
from duelframe.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.strongest(table(spark, d, "battle_players"))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every username with games, strength and spread."""
    return ranking.PairedComparison(ranking.pair_table(ranking.decided_battles(table(spark, d, "battle_players")))).fit().withColumnRenamed("item", "username")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return arrivals.found(table(spark, d, "battle"), table(spark, d, "battle_arrival"))


def p4_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Every arrival, whether it is new, and what it repeats."""
    rows = table(spark, d, "battle_arrival")
    return rows.select("row_id", "batch_no").distinct().join(arrivals.found(table(spark, d, "battle"), rows), "row_id", "left").withColumn("is_new", F.col("first_battle_id").isNull())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.found(table(spark, d, "battle_team_slot"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with their counts and scores."""
    pairs = cooccur.scored(cooccur.pair_counts(cooccur.roster_items(table(spark, d, "battle_team_slot"))))
    return pairs.select("name_a", "name_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return naming.found(*(table(spark, d, t) for t in ("battle_team_slot", "pokemon_stats", "showdown_overrides", "showdown_non_canonical")))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).where("pokemon = ''").select("field", "entered")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that give it away."""
    n = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "eval_item").select("item_id").distinct().join(n, "item_id", "left").fillna(0, ["documents"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(*mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_target")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.look_alike_classes(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.consistent_texts(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p3_found, p3_ranking, p4_found, p4_arrivals, p5_found, p5_pairs, p6_found, p6_unmatched, p7_found, p7_items, p8_found, p8_mix, p8_shares, p9_found, p9_classes, p9_forms)
}
SQL: dict[str, str] = queries_sql.SQL
