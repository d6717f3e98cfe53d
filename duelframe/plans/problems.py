"""Registered queries of the general problems (references, drifting schemas)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators import drift, drift_sql, orphans_sql, references
from duelframe.session import Scratch, table

#: Fields of the slot feed that were approved for typed columns.
APPROVED = {"level": "int", "gender": "string", "is_shiny": "boolean", "nickname": "string", "rev": "int"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.contest_orphans(*(table(spark, d, t) for t in ("battle_team_slot", "battle_players", "battle", "players")))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(p1_found(spark, d))


def p1_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys that are referred to and do not exist now, from the counts that the ledger keeps."""
    ledger = references.ReferenceLedger(spark, f"{Scratch(spark, 'p1').root}/ledger")
    ledger.advance(references.contest_deltas(*(table(spark, d, t) for t in ("battle_team_slot", "battle_players", "battle", "players"))), "all")
    return ledger.orphans().select("level", "space", "k1", "k2", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_record"))


def _ingested(spark: SparkSession, d: str, name: str) -> DataFrame:
    return drift.Ingestion(table(spark, d, "raw_record")).replayed(name, APPROVED)


def p2_leads(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d, "battle_leads")


def p2_slots(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d, "battle_team_slot")


def _values(spark: SparkSession, d: str, name: str) -> DataFrame:
    return drift.Ingestion(table(spark, d, "raw_record")).replayed(name, {}).select("feed", "file_no", "line_no", *drift.LAYOUTS[name])


def p2_lead_values(spark: SparkSession, d: str) -> DataFrame:
    """The typed columns alone, without what stays rescued."""
    return _values(spark, d, "battle_leads")


def p2_slot_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d, "battle_team_slot")


def p2_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("table_name", "field", "change_kind").agg(F.count(F.lit(1)).alias("files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_counts, p1_keys, p2_found, p2_leads, p2_slots, p2_lead_values, p2_slot_values, p2_change_counts)
}
SQL = {
    "p1_found": orphans_sql.FOUND, "p1_counts": orphans_sql.COUNTS, "p1_keys": orphans_sql.KEYS, "p2_found": drift_sql.FOUND, "p2_change_counts": drift_sql.COUNTS,
    "p2_lead_values": drift_sql.values("battle_leads", drift.LAYOUTS["battle_leads"]), "p2_slot_values": drift_sql.values("battle_team_slot", drift.LAYOUTS["battle_team_slot"]),
}
