"""Registered queries of the master tables, saved teams and text helpers, with equivalent SQL.

The contest tables hold no master data but the canonical list, so the other master tables are derived from it by plain SQL that
both engines run; the operators themselves are DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions import contest as X
from duelframe.operators import master as M
from duelframe.session import table

_SOURCES = """
types AS (SELECT * FROM (VALUES (1, 'normal'), (2, 'fire'), (3, 'water'), (4, 'grass'), (5, 'steel'), (6, 'fairy')) AS t(type_id, type)),
stats AS (
  SELECT poke_id, pokemon, CAST(40 + poke_id % 97 AS INT) AS hp, CAST(30 + poke_id % 71 AS INT) AS atk, CAST(35 + poke_id % 53 AS INT) AS def, CAST(20 + poke_id % 89 AS INT) AS spatk,
    CAST(25 + poke_id % 61 AS INT) AS spdef, CAST(15 + poke_id % 101 AS INT) AS spe FROM {pokemon_stats}),
pokemon_types AS (
  SELECT poke_id AS pokemon_id, 1 AS slot, CAST(poke_id % 6 + 1 AS INT) AS type_id FROM stats WHERE poke_id % 11 <> 0
  UNION ALL SELECT poke_id, 2, CAST((poke_id + 2) % 7 + 1 AS INT) FROM stats WHERE poke_id % 3 = 0),
moves AS (
  SELECT * FROM (VALUES (1, 'tackle', 40, 1, 1), (2, 'ember', 40, 2, 2), (3, 'surf', 90, 3, 2), (4, 'growth', NULL, 4, 3), (5, 'iron head', 80, 5, 1), (6, 'lost move', 10, 9, 1)) AS t(move_id, move_name, power, type_id, damage_class_id)),
damage_classes AS (SELECT * FROM (VALUES (1, 'physical'), (2, 'special'), (3, 'status')) AS t(damage_class_id, damage_class)),
methods AS (SELECT * FROM (VALUES (1, 'level-up'), (2, 'machine'), (3, 'egg')) AS t(learn_method_id, learn_method)),
pokemon_moves AS (
  SELECT s.poke_id AS pokemon_id, m.move_id, CAST((s.poke_id + m.move_id) % 4 + 1 AS INT) AS learn_method, CAST((s.poke_id * 7 + m.move_id) % 50 AS INT) AS level_learned
  FROM stats s JOIN moves m ON (s.poke_id + m.move_id) % 3 = 0),
ability_names AS (SELECT * FROM (VALUES (1, 'Flash Fire'), (2, ' Mold_Breaker '), (3, 'intimidate')) AS t(ability_id, ability_name)),
pokemon_abilities AS (SELECT poke_id AS pokemon_id, CAST(poke_id % 4 + 1 AS INT) AS abi_id, poke_id % 2 = 0 AS hidden_abi FROM stats),
chart AS (SELECT a.type_id AS attack_type_id, b.type_id AS defense_type_id, CASE WHEN a.type_id = b.type_id THEN 0.5D WHEN (a.type_id + b.type_id) % 4 = 0 THEN 2.0D ELSE 1.0D END AS multiplier FROM types a JOIN types b ON a.type_id <= b.type_id + 3)
"""
_DUCK = _SOURCES.replace("{pokemon_stats}", "pokemon_stats").replace("0.5D", "0.5::DOUBLE").replace("2.0D", "2.0::DOUBLE").replace("1.0D", "1.0::DOUBLE")

_ROSTER = "battle_id IS NOT NULL AND player_side IS NOT NULL AND slot_no IS NOT NULL AND pokemon_name IS NOT NULL"
_FLAT = f"""
WITH r AS (SELECT DISTINCT battle_id || '/' || player_side AS team_name, CAST(slot_no AS INTEGER) AS s, pokemon_name FROM battle_team_slot WHERE {_ROSTER}),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY team_name ORDER BY s, pokemon_name) AS INTEGER) AS slot FROM r),
f AS (
  SELECT team_name, slot, pokemon_name, 'ability ' || CAST(length(pokemon_name) % 5 AS VARCHAR) AS ability, CASE WHEN s <> 2 THEN 'item-' || CAST(s AS VARCHAR) END AS item, 'calm' AS nature, 50 AS level,
    s * 4 AS ev, 31 - s AS iv, CASE WHEN s = 5 THEN [] ELSE ['move ' || CAST(s % 3 AS VARCHAR), 'move ' || CAST(length(pokemon_name) % 4 AS VARCHAR)] END AS moves FROM m)
"""
_EV = ", ".join(f"ev AS {s}_ev" for s in M.STATS)
_IV = ", ".join(f"iv AS {s}_iv" for s in M.STATS)


def _master(spark: SparkSession, d: str) -> Callable[[str], DataFrame]:
    stats = table(spark, d, "pokemon_stats")
    return lambda name: spark.sql(f"WITH {_SOURCES} SELECT * FROM {name}", pokemon_stats=stats)


def _teams(spark: SparkSession, d: str) -> DataFrame:
    """Rosters as nested saved teams."""
    rows = table(spark, d, "battle_team_slot").where(_ROSTER).select(F.concat("battle_id", F.lit("/"), "player_side").alias("team_name"), F.col("slot_no").cast("int").alias("s"), "pokemon_name").distinct()
    size = F.length("pokemon_name")
    spread = lambda value: F.struct(*[value.alias(s) for s in M.STATS])
    moves = F.when(F.col("s") == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("move "), (F.col("s") % 3).cast("string")), F.concat(F.lit("move "), (size % 4).cast("string"))))
    member = F.struct(
        F.col("pokemon_name").alias("pokemon"), F.concat(F.lit("ability "), (size % 5).cast("string")).alias("ability"), F.when(F.col("s") != 2, F.concat(F.lit("item-"), F.col("s").cast("string"))).alias("item"),
        F.lit("calm").alias("nature"), F.when(F.col("s") != 3, 50).alias("level"), moves.alias("moves"), spread(31 - F.col("s")).alias("ivs"), spread(F.col("s") * 4).alias("evs"),
    )
    rows = rows.groupBy("team_name").agg(F.array_sort(F.collect_list(F.struct("s", "pokemon_name", member.alias("m")))).alias("l"))
    return rows.select("team_name", F.transform("l", lambda x: x["m"]).alias("members"))


def master_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _master(spark, d)
    return M.with_types(t("stats"), t("pokemon_types"), t("types"))


def master_learnset(spark: SparkSession, d: str) -> DataFrame:
    t = _master(spark, d)
    return M.learnset(t("stats"), t("pokemon_moves"), t("moves"), t("methods"))


def master_abilities(spark: SparkSession, d: str) -> DataFrame:
    t = _master(spark, d)
    return M.abilities(t("stats"), t("pokemon_abilities"), t("ability_names"))


def master_moves(spark: SparkSession, d: str) -> DataFrame:
    t = _master(spark, d)
    return M.move_data(t("moves"), t("types"), t("damage_classes"))


def master_type_chart(spark: SparkSession, d: str) -> DataFrame:
    t = _master(spark, d)
    return M.type_chart(t("chart"), t("types"))


def master_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = _master(spark, d)
    return M.first_of_key(master_abilities(spark, d), [F.col("pokemon")], ability_name="Flash Fire").unionByName(M.first_of_key(M.abilities(t("stats"), t("pokemon_abilities"), t("ability_names")), [F.col("pokemon")], pokemon="no such name"))


def team_tables(spark: SparkSession, d: str) -> DataFrame:
    """How many rows the five flat tables of all saved teams have."""
    out = None
    for name, rows in M.flat_teams(_teams(spark, d)).items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def team_members(spark: SparkSession, d: str) -> DataFrame:
    return M.team_members(M.flat_teams(_teams(spark, d))).withColumn("moves", F.array_join("moves", ";"))


def team_nested(spark: SparkSession, d: str) -> DataFrame:
    """The teams after a round trip through the flat tables."""
    teams = M.nested_teams(M.team_members(M.flat_teams(_teams(spark, d))))
    part = lambda f: F.array_join(F.transform("members", f), ";")
    return teams.select("team_name", F.size("members").alias("members"), part(lambda m: m["pokemon"]).alias("names"), part(lambda m: m["ivs"]["spe"].cast("string")).alias("ivs"), part(lambda m: F.size(m["moves"]).cast("string")).alias("moves"))


def team_text(spark: SparkSession, d: str) -> DataFrame:
    return M.member_text(M.team_members(M.flat_teams(_teams(spark, d))).withColumn("pokemon_name", F.lit("sample name"))).select("team_name", "slot", "text")


def text_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ability slugs, plain ids, ids of urls and English texts of all canonical names."""
    name = F.col("pokemon")
    entry = lambda lang, text: F.struct(F.lit(lang).alias("language"), text.alias("short_effect"))
    even = F.col("poke_id") % 2 == 0
    entries = F.when(even, F.array(entry("fr", name), entry("en", F.when(F.col("poke_id") % 4 == 0, name)), entry("en", F.lit("later")))).otherwise(F.array(entry("de", name)))
    url = F.concat(F.lit("https://host/api/"), F.when(even, F.col("poke_id").cast("string")).otherwise("none"), F.lit("//"))
    return table(spark, d, "pokemon_stats").select(
        "poke_id", X.ability_slug(F.concat(F.lit(" "), F.initcap(F.translate(name, "-", "_")))).alias("ability"), X.id_string(F.initcap(name)).alias("ident"), X.id_of_url(url).alias("url_id"), X.english_text(entries).alias("english")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (master_stats, master_learnset, master_abilities, master_moves, master_type_chart, master_lookup, team_tables, team_members, team_nested, team_text, text_ids)
}
_ABILITIES = "SELECT s.pokemon, n.ability_name, a.hidden_abi FROM pokemon_abilities a JOIN stats s ON a.pokemon_id = s.poke_id JOIN ability_names n ON a.abi_id = n.ability_id"
SQL: dict[str, str] = {
    "master_stats": f"WITH {_DUCK} SELECT s.poke_id, s.pokemon, max(CASE WHEN p.slot = 1 THEN t.type END) AS type_1, max(CASE WHEN p.slot = 2 THEN t.type END) AS type_2, s.hp, s.atk, s.def, s.spatk, s.spdef, s.spe FROM stats s LEFT JOIN pokemon_types p ON s.poke_id = p.pokemon_id LEFT JOIN types t ON p.type_id = t.type_id GROUP BY ALL",
    "master_learnset": f"WITH {_DUCK} SELECT s.pokemon, m.move_name, x.learn_method, l.level_learned FROM pokemon_moves l JOIN stats s ON l.pokemon_id = s.poke_id JOIN moves m ON l.move_id = m.move_id JOIN methods x ON l.learn_method = x.learn_method_id",
    "master_abilities": f"WITH {_DUCK} {_ABILITIES}",
    "master_moves": f"WITH {_DUCK} SELECT m.move_name, m.power, t.type, c.damage_class FROM moves m JOIN types t USING (type_id) JOIN damage_classes c USING (damage_class_id)",
    "master_type_chart": f"WITH {_DUCK} SELECT a.type AS attack_type, b.type AS defense_type, c.multiplier FROM chart c JOIN types a ON c.attack_type_id = a.type_id JOIN types b ON c.defense_type_id = b.type_id",
    "master_lookup": f"WITH {_DUCK} SELECT * FROM ({_ABILITIES}) WHERE ability_name = 'Flash Fire' ORDER BY pokemon LIMIT 1",
    "team_tables": _FLAT + """
SELECT 'team_master' AS name, count(DISTINCT team_name) AS rows FROM f UNION ALL SELECT 'team_pokemon', count(*) FROM f UNION ALL SELECT 'team_pokemon_evs', count(*) FROM f
UNION ALL SELECT 'team_pokemon_ivs', count(*) FROM f UNION ALL SELECT 'team_pokemon_moves', CAST(sum(len(moves)) AS BIGINT) FROM f""",
    "team_members": _FLAT + f"SELECT team_name, slot, pokemon_name, ability, item, nature, level, {_EV}, {_IV}, array_to_string(moves, ';') AS moves FROM f",
    "team_nested": _FLAT + "SELECT team_name, CAST(count(*) AS INTEGER) AS members, string_agg(pokemon_name, ';' ORDER BY slot) AS names, string_agg(CAST(iv AS VARCHAR), ';' ORDER BY slot) AS ivs, string_agg(CAST(len(moves) AS VARCHAR), ';' ORDER BY slot) AS moves FROM f GROUP BY team_name",
    "team_text": _FLAT + r"""
SELECT team_name, slot, concat(chr(10), 'Sample Name @ ', CASE WHEN item IS NULL THEN 'None' ELSE item END, chr(10), 'Ability: ', ability, chr(10), 'Level: 50', chr(10), 'Calm Nature', chr(10), chr(10), 'EVs:', chr(10),
  array_to_string(list_transform(['HP ', 'Atk', 'Def', 'SpA', 'SpD', 'Spe'], lambda n: n || ' ' || CAST(ev AS VARCHAR)), chr(10)), chr(10), chr(10), 'Moves:', chr(10), array_to_string(list_transform(moves, lambda m: chr(10) || '- ' || m), '')) AS text FROM f""",
    "text_ids": """
SELECT poke_id, replace(lower(pokemon), '_', '-') AS ability, regexp_replace(lower(pokemon), '[^a-z0-9]', '', 'g') AS ident, CASE WHEN poke_id % 2 = 0 THEN CAST(poke_id AS INTEGER) END AS url_id,
  CASE WHEN poke_id % 4 = 0 THEN pokemon WHEN poke_id % 2 = 0 THEN '' END AS english FROM pokemon_stats""",
}
