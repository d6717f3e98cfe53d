"""Logs composed from the contest tables, for the log queries: one text of plain SQL that both engines run.

Every battle with leads plays up to twelve turns of moves, damage, faints, switches, weather and so on by fixed rules, with
the odd cases of the line rules: short lines, padded and blank users, a replacement at turn 0, attackers that have
left, damage by nothing known, upkeep, lines after the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TURNS = ", ".join(f"({t})" for t in range(1, 13))

#: Lines of one turn in order: number, condition, text. a, b stand at p1a, p1b and c, d at p2a, p2b; sa is the species of a.
_TURN_LINES = (
    (0, "true", "'|turn|' || CAST(t AS STRING)"),
    (1, "a IS NOT NULL AND c IS NOT NULL", "'|move|p1a: ' || a || '|Move ' || CAST(t % 7 AS STRING) || '|p2a: ' || c || CASE WHEN t % 4 = 0 THEN '|[miss] ' ELSE '' END"),
    (2, "c IS NOT NULL", "'|-damage|p2a: ' || c || '|' || CASE WHEN t % 5 = 4 THEN '0 fnt' ELSE CAST(100 - t * 7 AS STRING) || '/100' END"),
    (3, "c IS NOT NULL AND t % 5 = 4", "'|faint|p2a: ' || c"),
    (4, "t % 5 = 4", "'|switch|p2a: R' || CAST(t AS STRING) || '|Reserve-' || CAST(t AS STRING) || ', L50|' || CAST(60 + t AS STRING) || '/100'"),
    (5, "b IS NOT NULL AND d IS NOT NULL AND t % 3 = 0", "'|move|p2b: ' || d || '|Stealth Rock|p1b: ' || b"),
    (6, "b IS NOT NULL AND c IS NOT NULL AND t % 3 = 0", "'|-damage|p1b: ' || b || '|' || CAST(90 - t * 4 AS STRING) || '/100|[from] item: Orb|[of] p2a: ' || c"),
    (7, "d IS NOT NULL AND t % 5 = 2", "'|-weather|RainDance|[from] ability: Drizzle|[of] p2b: ' || d"),
    (8, "t % 5 = 3", "'|-weather|RainDance|[upkeep]'"),
    (9, "t % 10 = 1", "'|-weather|none'"),
    (10, "a IS NOT NULL AND t % 6 = 1", "'|-status|p1a: ' || a || '|brn '"),
    (11, "a IS NOT NULL AND t % 6 = 2", "'|-status|p1a: ' || a"),
    (12, "d IS NOT NULL AND t % 7 = 3", "'|-ability|p2b: ' || d || '|Intimidate|boost'"),
    (13, "b IS NOT NULL AND t = 2", "'|-terastallize|p1b: ' || b || '| Fire'"),
    (14, "a IS NOT NULL AND t = 3", "'|detailschange|p1a: ' || a || '|' || sa || '-Mega, L50'"),
    (15, "c IS NOT NULL AND t % 4 = 1", "'|-heal|p2a: ' || c || '|55/100'"),
    (16, "t % 6 = 5", "'|drag|p1b: Extra|Extra-Form, M|80/100'"),
    (17, "a IS NOT NULL AND t IN (6, 7)", "'|-fail|p1a: ' || a"),
    (18, "a IS NOT NULL AND t = 9", "'|-damage|p1a: ' || a || '|0 fnt|[from] psn'"),
    (19, "a IS NOT NULL AND t = 9", "'|faint|p1a: ' || a"),
    (20, "b IS NOT NULL AND t = 10", "'|-damage|p1b: ' || b || '|??'"),
    (21, "b IS NOT NULL AND t = 11", "'|-damage|p1b: ' || b || '|44'"),
)

_TURN = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {when} THEN {text} END" for _, when, text in _TURN_LINES) + ")"

#: Common table expressions up to `logs` (battle_id, replay_path, uploadtime, rating, log); {name} stands for tables, {joined} and {packed} for the text of the lines and of the members in order.
COMPOSE = f"""
b AS (
  SELECT battle_id, max(format) AS format, max(upload_time) AS upload_time, max(winner_name) AS winner, max(rating) AS rating, max(replay_path) AS replay_path,
    least(coalesce(max(turn_count), 0), 12) AS turns
  FROM {{battle}} WHERE battle_id IS NOT NULL GROUP BY battle_id),
p AS (SELECT DISTINCT battle_id, lower(trim(side)) AS side, username, rating_before FROM {{battle_players}} WHERE battle_id IS NOT NULL AND lower(trim(side)) IN ('p1', 'p2')),
own AS (SELECT battle_id, username, min(side) AS side FROM p WHERE username IS NOT NULL GROUP BY battle_id, username),
l AS (
  SELECT DISTINCT x.battle_id, o.side, CASE WHEN x.lead_slot = 1 THEN 'a' ELSE 'b' END AS letter, x.pokemon_name AS nick, coalesce(x.species, '') AS species
  FROM {{battle_leads}} x JOIN own o ON x.battle_id = o.battle_id AND x.username = o.username WHERE x.lead_slot IN (1, 2) AND x.pokemon_name IS NOT NULL),
n AS (
  SELECT battle_id, max(CASE WHEN side = 'p1' AND letter = 'a' THEN nick END) AS a, max(CASE WHEN side = 'p1' AND letter = 'b' THEN nick END) AS b,
    max(CASE WHEN side = 'p2' AND letter = 'a' THEN nick END) AS c, max(CASE WHEN side = 'p2' AND letter = 'b' THEN nick END) AS d,
    max(CASE WHEN side = 'p1' AND letter = 'a' THEN species END) AS sa
  FROM l GROUP BY battle_id),
t AS (SELECT b.battle_id, s.t, n.a, n.b, n.c, n.d, n.sa FROM b JOIN n ON b.battle_id = n.battle_id JOIN (VALUES {_TURNS}) AS s(t) ON s.t <= b.turns),
sl AS (
  SELECT DISTINCT battle_id, lower(trim(player_side)) AS side, CAST(slot_no AS INT) AS slot_no, CASE WHEN slot_no % 2 = 0 THEN pokemon_name || '||item' ELSE replace(pokemon_name, '-*', '') || '|' || coalesce(species_observed, '') || '|item' END AS mon
  FROM {{battle_team_slot}} WHERE battle_id IS NOT NULL AND pokemon_name IS NOT NULL AND slot_no IS NOT NULL AND lower(trim(player_side)) IN ('p1', 'p2')),
lines AS (
  SELECT battle_id, 0 AS part, 0 AS k, concat_ws(chr(10), CASE WHEN upload_time % 2 = 0 THEN '|t:|' || CAST(upload_time AS STRING) END, '|tier|' || format, CASE WHEN rating % 3 = 0 THEN '|rated|' || CAST(rating AS STRING) END) AS line FROM b
  UNION ALL SELECT battle_id, 1, 0, '|player|' || side || '|' || coalesce(username, '') || ' |12|' || coalesce(CAST(rating_before AS STRING), '') || chr(10) || '|player|' || side || '|' FROM p
  UNION ALL SELECT DISTINCT battle_id, 2, CAST(slot_no AS INT), '|poke|' || CASE WHEN slot_no = 7 THEN 'p9' ELSE lower(trim(player_side)) END || '|' || pokemon_name || ', L50|item'
    FROM {{battle_team_slot}} WHERE battle_id IS NOT NULL AND pokemon_name IS NOT NULL AND slot_no IS NOT NULL AND lower(trim(player_side)) IN ('p1', 'p2')
  UNION ALL SELECT battle_id, 2, 9, concat_ws(chr(10), '|poke|p1', CASE WHEN turns = 11 THEN '|poke|p7|Stray|' END) FROM b
  UNION ALL SELECT battle_id, 2, 20, '|showteam|' || side || '|' || {{packed}} FROM sl WHERE slot_no % 5 <> 4 GROUP BY battle_id, side
  UNION ALL SELECT battle_id, 2, 21, concat_ws(chr(10), CASE WHEN turns <> 9 THEN '|' END, '|teampreview|4', CASE WHEN turns <> 10 THEN '|start' END) FROM b
  UNION ALL SELECT battle_id, 5, 0, '|switch|' || side || letter || ': ' || nick || '|' || species || ', L50, M|100/100' FROM l
  UNION ALL SELECT battle_id, 6, 0, '|drag|p1a: Early|Early, L50|77/100' FROM b WHERE turns % 4 = 3
  UNION ALL SELECT battle_id, 10 + t, 0, {_TURN} FROM t
  UNION ALL SELECT battle_id, 90, 0, concat_ws(chr(10), coalesce('|win| ' || winner || ' ', '|tie'), '|move|p1a: Late|Late|p2a: Late', '|player|p1|Late|1|9') FROM b),
whole AS (SELECT battle_id, {{joined}} AS log FROM lines WHERE battle_id IN (SELECT battle_id FROM b) GROUP BY battle_id),
logs AS (
  SELECT b.battle_id, b.replay_path, CAST(b.upload_time AS DOUBLE) AS uploadtime, b.rating + 0.5 AS rating, whole.log FROM b JOIN whole ON b.battle_id = whole.battle_id)
"""
TABLES = ("battle", "battle_players", "battle_leads", "battle_team_slot")


def composed_logs(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(battle_id, replay_path, uploadtime, rating, log)."""
    text = "array_join(transform(array_sort(collect_list(struct(part, k, line))), x -> x.line), chr(10))"
    packed = "array_join(transform(array_sort(collect_list(struct(slot_no, mon))), x -> x.mon), ']')"
    names = {t: "{" + t + "}" for t in TABLES}
    return spark.sql("WITH " + COMPOSE.format(joined=text, packed=packed, **names) + "SELECT * FROM logs", **{t: tables[t] for t in TABLES})
