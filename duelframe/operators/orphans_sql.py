"""Reference SQL of the orphan report: nested look-ups over the whole tables."""

BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8203) || chr(12288) || chr(65279)"

_KEYED = f"""
WITH s AS (SELECT DISTINCT battle_id, player_side, slot_no, loaded_at, nullif(lower(trim(battle_id, {BLANKS})), '') AS bk, nullif(lower(trim(player_side, {BLANKS})), '') AS sk FROM battle_team_slot),
p AS (SELECT DISTINCT battle_id, side, username, loaded_at, nullif(lower(trim(battle_id, {BLANKS})), '') AS bk, nullif(lower(trim(side, {BLANKS})), '') AS sk, nullif(lower(trim(username, {BLANKS})), '') AS uk FROM battle_players),
b AS (SELECT DISTINCT nullif(lower(trim(battle_id, {BLANKS})), '') AS k, loaded_at, deleted_at FROM battle),
u AS (SELECT DISTINCT nullif(lower(trim(username, {BLANKS})), '') AS k, loaded_at, deleted_at FROM players),
r AS (
  SELECT 'battle_team_slot' AS table_name, 'battle_id' AS field, s.battle_id, s.player_side, CAST(s.slot_no AS INTEGER) AS slot_no, s.loaded_at,
    count(b.k) AS records, count(*) FILTER (WHERE b.loaded_at <= s.loaded_at) AS loaded,
    count(*) FILTER (WHERE b.loaded_at <= s.loaded_at AND (b.deleted_at IS NULL OR s.loaded_at < b.deleted_at)) AS in_force
  FROM s LEFT JOIN b ON s.bk = b.k WHERE s.bk IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'battle_team_slot', 'player_side', s.battle_id, s.player_side, CAST(s.slot_no AS INTEGER), s.loaded_at,
    count(p.bk), count(*) FILTER (WHERE p.loaded_at <= s.loaded_at), count(*) FILTER (WHERE p.loaded_at <= s.loaded_at)
  FROM s LEFT JOIN p ON s.bk = p.bk AND s.sk = p.sk WHERE s.bk IS NOT NULL AND s.sk IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'battle_players', 'username', p.battle_id, p.side, 0, p.loaded_at,
    count(u.k), count(*) FILTER (WHERE u.loaded_at <= p.loaded_at),
    count(*) FILTER (WHERE u.loaded_at <= p.loaded_at AND (u.deleted_at IS NULL OR p.loaded_at < u.deleted_at))
  FROM p LEFT JOIN u ON p.uk = u.k WHERE p.uk IS NOT NULL GROUP BY p.battle_id, p.side, p.loaded_at, p.uk
),
o AS (
  SELECT DISTINCT table_name, field, strftime(loaded_at, '%Y-%m') AS period, battle_id, player_side, slot_no,
    CASE WHEN records = 0 THEN 'missing' WHEN loaded = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM r WHERE in_force = 0
)
"""

FOUND = _KEYED + "SELECT * FROM o"
COUNTS = _KEYED + "SELECT table_name, field, period, reason, count(*) AS orphans FROM o GROUP BY 1, 2, 3, 4"
KEYS = f"""
WITH ref AS (
  SELECT 'a' AS level, 'battle' AS space, nullif(lower(trim(battle_id, {BLANKS})), '') AS k1, NULL AS k2 FROM battle_team_slot
  UNION SELECT 'b', 'battle', nullif(lower(trim(battle_id, {BLANKS})), ''), coalesce(nullif(lower(trim(player_side, {BLANKS})), ''), '?none') FROM battle_team_slot
  UNION SELECT 'a', 'user', nullif(lower(trim(username, {BLANKS})), ''), NULL FROM battle_players),
rec AS (
  SELECT 'a' AS level, 'battle' AS space, nullif(lower(trim(battle_id, {BLANKS})), '') AS k1, NULL AS k2, loaded_at, deleted_at FROM battle
  UNION ALL SELECT 'b', 'battle', nullif(lower(trim(battle_id, {BLANKS})), ''), nullif(lower(trim(side, {BLANKS})), ''), loaded_at, NULL FROM battle_players
  UNION ALL SELECT 'a', 'user', nullif(lower(trim(username, {BLANKS})), ''), NULL, loaded_at, deleted_at FROM players),
st AS (
  SELECT ref.level, ref.space, ref.k1, ref.k2, count(rec.k1) AS records, count(*) FILTER (WHERE rec.loaded_at IS NOT NULL AND rec.deleted_at IS NULL) AS alive
  FROM ref LEFT JOIN rec ON ref.level = rec.level AND ref.space = rec.space AND ref.k1 = rec.k1 AND ref.k2 IS NOT DISTINCT FROM rec.k2
  WHERE ref.k1 IS NOT NULL AND ref.k2 IS DISTINCT FROM '?none' GROUP BY ALL)
SELECT level, space, k1, k2, CASE WHEN records = 0 THEN 'missing' ELSE 'deleted' END AS reason FROM st WHERE alive = 0"""
