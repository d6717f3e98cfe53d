"""Reference SQL of the log tables: composes the same logs and reads them with as-of joins instead of windows."""

from duelframe.plans.sample_logs import COMPOSE, TABLES

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202)"


def _w(text: str) -> str:
    return f"trim({text}, {_WHITE})"


def _nick(raw: str) -> str:
    return _w(f"regexp_replace(CASE WHEN position(': ' IN {raw}) > 0 THEN substr({raw}, position(': ' IN {raw}) + 2) ELSE {raw} END, ',\\s*(M|F|shiny|shiny M|shiny F)$', '', 'i')")


def _hp(text: str) -> str:
    t = _w(text)
    part = lambda i: f"try_cast(nullif(regexp_extract({t}, '^(\\d+(?:\\.\\d+)?)/(\\d+(?:\\.\\d+)?)', {i}), '') AS DOUBLE)"
    return f"CASE WHEN {t} IN ('0 fnt', 'fnt', '0') THEN 0.0 WHEN {part(2)} = 0 THEN 0.0 WHEN {part(2)} IS NOT NULL THEN round_even({part(1)} / {part(2)} * 100, 2) ELSE try_cast(nullif(regexp_extract({t}, '^(\\d+(?:\\.\\d+)?)$', 1), '') AS DOUBLE) END"


_LOGS = COMPOSE.format(joined="string_agg(line, chr(10) ORDER BY part, k, line)", packed="string_agg(mon, ']' ORDER BY slot_no, mon)", **{t: t for t in TABLES})
_STATE = f"""
WITH {_LOGS},
ln AS (
  SELECT battle_id, seq, string_split({_w('line')}, '|') AS a FROM (SELECT battle_id, generate_subscripts(string_split(log, chr(10)), 1) AS seq, unnest(string_split(log, chr(10))) AS line FROM logs)
  WHERE starts_with({_w('line')}, '|')),
ph AS (
  SELECT *, a[2] AS token, len(a) AS n,
    coalesce(last_value(CASE WHEN a[2] IN ('start', 'turn') THEN 'battle' WHEN a[2] = 'teampreview' THEN 'preview' WHEN a[2] IN ('win', 'tie') THEN 'post' END IGNORE NULLS)
      OVER (PARTITION BY battle_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'header') AS phase,
    coalesce(last_value(CASE WHEN a[2] = 'turn' THEN try_cast({_w('a[3]')} AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY battle_id ORDER BY seq), 0) AS turn
  FROM ln),
bad AS (SELECT DISTINCT battle_id FROM ph WHERE phase IN ('header', 'preview') AND token = 'poke' AND n >= 4 AND a[3] NOT IN ('p1', 'p2')),
ev AS (
  SELECT battle_id, seq, a, token, n, phase, turn, phase IN ('header', 'preview') AS head, phase = 'battle' AS live, {_w("split_part(a[3], ':', 1)")} AS place, {_nick('a[3]')} AS nick,
    n >= 4 AND ((phase = 'battle' AND token IN ('switch', 'drag')) OR (phase = 'preview' AND token = 'switch')) AS entry, {_w("split_part(a[4], ',', 1)")} AS sp
  FROM ph WHERE battle_id NOT IN (SELECT battle_id FROM bad)),
users AS (
  SELECT battle_id, a[3] AS side, arg_min({_w('a[4]')}, seq) AS username, arg_min(try_cast({_w('a[6]')} AS INTEGER), seq) FILTER (WHERE regexp_matches({_w('a[6]')}, '^-*\\d+$')) AS rating_before, min(seq) AS said
  FROM ev WHERE head AND token = 'player' AND n >= 4 AND {_w('a[4]')} <> '' GROUP BY battle_id, a[3]),
ent AS (SELECT battle_id, seq, place, left(place, 2) AS side, nick, sp, phase, turn, token FROM ev WHERE entry),
sps AS (SELECT battle_id, seq, place, left(place, 2) AS side, nick, sp FROM ev WHERE entry OR (live AND token IN ('detailschange', 'replace') AND n >= 4)),
hps AS (
  SELECT * FROM (SELECT battle_id, seq, place, token, CASE WHEN entry THEN {_hp('a[5]')} ELSE {_hp('a[4]')} END AS hp FROM ev WHERE entry OR (live AND token IN ('-damage', '-heal') AND n >= 4)) WHERE hp IS NOT NULL),
mvs AS (SELECT battle_id, seq, place, left(place, 2) AS side, a[4] AS mv FROM ev WHERE live AND token = 'move' AND n >= 5),
moved AS (SELECT battle_id, place, side, min(seq) AS first FROM mvs GROUP BY ALL),
entered AS (SELECT battle_id, place, min(seq) AS first FROM ent GROUP BY ALL),
who AS (
  SELECT e.*, left(e.place, 2) AS side, coalesce(u.username, '') AS username,
    coalesce(CASE WHEN x.nick = e.nick THEN y.sp END, z.sp, '') AS species
  FROM ev e LEFT JOIN users u ON e.battle_id = u.battle_id AND left(e.place, 2) = u.side AND u.said <= e.seq
    ASOF LEFT JOIN ent x ON e.battle_id = x.battle_id AND e.place = x.place AND e.seq > x.seq
    ASOF LEFT JOIN sps y ON e.battle_id = y.battle_id AND e.place = y.place AND e.seq > y.seq
    ASOF LEFT JOIN sps z ON e.battle_id = z.battle_id AND left(e.place, 2) = z.side AND e.nick = z.nick AND e.seq > z.seq
  WHERE e.live OR e.entry),
opening AS (SELECT battle_id, seq, row_number() OVER (PARTITION BY battle_id, place ORDER BY seq) = 1 AS lead FROM ent WHERE phase = 'preview' OR turn = 0),
tags AS (
  SELECT w.*, list_filter(list_transform(w.a[5:], lambda x: {_w('x')}), lambda x: starts_with(x, '[of]'))[-1] AS of_raw,
    coalesce({_w("replace(list_filter(list_transform(w.a[5:], lambda x: " + _w('x') + "), lambda x: starts_with(x, '[from]'))[-1], '[from]', '')")}, '') AS cause
  FROM who w WHERE live AND token = '-damage' AND n >= 4),
hits AS (
  SELECT g.*, nullif({_nick(_w("replace(of_raw, '[of]', '')"))}, '') AS of_nick, {_w("split_part(replace(of_raw, '[of]', ''), ':', 1)")} AS of_place, h.hp AS hp_after, coalesce(b.hp, 100.0) AS hp_before
  FROM tags g JOIN hps h ON g.battle_id = h.battle_id AND g.seq = h.seq
    ASOF LEFT JOIN hps b ON g.battle_id = b.battle_id AND g.place = b.place AND g.seq > b.seq),
foe AS (
  SELECT h.battle_id, h.seq, arg_min(m.place, m.first) AS foe_place FROM hits h JOIN moved m ON h.battle_id = m.battle_id AND m.first < h.seq AND m.side = CASE WHEN h.side = 'p1' THEN 'p2' ELSE 'p1' END GROUP BY ALL),
stand AS (
  SELECT h.battle_id, h.seq, h.of_nick, q.place, x.nick, f.first FROM hits h CROSS JOIN (VALUES ('p1a'), ('p1b'), ('p2a'), ('p2b')) AS q(place)
    JOIN entered f ON f.battle_id = h.battle_id AND f.place = q.place
    ASOF JOIN ent x ON h.battle_id = x.battle_id AND q.place = x.place AND h.seq > x.seq WHERE h.of_nick IS NOT NULL),
namesake AS (SELECT battle_id, seq, arg_min(place, first) AS by_place FROM stand WHERE nick = of_nick GROUP BY ALL),
dealt AS (
  SELECT h.*, coalesce(h.of_nick, fx.nick, '') AS attacker,
    CASE WHEN h.of_nick IS NOT NULL THEN coalesce(CASE WHEN ox.nick = h.of_nick THEN oy.sp END, oz.sp, '') ELSE coalesce(fy.sp, '') END AS attacker_species,
    coalesce(nullif(CASE WHEN h.of_nick IS NOT NULL THEN bm.mv ELSE fm.mv END, ''), h.cause) AS move_name
  FROM hits h LEFT JOIN foe f ON h.battle_id = f.battle_id AND h.seq = f.seq LEFT JOIN namesake k ON h.battle_id = k.battle_id AND h.seq = k.seq
    ASOF LEFT JOIN ent fx ON h.battle_id = fx.battle_id AND f.foe_place = fx.place AND h.seq > fx.seq
    ASOF LEFT JOIN sps fy ON h.battle_id = fy.battle_id AND f.foe_place = fy.place AND h.seq > fy.seq
    ASOF LEFT JOIN mvs fm ON h.battle_id = fm.battle_id AND f.foe_place = fm.place AND h.seq > fm.seq
    ASOF LEFT JOIN mvs bm ON h.battle_id = bm.battle_id AND k.by_place = bm.place AND h.seq > bm.seq
    ASOF LEFT JOIN ent ox ON h.battle_id = ox.battle_id AND h.of_place = ox.place AND h.seq > ox.seq
    ASOF LEFT JOIN sps oy ON h.battle_id = oy.battle_id AND h.of_place = oy.place AND h.seq > oy.seq
    ASOF LEFT JOIN sps oz ON h.battle_id = oz.battle_id AND left(h.of_place, 2) = oz.side AND h.of_nick = oz.nick AND h.seq > oz.seq),
wins AS (SELECT battle_id, arg_max({_w('a[3]')}, seq) AS winner_name FROM ev WHERE token = 'win' AND n > 2 GROUP BY battle_id)
"""
_T = "CAST(turn AS SMALLINT) AS turn_no"
_OWNED = f"SELECT battle_id, {_T}, username, nick AS pokemon_name, species"
_PLAYERS = "SELECT u.battle_id, u.username, u.side, u.rating_before, CASE WHEN w.battle_id IS NOT NULL THEN CASE WHEN u.username = w.winner_name THEN 'WIN' ELSE 'LOSS' END END AS result FROM users u LEFT JOIN wins w ON u.battle_id = w.battle_id"
_ACTIVE = ", ".join(f"coalesce({c}.nick, '') AS {n}" for c, n in (("x1", "p1_left"), ("x2", "p1_right"), ("x3", "p2_left"), ("x4", "p2_right")))
_ACTIVE_JOINS = " ".join(f"ASOF LEFT JOIN (SELECT * FROM ent WHERE place = '{p}') {c} ON e.battle_id = {c}.battle_id AND e.seq > {c}.seq" for c, p in (("x1", "p1a"), ("x2", "p1b"), ("x3", "p2a"), ("x4", "p2b")))
_FITS = "CASE WHEN ends_with(r.pokemon_name, '-*') THEN lower({s}) = lower(left(r.pokemon_name, -2)) OR starts_with(lower({s}), lower(left(r.pokemon_name, -2)) || '-') ELSE lower({s}) = lower(r.pokemon_name) END"

_BASE = "regexp_replace(lower(split_part(p, '-', 1)), '[^a-z0-9]', '', 'g')"
_TOLD = f"""
  SELECT battle_id, side, count(*) FILTER (WHERE hits <> 1) = 0 AS told, max(has) AS has FROM (
    SELECT h.battle_id, s.side, p, len(string_split(h.head, '|showteam|' || s.side || '|')) > 1 AS has,
      len(list_filter(list_transform(string_split(regexp_extract(h.head, '(?m)^\\|showteam\\|' || s.side || '\\|(.*)$', 1), ']'), lambda m: split_part(m, '|', 1)),
        lambda n: regexp_replace(lower(n), '[^a-z0-9]', '', 'g') = {_BASE} OR list_contains(list_transform(string_split(n, '-'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), {_BASE}))) AS hits
    FROM heads h CROSS JOIN (VALUES ('p1'), ('p2')) AS s(side), unnest(regexp_extract_all(h.head, '\\|poke\\|' || s.side || '\\|([^,|]+)', 1)) AS u(p)) GROUP BY ALL"""

SQL = {
    "log_complete": "WITH " + _LOGS + f""",
heads AS (SELECT battle_id, log, split_part(log, chr(10) || '|' || chr(10), 1) AS head FROM logs),
told AS ({_TOLD})
SELECT h.battle_id, coalesce(contains(log, '|turn|1') AND (SELECT count(*) FROM told t WHERE t.battle_id = h.battle_id AND t.told AND t.has) = 2
  AND len(regexp_extract_all(log, '\\|poke\\|p1\\|')) = 6 AND len(regexp_extract_all(log, '\\|poke\\|p2\\|')) = 6 AND NOT contains(log, 'Zoroark') AND NOT contains(log, 'Zorua'), false) AS complete FROM heads h""",
    "masked_resolvability": "WITH " + _LOGS + """,
mk AS (SELECT battle_id, log, unnest(regexp_extract_all(log, '\\|poke\\|(p[12])\\|([^,|]+?)-\\*', 1)) AS side, unnest(regexp_extract_all(log, '\\|poke\\|(p[12])\\|([^,|]+?)-\\*', 2)) AS base FROM logs),
d AS (
  SELECT battle_id, base, list_filter(list_transform(string_split(regexp_extract_all(log, '(?m)^\\|showteam\\|' || side || '\\|(.*)$', 1)[-1], ']'),
      lambda m: trim(CASE WHEN split_part(m, '|', 2) <> '' THEN split_part(m, '|', 2) ELSE split_part(m, '|', 1) END, """ + _WHITE + """)), lambda s: s = base OR starts_with(s, base || '-')) AS team,
    list_filter(regexp_extract_all(log, '\\|(?:switch|drag|detailschange|-formechange)\\|' || side || '[ab]: [^|]*\\|([^,|]+)', 1), lambda s: s = base OR starts_with(s, base || '-')) AS events FROM mk)
SELECT base, count(*) AS slots, count(DISTINCT battle_id) AS logs, count(*) FILTER (WHERE len(team) > 0) AS by_team, count(*) FILTER (WHERE len(events) > 0) AS by_events,
  count(*) FILTER (WHERE coalesce(len(team), 0) = 0 AND len(events) = 0) AS unresolved FROM d GROUP BY base""",
    "detail_frequency": "WITH " + _LOGS + """,
d AS (
  SELECT 'poke' AS kind, unnest(regexp_extract_all(log, '(?m)^\\|poke\\|p[12]\\|([^|\n]+)', 1)) AS detail FROM logs
  UNION ALL SELECT 'switch', unnest(regexp_extract_all(log, '(?m)^\\|(?:switch|drag|detailschange|replace)\\|[^|]*\\|([^|\n]+)', 1)) FROM logs)
SELECT kind, trim(detail, """ + _WHITE + """) AS detail, count(*) AS n FROM d WHERE contains(lower(detail), 'klo') GROUP BY ALL""",
    "packed_team": "WITH " + _LOGS + """,
shown AS (SELECT battle_id, unnest(regexp_extract_all(log, '(?m)^\\|showteam\\|(p[12])\\|(.*)$', 1)) AS side, unnest(regexp_extract_all(log, '(?m)^\\|showteam\\|(p[12])\\|(.*)$', 2)) AS body FROM logs)
SELECT battle_id, side, array_to_string(list_transform(string_split(body, ']'), lambda m: trim(CASE WHEN split_part(m, '|', 2) <> '' THEN split_part(m, '|', 2) ELSE split_part(m, '|', 1) END, """ + _WHITE + """)), ';') AS species FROM shown""",
    "log_battles": _STATE + f"""
SELECT l.battle_id, coalesce(f.format, '') AS format, coalesce(regexp_replace(lower(f.format), '[\\[\\]\\s]+', '', 'g'), '') AS format_id, coalesce(f.said, CAST(round_even(l.uploadtime, 0) AS BIGINT)) AS upload_time,
  coalesce(nullif(f.rated, 0), CAST(round_even(l.rating, 0) AS INTEGER)) AS rating, w.winner_name, l.replay_path, coalesce(f.turns, 0) AS turn_count
FROM logs l LEFT JOIN wins w ON l.battle_id = w.battle_id LEFT JOIN (
  SELECT battle_id, arg_max(array_to_string(a[3:], '|'), seq) FILTER (WHERE head AND token = 'tier' AND n > 2) AS format, arg_max(try_cast(a[3] AS BIGINT), seq) FILTER (WHERE head AND token = 't:') AS said,
    arg_max(try_cast(a[3] AS INTEGER), seq) FILTER (WHERE head AND token = 'rated') AS rated, arg_max(try_cast(a[3] AS INTEGER), seq) FILTER (WHERE token = 'turn') AS turns FROM ev GROUP BY battle_id) f ON l.battle_id = f.battle_id
WHERE l.battle_id NOT IN (SELECT battle_id FROM bad)""",
    "log_accounts": _STATE + "SELECT DISTINCT username FROM users",
    "log_players": _STATE + _PLAYERS,
    "log_rosters": _STATE + f"""
, pk AS (SELECT battle_id, a[3] AS player_side, {_w("split_part(a[4], ',', 1)")} AS pokemon_name, row_number() OVER (PARTITION BY battle_id, a[3] ORDER BY seq) AS slot_no FROM ev WHERE head AND token = 'poke' AND n >= 4),
sent AS (SELECT DISTINCT battle_id, side, sp FROM ent),
led AS (
  SELECT DISTINCT w.battle_id, CASE WHEN u.username = w.username THEN 'p2' ELSE w.side END AS side, w.sp FROM who w JOIN opening o ON w.battle_id = o.battle_id AND w.seq = o.seq AND o.lead LEFT JOIN users u ON w.battle_id = u.battle_id AND u.side = 'p2'
  WHERE w.username <> '' AND w.sp <> ''),
m AS (
  SELECT r.*, (SELECT list(DISTINCT s.sp ORDER BY s.sp) FROM sent s WHERE s.battle_id = r.battle_id AND s.side = r.player_side AND {_FITS.format(s='s.sp')}) AS seen,
    EXISTS (SELECT 1 FROM led s WHERE s.battle_id = r.battle_id AND s.side = r.player_side AND {_FITS.format(s='s.sp')}) AS led FROM pk r)
SELECT battle_id, player_side, CAST(slot_no AS SMALLINT) AS slot_no, pokemon_name, CAST(led AS TINYINT) AS is_lead,
  CASE WHEN NOT ends_with(pokemon_name, '-*') THEN pokemon_name WHEN len(seen) = 1 THEN seen[1] ELSE '' END AS species_observed,
  CASE WHEN NOT ends_with(pokemon_name, '-*') THEN 'listed' WHEN len(seen) = 1 THEN 'observed' WHEN len(seen) > 1 THEN 'ambiguous' ELSE 'unobserved' END AS form_status,
  CAST(coalesce(len(seen), 0) > 0 AS TINYINT) AS was_sent_out FROM m""",
    "log_leads": _STATE + """
SELECT w.battle_id, w.username, w.nick AS pokemon_name, arg_min(w.sp, w.seq) AS species, CAST(ascii(right(w.place, 1)) - 96 AS TINYINT) AS lead_slot
FROM who w JOIN opening o ON w.battle_id = o.battle_id AND w.seq = o.seq AND o.lead GROUP BY w.battle_id, w.username, w.nick, w.place""",
    "log_moves": _STATE + f"""
, mv AS (SELECT *, lead(seq) OVER (PARTITION BY battle_id ORDER BY seq) AS next FROM who WHERE token = 'move' AND live AND n >= 5)
SELECT battle_id, {_T}, username, nick AS pokemon_name, species, a[4] AS move_name, {_nick('a[5]')} AS target_name,
  CAST(NOT (len(list_filter(a[6:], lambda x: {_w('x')} IN ('[miss]', '[notarget]'))) > 0
    OR EXISTS (SELECT 1 FROM ev f WHERE f.battle_id = mv.battle_id AND f.live AND f.token = '-fail' AND f.n >= 3 AND f.nick = mv.nick AND f.seq > mv.seq AND (mv.next IS NULL OR f.seq < mv.next))) AS TINYINT) AS success
FROM mv""",
    "log_damage": _STATE + f"""
SELECT battle_id, {_T}, attacker AS attacker_pokemon, nick AS defender_pokemon, attacker_species, species AS defender_species, move_name, CAST(hp_before AS FLOAT) AS hp_before, CAST(hp_after AS FLOAT) AS hp_after,
  CAST(round_even(hp_before - hp_after, 2) AS FLOAT) AS damage_pct FROM dealt""",
    "log_kos": _STATE + f"""
, ft AS (SELECT battle_id, seq, place, turn, nick, lag(seq, 1, 0) OVER (PARTITION BY battle_id, place ORDER BY seq) AS since FROM ev WHERE live AND token = 'faint' AND n >= 3),
pair AS (
  SELECT f.battle_id, f.turn, f.nick, arg_max(d.attacker, d.seq) AS killer, arg_max(d.attacker_species, d.seq) AS killer_species, arg_max(d.species, d.seq) AS victim_species, arg_max(d.move_name, d.seq) AS move_name
  FROM ft f JOIN dealt d ON f.battle_id = d.battle_id AND f.place = d.place AND d.hp_after = 0 AND d.seq > f.since AND d.seq < f.seq GROUP BY f.battle_id, f.seq, f.place, f.turn, f.nick)
SELECT battle_id, {_T}, killer AS killer_pokemon, nick AS victim_pokemon, killer_species, victim_species, move_name,
  CASE WHEN contains(lower(move_name), 'brn') THEN 'BURN' WHEN regexp_matches(lower(move_name), 'psn|tox') THEN 'POISON' WHEN regexp_matches(lower(move_name), 'sandstorm|hail|snow') THEN 'WEATHER'
    WHEN contains(lower(move_name), 'recoil') THEN 'MOVE' WHEN regexp_matches(lower(move_name), 'spikes|stealth rock|sticky web') THEN 'HAZARD' ELSE 'MOVE' END AS ko_type FROM pair""",
    "log_faints": _STATE + _OWNED + " FROM who WHERE live AND token = 'faint' AND n >= 3",
    "log_switches": _STATE + f"""
SELECT w.battle_id, {_T}, w.username, w.nick AS pokemon_name, w.sp AS species FROM who w LEFT JOIN opening o ON w.battle_id = o.battle_id AND w.seq = o.seq WHERE w.entry AND NOT coalesce(o.lead, false)""",
    "log_weather": _STATE + f"""
SELECT battle_id, {_T}, a[3] AS weather_name, coalesce({_nick(_w("replace(list_filter(list_transform(a[4:], lambda x: " + _w('x') + "), lambda x: starts_with(x, '[of]'))[-1], '[of]', '')"))}, '') AS source_pokemon
FROM who WHERE live AND token = '-weather' AND n >= 3 AND a[3] NOT IN ('none', 'None') AND len(list_filter(a[4:], lambda x: contains(x, '[upkeep]'))) = 0""",
    "log_status": _STATE + _OWNED + f", {_w('a[4]')} AS status_code FROM who WHERE live AND token = '-status' AND n >= 4",
    "log_abilities": _STATE + _OWNED + f", {_w('a[4]')} AS ability_name FROM who WHERE live AND token = '-ability' AND n >= 4",
    "log_special_events": _STATE + _OWNED + f", {_w('a[4]')} AS tera_type FROM who WHERE live AND token = '-terastallize' AND n >= 4",
    "log_field_states": _STATE + f"SELECT e.battle_id, CAST(e.turn AS SMALLINT) AS turn_no, {_ACTIVE} FROM (SELECT * FROM ev WHERE token = 'turn') e {_ACTIVE_JOINS}",
    "log_errors": _STATE + "SELECT battle_id, 'roster line of an unknown side' AS error FROM bad",
}
