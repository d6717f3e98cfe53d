"""SQL equivalents of the registered contest queries."""

from __future__ import annotations

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) || chr(8195) || chr(8201) || chr(8239)"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "  "
_SEGMENT = "gen9vgc2024regx"


def _slug(x: str) -> str:
    plain = f"regexp_replace(strip_accents(translate({x}, '{_WIDE}', '{_ASCII}')), '[^\\x00-\\x7f]', '', 'g')"
    text = f"regexp_replace(trim(lower({plain}), {_WS}), '[.'':%]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({text}, '[\\s_]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-')"


def _band(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} >= 1500 THEN '1500_plus' WHEN {x} >= 1400 THEN '1400_1499' WHEN {x} >= 1200 THEN '1200_1399' ELSE 'below_1200' END"


def _wilson(w: str, n: str, sign: str) -> str:
    p, m = f"least({w}::DOUBLE / nullif({n}, 0), 1.0)", f"nullif({n}, 0)::DOUBLE"
    z = "1.959964"
    return f"round(({p} + {z} * {z} / (2 * {m}) {sign} {z} * sqrt({p} * (1 - {p}) / {m} + {z} * {z} / (4 * {m} * {m}))) / (1 + {z} * {z} / {m}), 9)"


def _r(a: str, b: str) -> str:
    return f"round(({a})::DOUBLE / nullif({b}, 0), 9)"


_SCOPE = f"""
b AS (SELECT battle_id, max(format_id) AS format_id, max(turn_count) AS turn_count, max(upload_time) AS upload_time FROM battle GROUP BY battle_id
  HAVING (starts_with(max(format_id), 'gen9vgc') OR starts_with(max(format_id), 'gen9championsvgc')) AND coalesce(max(turn_count), 0) >= 1),
p AS (SELECT battle_id, coalesce(bool_or(side = 'p1' AND result = 'WIN'), false) AS p1_win,
    max(rating_before) FILTER (WHERE side = 'p1') AS p1_rating, max(rating_before) FILTER (WHERE side = 'p2') AS p2_rating,
    max(username) FILTER (WHERE side = 'p1') AS p1_user, max(username) FILTER (WHERE side = 'p2') AS p2_user
  FROM battle_players GROUP BY battle_id HAVING count(*) = 2 AND count(*) FILTER (WHERE result = 'WIN') = 1 AND count(*) FILTER (WHERE result = 'LOSS') = 1),
scope AS (SELECT b.battle_id, replace(replace(format_id, '(bo3)', ''), 'bo3', '') AS regulation,
    coalesce(strftime(make_timestamp(upload_time * 1000000), '%Y-%m'), 'unknown') AS month, p1_win, p1_rating, p2_rating, p1_user, p2_user FROM b JOIN p USING (battle_id)),
sides AS (
  SELECT battle_id, 'p1' AS side, regulation, month, {_band('p1_rating')} AS rating_band, p1_win::INTEGER AS won, p1_user AS username FROM scope
  UNION ALL SELECT battle_id, 'p2', regulation, month, {_band('p2_rating')}, (NOT p1_win)::INTEGER, p2_user FROM scope),
totals AS (SELECT regulation, CASE WHEN grouping(rating_band) = 1 THEN 'all' ELSE rating_band END AS rating_band, CASE WHEN grouping(rating_band) = 1 THEN count(*) // 2 END AS battles, count(*) AS player_battles
  FROM sides GROUP BY GROUPING SETS ((regulation, rating_band), (regulation)))
"""

_MAP = f"""
m AS (SELECT slug, min(poke_id) AS poke_id, min(pokemon) AS pokemon, min(species_id) AS species_id FROM (SELECT {_slug('pokemon')} AS slug, * FROM pokemon_stats WHERE pokemon IS NOT NULL) GROUP BY slug),
fam AS (SELECT base, min(species_id) AS species_id FROM (SELECT species_id, unnest(list_transform(range(1, len(string_split(slug, '-')) + 1), lambda i: array_to_string(string_split(slug, '-')[1:i], '-'))) AS base FROM m)
  GROUP BY base HAVING min(species_id) = max(species_id)),
o AS (SELECT trim(showdown_name, {_WS}) AS showdown_name, min(s) AS target FROM (SELECT showdown_name, {_slug('pokemon')} AS s FROM showdown_overrides WHERE showdown_name IS NOT NULL AND pokemon IS NOT NULL) WHERE s IN (SELECT slug FROM m) GROUP BY 1),
c AS (SELECT showdown_name, count(*) AS n_rows FROM (SELECT trim(pokemon_name, {_WS}) AS showdown_name FROM battle_team_slot UNION ALL SELECT trim(species_observed, {_WS}) FROM battle_team_slot) WHERE showdown_name <> ''
    AND showdown_name NOT IN (SELECT trim(showdown_name, {_WS}) FROM showdown_non_canonical WHERE showdown_name IS NOT NULL) GROUP BY 1),
cs AS (SELECT *, {_slug('showdown_name')} AS slug FROM c),
h AS (SELECT cs.showdown_name, cs.n_rows, o.target, m.poke_id, m.pokemon, m.species_id, fm.species_id AS ms, ff.species_id AS fs FROM cs LEFT JOIN o ON o.showdown_name = cs.showdown_name LEFT JOIN m ON m.slug = coalesce(o.target, cs.slug)
  LEFT JOIN fam fm ON cs.showdown_name LIKE '%-*' AND fm.base = regexp_replace(cs.slug, '-?\\*$', '') LEFT JOIN fam ff ON contains(cs.slug, '-') AND ff.base = split_part(cs.slug, '-', 1)),
hm AS (SELECT *, CASE WHEN pokemon IS NOT NULL AND target IS NOT NULL THEN 'override' WHEN pokemon IS NOT NULL THEN 'exact' WHEN ms IS NOT NULL THEN 'masked' WHEN fs IS NOT NULL THEN 'unlisted' END AS method FROM h),
names AS (SELECT showdown_name, poke_id, pokemon, CASE WHEN pokemon IS NOT NULL THEN species_id ELSE coalesce(ms, fs) END AS species_id, method, CASE WHEN pokemon IS NOT NULL THEN 'known' ELSE method END AS form_status, n_rows FROM hm WHERE method IS NOT NULL),
labels AS (SELECT species_id, min({{'n': length(l), 'l': l}}).l AS species FROM (SELECT species_id, replace(showdown_name, '-*', '') AS l FROM names WHERE species_id IS NOT NULL) GROUP BY species_id)
"""

_FACTS = """
f0 AS (SELECT s.battle_id, s.player_side, d.side, d.regulation, d.month, d.rating_band, d.username, d.won, s.pokemon_name, s.form_status, coalesce(s.was_sent_out, 0)::INTEGER AS sent, coalesce(s.is_lead, 0)::INTEGER AS lead,
    CASE WHEN form_status = 'listed' THEN pokemon_name WHEN form_status = 'observed' THEN species_observed ELSE '' END AS form_name
  FROM battle_team_slot s JOIN sides d ON s.battle_id = d.battle_id AND CASE WHEN s.player_side = 'p1' THEN 'p1' ELSE 'p2' END = d.side),
facts AS (SELECT f0.*, n.species_id, v.poke_id, CASE WHEN v.poke_id IS NOT NULL THEN f0.form_status WHEN f0.form_status IN ('unobserved', 'ambiguous') THEN 'unobserved' ELSE 'species_only' END AS form_basis
  FROM f0 LEFT JOIN names n ON n.showdown_name = f0.pokemon_name LEFT JOIN names v ON v.showdown_name = f0.form_name)
"""

_USAGE = f"""
uc AS (SELECT regulation, CASE WHEN grouping(rating_band) = 1 THEN 'all' ELSE rating_band END AS rating_band, species_id, poke_id, form_basis, count(*) AS appearances, sum(won)::BIGINT AS wins, sum(sent)::BIGINT AS sent_out, sum(sent * won)::BIGINT AS sent_out_wins, sum(lead)::BIGINT AS leads
  FROM facts WHERE species_id IS NOT NULL GROUP BY GROUPING SETS ((regulation, rating_band, species_id, poke_id, form_basis), (regulation, species_id, poke_id, form_basis))),
us AS (SELECT u.*, t.player_battles, l.species, (SELECT min(pokemon) FROM names n WHERE n.poke_id = u.poke_id) AS form,
    sum(wins) OVER (PARTITION BY u.regulation, u.rating_band)::DOUBLE / sum(appearances) OVER (PARTITION BY u.regulation, u.rating_band) AS base FROM uc u JOIN totals t USING (regulation, rating_band) LEFT JOIN labels l USING (species_id)),
usage AS (SELECT regulation, rating_band, species, species_id, form, poke_id, form_basis, appearances, wins, sent_out, sent_out_wins, leads, player_battles, {_r('appearances', 'player_battles')} AS usage_share, {_r('wins', 'appearances')} AS win_rate, round(base, 9) AS band_win_rate,
    round(wins::DOUBLE / appearances - base, 9) AS win_rate_delta, {_wilson('wins', 'appearances', '-')} AS win_ci_low, {_wilson('wins', 'appearances', '+')} AS win_ci_high, {_r('sent_out', 'appearances')} AS sent_out_rate, {_r('leads', 'appearances')} AS lead_rate FROM us),
sl AS (SELECT regulation, rating_band, species_id, species, sum(appearances)::BIGINT AS appearances, sum(wins)::BIGINT AS wins, sum(sent_out)::BIGINT AS sent_out, sum(sent_out_wins)::BIGINT AS sent_out_wins, sum(leads)::BIGINT AS leads, max(player_battles) AS player_battles FROM usage GROUP BY 1, 2, 3, 4)
"""

_ITEMS = """
items AS (SELECT DISTINCT battle_id, side AS player_side, regulation, rating_band, species_id, won FROM facts WHERE species_id IS NOT NULL),
single AS (SELECT regulation, CASE WHEN grouping(rating_band) = 1 THEN 'all' ELSE rating_band END AS rating_band, species_id, count(*) AS teams, sum(won)::BIGINT AS wins FROM items GROUP BY GROUPING SETS ((regulation, rating_band, species_id), (regulation, species_id)))
"""

_PAIRS = f"""
pc AS (SELECT x.regulation, CASE WHEN grouping(x.rating_band) = 1 THEN 'all' ELSE x.rating_band END AS rating_band, x.species_id AS a, y.species_id AS b, count(*) AS teams_both, sum(x.won)::BIGINT AS wins_both FROM items x JOIN items y ON x.battle_id = y.battle_id AND x.player_side = y.player_side AND x.species_id < y.species_id
  GROUP BY GROUPING SETS ((x.regulation, x.rating_band, x.species_id, y.species_id), (x.regulation, x.species_id, y.species_id)) HAVING count(*) >= 30),
tt AS (SELECT regulation, CASE WHEN grouping(rating_band) = 1 THEN 'all' ELSE rating_band END AS rating_band, count(*) AS teams_total, sum(won)::BIGINT AS wins_total FROM (SELECT DISTINCT battle_id, player_side, regulation, rating_band, won FROM items) GROUP BY GROUPING SETS ((regulation, rating_band), (regulation))),
pairs AS (SELECT pc.regulation, pc.rating_band, la.species AS species_a, lb.species AS species_b, a AS species_a_id, b AS species_b_id, teams_both, sa.teams AS teams_a, sb.teams AS teams_b, teams_total, wins_both, {_r('teams_both', 'sa.teams')} AS share_of_a, {_r('teams_both', 'sb.teams')} AS share_of_b,
    round(teams_both::DOUBLE * teams_total / (sa.teams::DOUBLE * sb.teams), 9) AS lift, {_r('wins_both', 'teams_both')} AS win_rate, {_wilson('wins_both', 'teams_both', '-')} AS win_ci_low, {_wilson('wins_both', 'teams_both', '+')} AS win_ci_high, {_r('wins_total', 'teams_total')} AS band_win_rate, round(wins_both::DOUBLE / teams_both - wins_total::DOUBLE / teams_total, 9) AS win_rate_delta
  FROM pc JOIN single sa ON sa.regulation = pc.regulation AND sa.rating_band = pc.rating_band AND sa.species_id = a JOIN single sb ON sb.regulation = pc.regulation AND sb.rating_band = pc.rating_band AND sb.species_id = b JOIN tt ON tt.regulation = pc.regulation AND tt.rating_band = pc.rating_band
  LEFT JOIN labels la ON la.species_id = a LEFT JOIN labels lb ON lb.species_id = b)
"""

_MATCH = f"""
mc AS (SELECT x.regulation, CASE WHEN grouping(x.rating_band) = 1 THEN 'all' ELSE x.rating_band END AS rating_band, x.species_id AS a, y.species_id AS b, count(*) AS battles, sum(x.won)::BIGINT AS wins FROM items x JOIN (SELECT DISTINCT battle_id, player_side, species_id FROM items) y ON x.battle_id = y.battle_id AND y.player_side = CASE WHEN x.player_side = 'p1' THEN 'p2' ELSE 'p1' END AND x.species_id <> y.species_id
  GROUP BY GROUPING SETS ((x.regulation, x.rating_band, x.species_id, y.species_id), (x.regulation, x.species_id, y.species_id)) HAVING count(*) >= 20),
m0 AS (SELECT mc.*, sa.teams AS teams_a, mc.wins::DOUBLE / mc.battles AS wr, sa.wins::DOUBLE / sa.teams AS ar, sb.wins::DOUBLE / sb.teams AS br, least(greatest(sa.wins::DOUBLE / sa.teams, 0.01), 0.99) AS ca, least(greatest(sb.wins::DOUBLE / sb.teams, 0.01), 0.99) AS cb
  FROM mc JOIN single sa ON sa.regulation = mc.regulation AND sa.rating_band = mc.rating_band AND sa.species_id = a JOIN single sb ON sb.regulation = mc.regulation AND sb.rating_band = 'all' AND sb.species_id = b),
m1 AS (SELECT *, ca * (1 - cb) / (ca * (1 - cb) + cb * (1 - ca)) AS ex FROM m0),
mu AS (SELECT m1.regulation, m1.rating_band, la.species AS species_a, lb.species AS species_b, a AS species_a_id, b AS species_b_id, battles, wins, teams_a, round(wr, 9) AS win_rate, {_wilson('wins', 'battles', '-')} AS win_ci_low, {_wilson('wins', 'battles', '+')} AS win_ci_high, round(ar, 9) AS a_win_rate, round(wr - ar, 9) AS win_rate_delta, round(br, 9) AS b_win_rate,
    round(ex, 9) AS expected_win_rate, round(wr - ex, 9) AS win_rate_vs_expected, round((wr - ex) / sqrt(ex * (1 - ex) / battles), 9) AS z_vs_expected FROM m1 LEFT JOIN labels la ON la.species_id = a LEFT JOIN labels lb ON lb.species_id = b)
"""

_MONTH = f"""
mt AS (SELECT regulation, month, battles, battles * 2 AS player_battles, battles::DOUBLE / max(battles) OVER (PARTITION BY regulation) AS sp FROM (SELECT regulation, month, count(*) AS battles FROM scope GROUP BY 1, 2)),
mo AS (SELECT f.regulation, f.month, l.species, f.species_id, f.appearances, f.wins, f.sent_out, t.player_battles, t.sp < 0.05 AS tail, {_r('appearances', 't.player_battles')} AS usage_share, {_r('wins', 'appearances')} AS win_rate, {_wilson('wins', 'appearances', '-')} AS win_ci_low, {_wilson('wins', 'appearances', '+')} AS win_ci_high, {_r('sent_out', 'appearances')} AS sent_out_rate
  FROM (SELECT regulation, month, species_id, count(*) AS appearances, sum(won)::BIGINT AS wins, sum(sent)::BIGINT AS sent_out FROM facts WHERE species_id IS NOT NULL GROUP BY 1, 2, 3) f JOIN mt t USING (regulation, month) LEFT JOIN labels l USING (species_id))
"""

_EVENTS = f"""
ow AS (SELECT battle_id, username, min({{'s': side, 'r': regulation, 'b': rating_band, 'w': won}}) AS s FROM sides WHERE username IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT e.battle_id, s.s AS side, s.r AS regulation, s.b AS rating_band, s.w AS won, e.species, 'slot' || e.lead_slot AS label, row_number() OVER (PARTITION BY e.battle_id, s.s ORDER BY e.lead_slot NULLS FIRST, e.species NULLS FIRST, e.pokemon_name NULLS FIRST) AS rn FROM battle_leads e JOIN ow ON e.battle_id = ow.battle_id AND coalesce(e.username, '') = ow.username),
fe AS (SELECT ev.battle_id, ev.side, ev.regulation, ev.rating_band, n.species_id, ev.label, ev.won FROM ev LEFT JOIN names n ON n.showdown_name = ev.species WHERE rn = 1),
lc AS (SELECT regulation, CASE WHEN grouping(rating_band) = 1 THEN 'all' ELSE rating_band END AS rating_band, species_id, label, count(*) AS events, sum(won)::BIGINT AS wins FROM fe WHERE species_id IS NOT NULL AND label IS NOT NULL GROUP BY GROUPING SETS ((regulation, rating_band, species_id, label), (regulation, species_id, label))),
lb AS (SELECT *, {_r('events', 'sum(events) OVER (PARTITION BY regulation, rating_band, species_id)')} AS label_share FROM lc)
"""
_SUMMARY = f"""
su AS (SELECT regulation, rating_band, species_id, species, sum(sent_out)::BIGINT AS sent_out, sum(sent_out_wins)::BIGINT AS sent_out_wins FROM usage GROUP BY 1, 2, 3, 4 HAVING sum(sent_out) > 0),
se AS (SELECT regulation, rating_band, species_id, sum(events)::BIGINT AS ec, sum(wins)::BIGINT AS ew FROM lb GROUP BY 1, 2, 3),
sm0 AS (SELECT su.*, coalesce(ec, 0) AS event_count, coalesce(ew, 0) AS event_wins FROM su LEFT JOIN se USING (regulation, rating_band, species_id)),
sm AS (SELECT regulation, rating_band, species, species_id, sent_out, sent_out_wins, event_count, event_wins, {_r('event_count', 'sent_out')} AS event_rate, {_wilson('event_count', 'sent_out', '-')} AS event_rate_ci_low, {_wilson('event_count', 'sent_out', '+')} AS event_rate_ci_high, {_r('event_wins', 'event_count')} AS win_rate_with,
    {_r('sent_out_wins - event_wins', 'greatest(sent_out - event_count, 0)')} AS win_rate_without FROM sm0)
"""


def _rank(x: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _popular(name: str, band: str, teams: int) -> str:
    return f"""
{name}g AS (SELECT regulation, appearances::DOUBLE / player_battles AS x, wins::DOUBLE / appearances AS y FROM sl WHERE rating_band = '{band}' AND appearances >= {teams}),
{name} AS (SELECT regulation, count(*) AS species, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 9) END AS v FROM (SELECT regulation, {_rank('x', 'regulation')} AS a, {_rank('y', 'regulation')} AS b FROM {name}g) GROUP BY regulation HAVING count(*) >= 10)
"""


def _all(*parts: str, select: str) -> str:
    return _with(_SCOPE, _MAP, _FACTS, *parts, select=select)


_ONE = f"regulation = '{_SEGMENT}' AND rating_band = 'all'"
_MASKED = f"""
ms AS (SELECT row_number() OVER () AS k, s.battle_id, s.player_side, s.slot_no, s.pokemon_name, u.username FROM battle_team_slot s LEFT JOIN (SELECT battle_id, side, min(username) AS username FROM battle_players GROUP BY 1, 2) u ON u.battle_id = s.battle_id AND u.side = s.player_side WHERE s.pokemon_name LIKE '%-*'),
me AS (SELECT DISTINCT battle_id, username, species AS seen FROM battle_leads WHERE battle_id IS NOT NULL AND username IS NOT NULL AND species IS NOT NULL AND species NOT LIKE '%-*'),
mb AS (SELECT battle_id, username, count(DISTINCT split_part(lower(seen), '-', 1)) AS brought_n FROM me GROUP BY 1, 2),
mf AS (SELECT k, list_sort(list(DISTINCT seen)) AS cands FROM ms JOIN me USING (battle_id, username) WHERE lower(seen) = rtrim(lower(pokemon_name[:-2]), '-') OR starts_with(lower(seen), lower(pokemon_name[:-2])) GROUP BY k),
mr AS (SELECT battle_id, player_side, slot_no, pokemon_name, username, coalesce(brought_n, 0) AS brought_n, coalesce(array_to_string(cands, ';'), '') AS candidates, coalesce(len(cands), 0)::INTEGER AS n_candidates,
  CASE WHEN username IS NULL THEN 'no_player' WHEN coalesce(len(cands), 0) = 1 THEN 'resolved' WHEN len(cands) > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN len(cands) = 1 THEN cands[1] END AS resolved_name FROM ms LEFT JOIN mf USING (k) LEFT JOIN mb USING (battle_id, username))
"""
_SEG_RE = "^gen9(champions)?vgc(\\d{4})reg([a-z](?:-[a-z])?)$"

SQL: dict[str, str] = {
    "scope_contests": _with(_SCOPE, select="SELECT * FROM scope"),
    "band_totals": _with(_SCOPE, select="SELECT * FROM totals"),
    "usage_share": _all(_USAGE, select="SELECT * FROM usage"),
    "usage_unmapped": _all(select="SELECT count(*) FILTER (WHERE species_id IS NULL) AS unmapped FROM facts"),
    "usage_top_n": _all(_USAGE, select=f"SELECT species_id, appearances, round_even(100 * (appearances::DOUBLE / player_battles), 1) AS usage_pct, round_even(100 * (wins::DOUBLE / appearances), 1) AS win_pct, round_even(100 * (sent_out::DOUBLE / appearances), 1) AS sent_out_pct, round_even(100 * (leads::DOUBLE / appearances), 1) AS lead_pct FROM sl WHERE {_ONE} ORDER BY appearances DESC, species_id LIMIT 15"),
    "species_level": _all(_USAGE, select="SELECT * EXCLUDE (rating_band) FROM sl WHERE rating_band = 'all'"),
    "pair_lift": _all(_ITEMS, _PAIRS, select="SELECT * FROM pairs"),
    "pair_partners_of": _all(_ITEMS, _PAIRS, select=f"SELECT CASE WHEN species_a_id = 1 THEN species_b_id ELSE species_a_id END AS partner_id, teams_both, round_even(100 * CASE WHEN species_a_id = 1 THEN teams_both::DOUBLE / teams_a ELSE teams_both::DOUBLE / teams_b END, 1) AS share_pct FROM pairs WHERE {_ONE} AND (species_a_id = 1 OR species_b_id = 1) ORDER BY share_pct DESC, partner_id LIMIT 10"),
    "pair_top": _all(_ITEMS, _PAIRS, select=f"SELECT species_a_id, species_b_id, teams_both, lift FROM pairs WHERE {_ONE} AND teams_both >= 40 ORDER BY lift DESC, species_a_id, species_b_id LIMIT 10"),
    "matchup_log5": _all(_ITEMS, _MATCH, select="SELECT * FROM mu"),
    "matchup_antisymmetry": _all(_ITEMS, _MATCH, select="SELECT x.regulation, x.species_a_id, x.species_b_id, x.battles, x.wins FROM mu x LEFT JOIN mu y ON x.rating_band = 'all' AND y.rating_band = 'all' AND x.regulation = y.regulation AND x.species_a_id = y.species_b_id AND x.species_b_id = y.species_a_id WHERE x.rating_band = 'all' AND (y.battles IS NULL OR x.battles <> y.battles OR x.wins + y.wins <> x.battles)"),
    "matchup_extremes": _all(_ITEMS, _MATCH, f"mx AS (SELECT species_b_id, battles, win_rate, win_rate_vs_expected FROM mu WHERE {_ONE} AND species_a_id = 1 AND battles >= 25)", select="(SELECT 'best' AS end, * FROM mx ORDER BY win_rate_vs_expected DESC, species_b_id LIMIT 8) UNION ALL (SELECT 'worst', * FROM mx ORDER BY win_rate_vs_expected, species_b_id DESC LIMIT 8)"),
    "matchup_spread": _all(_ITEMS, _MATCH, select="SELECT regulation, count(*) AS pairs, round(median(abs(100 * (wr - ex))), 9) AS median_abs_pp, round(quantile_cont(abs(100 * (wr - ex)), 0.95), 9) AS p95_abs_pp, round(avg((abs((wr - ex) / sqrt(ex * (1 - ex) / battles)) > 4)::INTEGER), 9) AS share_abs_z_gt_4 FROM m1 WHERE rating_band = 'all' AND battles >= 25 GROUP BY 1"),
    "monthly_totals": _with(_SCOPE, _MAP, _FACTS, _MONTH, select="SELECT regulation, month, battles, player_battles, round(sp, 9) AS share_of_peak, sp < 0.05 AS tail FROM mt"),
    "monthly_trend": _all(_MONTH, select="SELECT * FROM mo"),
    "species_trend": _all(_MONTH, select=f"SELECT month, appearances, wins, usage_share FROM mo WHERE regulation = '{_SEGMENT}' AND species_id = 1"),
    "dim_segment": _with(_SCOPE, "mt AS (SELECT regulation, month, count(*) AS n FROM scope GROUP BY 1, 2)", "g AS (SELECT regulation, min(month) FILTER (WHERE month <> 'unknown') AS first_month, max(month) FILTER (WHERE month <> 'unknown') AS last_month, (SELECT month FROM mt x WHERE x.regulation = mt.regulation ORDER BY n DESC, month LIMIT 1) AS busiest_month, sum(n)::BIGINT AS battles, (2 * sum(n))::BIGINT AS player_battles FROM mt GROUP BY regulation)",
        select=f"SELECT regulation, row_number() OVER (ORDER BY busiest_month, regulation)::INTEGER AS sort_order, CASE WHEN regexp_matches(regulation, '{_SEG_RE}') THEN CASE WHEN regexp_extract(regulation, '{_SEG_RE}', 1) <> '' THEN 'Champions ' ELSE '' END || 'Reg ' || upper(regexp_extract(regulation, '{_SEG_RE}', 3)) || ' ' || regexp_extract(regulation, '{_SEG_RE}', 2) ELSE regulation END AS label, CASE WHEN NOT regexp_matches(regulation, '{_SEG_RE}') THEN 'Other' WHEN regexp_extract(regulation, '{_SEG_RE}', 1) <> '' THEN 'Champions' ELSE 'Scarlet/Violet' END AS game, try_cast(regexp_extract(regulation, '{_SEG_RE}', 2) AS INTEGER) AS season_year, upper(regexp_extract(regulation, '{_SEG_RE}', 3)) AS reg_letter, first_month, last_month, busiest_month, battles, player_battles FROM g"),
    "dim_band": "SELECT * FROM (VALUES ('all', 1, 'All ratings', NULL::BIGINT, NULL::BIGINT), ('below_1200', 2, 'below 1200', NULL, 1199), ('1200_1399', 3, '1200 1399', 1200, 1399), ('1400_1499', 4, '1400 1499', 1400, 1499), ('1500_plus', 5, '1500 plus', 1500, NULL), ('unknown', 6, 'No rating', NULL, NULL)) t(rating_band, sort_order, label, rating_min, rating_max)",
    "dim_month": _with(_SCOPE, select="SELECT month, month || '-01' AS month_start, year((month || '-01')::DATE)::INTEGER AS year, month((month || '-01')::DATE)::INTEGER AS month_number, strftime((month || '-01')::DATE, '%b %Y') AS label FROM (SELECT DISTINCT month FROM scope WHERE month <> 'unknown')"),
    "dim_item": _with(_MAP, select="SELECT n.species_id, l.species, bool_or(n.form_status = 'masked') AS has_masked_form FROM names n JOIN labels l USING (species_id) GROUP BY 1, 2"),
    "first_event_attribution": _all(_EVENTS, select="SELECT * FROM fe"),
    "event_unattributed": _with(_SCOPE, select="SELECT count(*) AS events, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM sides s WHERE s.battle_id = e.battle_id AND s.username = coalesce(e.username, ''))) AS unattributed FROM battle_leads e WHERE battle_id IN (SELECT battle_id FROM scope)"),
    "event_label_share": _all(_EVENTS, select="SELECT * FROM lb"),
    "event_top_label": _all(_EVENTS, select="SELECT regulation, rating_band, species_id, label, events, label_share FROM (SELECT *, row_number() OVER (PARTITION BY regulation, rating_band, species_id ORDER BY events DESC, label) AS rn FROM lb) WHERE rn = 1"),
    "event_summary": _all(_USAGE, _EVENTS, _SUMMARY, select="SELECT * FROM sm"),
    "label_profile": _all(_USAGE, _EVENTS, _SUMMARY, "tp AS (SELECT regulation, species_id, max(events::DOUBLE / t) AS top FROM (SELECT *, sum(events) OVER (PARTITION BY regulation, rating_band, species_id) AS t FROM lc) WHERE rating_band = 'all' AND (regulation, species_id) IN (SELECT (regulation, species_id) FROM sm WHERE rating_band = 'all' AND event_count >= 20) GROUP BY 1, 2)",
        select="SELECT a.regulation, round(a.e::DOUBLE / a.o, 9) AS event_per_sent_out, coalesce(n, 0) AS species_analysed, round(med, 9) AS median_top_share, round(half, 9) AS share_with_half FROM (SELECT regulation, sum(event_count) AS e, sum(sent_out) AS o FROM sm WHERE rating_band = 'all' GROUP BY 1 HAVING sum(event_count) > 0) a LEFT JOIN (SELECT regulation, count(*) AS n, median(top) AS med, avg((top >= 0.5)::INTEGER) AS half FROM tp GROUP BY 1) g USING (regulation)"),
    "concentration": _all(_USAGE, "cg AS (SELECT regulation, species_id, appearances::DOUBLE / player_battles AS u, appearances::DOUBLE / sum(appearances) OVER (PARTITION BY regulation) AS p, row_number() OVER (PARTITION BY regulation ORDER BY appearances::DOUBLE / player_battles DESC, species_id) AS rn FROM sl WHERE rating_band = 'all')",
        select="SELECT regulation, max(species_id) FILTER (WHERE rn = 1) AS top_species_id, round(max(u), 9) AS top1_usage, round(avg(u) FILTER (WHERE rn <= 5), 9) AS top5_mean_usage, count(*) FILTER (WHERE u >= 0.05) AS species_over_5_pct, round(1 / sum(p * p), 9) AS effective_species FROM cg GROUP BY 1"),
    "rank_stability": _all(_MONTH, "sg AS (SELECT * FROM mo WHERE NOT tail AND player_battles >= 40 AND month <> 'unknown')", "sk AS (SELECT regulation, species_id FROM (SELECT regulation, species_id, row_number() OVER (PARTITION BY regulation ORDER BY sum(appearances) DESC, species_id) AS rn FROM sg GROUP BY 1, 2) WHERE rn <= 30)", "sq AS (SELECT regulation, month, dense_rank() OVER (PARTITION BY regulation ORDER BY month) AS m FROM (SELECT DISTINCT regulation, month FROM sg))", "sw AS (SELECT sk.regulation, sk.species_id, sq.m, coalesce(sg.appearances::DOUBLE / sg.player_battles, 0) AS u FROM sk JOIN sq USING (regulation) LEFT JOIN sg ON sg.regulation = sk.regulation AND sg.month = sq.month AND sg.species_id = sk.species_id)", f"sr AS (SELECT regulation, m, {_rank('u', 'regulation, m')} AS a, {_rank('v', 'regulation, m')} AS b FROM (SELECT x.regulation, x.m, x.u, y.u AS v FROM sw x JOIN sw y ON x.regulation = y.regulation AND x.species_id = y.species_id AND y.m = x.m + 1))", "sc AS (SELECT regulation, m, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS r FROM sr GROUP BY 1, 2)",
        select="SELECT regulation, (SELECT max(m) FROM sq WHERE sq.regulation = sc.regulation) AS months, round(avg(r), 9) AS mean_rank_corr, round(min(r), 9) AS min_rank_corr FROM sc GROUP BY regulation"),
    "popularity_vs_success": _all(_USAGE, _popular("pv", "all", 40), select="SELECT regulation, species, v AS usage_vs_win FROM pv"),
    "popularity_by_band": _all(_USAGE, _popular("p1v", "all", 40), _popular("p2v", "below_1200", 10), _popular("p3v", "1200_1399", 10), select='SELECT coalesce(p1v.regulation, p2v.regulation, p3v.regulation) AS regulation, p1v.v AS "all", p2v.v AS below_1200, p3v.v AS "1200_1399" FROM p1v FULL OUTER JOIN p2v ON p1v.regulation = p2v.regulation FULL OUTER JOIN p3v ON p3v.regulation = coalesce(p1v.regulation, p2v.regulation)'),
    "band_shift": _all(_USAGE, f"bs AS (SELECT species_id, round_even(100 * (h.appearances::DOUBLE / h.player_battles - l.appearances::DOUBLE / l.player_battles), 1) AS shift_pp FROM (SELECT * FROM sl WHERE regulation = '{_SEGMENT}' AND rating_band = 'below_1200' AND appearances >= 10) l JOIN (SELECT * FROM sl WHERE regulation = '{_SEGMENT}' AND rating_band = '1200_1399' AND appearances >= 10) h USING (species_id))", select="(SELECT 'head' AS end, * FROM bs ORDER BY shift_pp, species_id LIMIT 8) UNION ALL (SELECT 'tail', * FROM bs ORDER BY shift_pp DESC, species_id DESC LIMIT 8)"),
    "name_normalize": _with(_MAP, select="SELECT showdown_name, slug FROM cs"),
    "name_mapping": _with(_MAP, select="SELECT * FROM names"),
    "name_unmatched": _with(_MAP, select="SELECT showdown_name, n_rows FROM hm WHERE method IS NULL"),
    "mapping_coverage": _with(_MAP, select="SELECT count(*) AS names, sum(n_rows)::BIGINT AS rows, round(100 * sum(CASE WHEN method IN ('override', 'exact') THEN n_rows ELSE 0 END)::DOUBLE / sum(n_rows), 9) AS exact_form_pct, round(100 * sum(CASE WHEN method IN ('masked', 'unlisted') THEN n_rows ELSE 0 END)::DOUBLE / sum(n_rows), 9) AS species_only_pct, round(100 * sum(CASE WHEN method IS NULL THEN n_rows ELSE 0 END)::DOUBLE / sum(n_rows), 9) AS unmatched_pct FROM hm"),
    "side_coverage": "SELECT count(*) AS sides, count(*) FILTER (WHERE k) AS covered, round(count(*) FILTER (WHERE k)::DOUBLE / count(*), 9) AS share FROM (SELECT EXISTS (SELECT 1 FROM battle_players p WHERE p.battle_id IS NOT DISTINCT FROM h.battle_id AND p.side IS NOT DISTINCT FROM h.player_side) AS k FROM (SELECT DISTINCT battle_id, player_side FROM battle_team_slot) h)",
    "masked_resolution": _with(_MASKED, select="SELECT * FROM mr"),
    "masked_summary": _with(_MASKED, select="SELECT pokemon_name, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'unknown') AS \"unknown\", count(*) FILTER (WHERE status = 'no_player') AS no_player FROM mr GROUP BY 1"),
    "lead_profile": "SELECT count(*) AS rows, count(*) FILTER (WHERE species IS NULL OR species = '') AS empty, count(*) FILTER (WHERE species LIKE '%*') AS masked, count(*) FILTER (WHERE species <> pokemon_name) AS nickname, count(*) FILTER (WHERE username IS NULL OR username = '') AS no_user FROM battle_leads",
    "name_probe": "SELECT species AS value, count(*) AS n_rows FROM battle_leads WHERE contains(lower(species), 'klo') GROUP BY 1",
    "sent_out_histogram": "SELECT sent, leads, count(*) AS sides FROM (SELECT battle_id, player_side, sum(coalesce(was_sent_out, 0))::BIGINT AS sent, sum(coalesce(is_lead, 0))::BIGINT AS leads FROM battle_team_slot GROUP BY 1, 2) GROUP BY 1, 2",
    "id_collisions": "SELECT count(*) AS rows, count(DISTINCT battle_id) AS ids, count(DISTINCT md5(left(replay_path, 500))) AS head_digests FROM battle",
    "first_per_id": "SELECT battle_id, count(*) - 1 AS skipped_duplicate FROM battle GROUP BY 1 HAVING count(*) > 1",
    "rating_histogram": "SELECT (rating_before // 100 * 100)::INTEGER AS bucket, count(*) AS sides FROM battle_players WHERE rating_before IS NOT NULL GROUP BY 1",
    "edge_contests": """
WITH r AS (SELECT *, strftime(loaded_at, '%Y-%m') AS month FROM battle_team_slot WHERE battle_id IS NOT NULL),
e AS (SELECT month, count(DISTINCT battle_id) AS n, arg_min(battle_id, (loaded_at, battle_id)) AS low, arg_max(battle_id, (loaded_at, battle_id)) AS high FROM r GROUP BY month)
SELECT r.month, count(*) AS rows FROM r JOIN e ON r.month IS NOT DISTINCT FROM e.month WHERE NOT (e.n > 20 AND r.battle_id IN (e.low, e.high)) GROUP BY r.month""",
    "listed_contests": "SELECT battle_id, count(*) AS rows FROM battle_team_slot WHERE battle_id IN (SELECT battle_id FROM battle WHERE turn_count = 0) GROUP BY battle_id",
    "rows_per_contest": "SELECT rows, count(*) AS contests FROM (SELECT battle_id, count(*) AS rows FROM battle_players GROUP BY battle_id) GROUP BY rows",
    "odd_ratings": "SELECT count(rating_before) AS ratings, count(*) FILTER (WHERE rating_before < 1000) AS low FROM battle_players",
    "coverage_gate": """
WITH h AS (SELECT DISTINCT battle_id, player_side AS side FROM battle_team_slot), k AS (SELECT DISTINCT battle_id, side FROM battle_players),
c AS (SELECT count(*) AS sides, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM k WHERE k.battle_id IS NOT DISTINCT FROM h.battle_id AND k.side IS NOT DISTINCT FROM h.side)) AS covered FROM h)
SELECT sides, covered, round(covered / sides, 9) AS share, covered / sides >= 0.99 AS passes FROM c""",
    "first_rows": """
SELECT format_id, battle_id, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY format_id ORDER BY loaded_at NULLS FIRST, battle_id NULLS FIRST) AS n FROM (SELECT DISTINCT format_id, battle_id, loaded_at FROM battle)) WHERE n <= 3""",
    "first_contests": "SELECT battle_id, count(*) AS rows FROM battle_team_slot WHERE battle_id IN (SELECT DISTINCT battle_id FROM battle_team_slot WHERE battle_id IS NOT NULL ORDER BY battle_id LIMIT 50) GROUP BY battle_id",
    "invariants": "SELECT 'none' AS invariant WHERE false",
    "item_corpus": """
SELECT battle_id, player_side, string_agg(pokemon_name, ';' ORDER BY slot_no NULLS FIRST, pokemon_name) AS team
FROM (SELECT DISTINCT battle_id, player_side, slot_no, pokemon_name FROM battle_team_slot WHERE pokemon_name IS NOT NULL AND battle_id IS NOT NULL) GROUP BY battle_id, player_side""",
    "crawl_next": """
WITH l AS (SELECT DISTINCT battle_id AS id, upload_time AS t FROM battle WHERE starts_with(battle_id, 'gen9vgc2024regx') AND upload_time IS NOT NULL),
h AS (SELECT * FROM l WHERE t BETWEEN 1711929600 AND 1727740800 AND t % 5 = 0),
nw AS (SELECT id FROM l WHERE t >= (SELECT max(t) FROM h)),
od AS (SELECT id, row_number() OVER (ORDER BY t DESC, id) AS n FROM l WHERE t <= (SELECT min(t) FROM h))
SELECT DISTINCT id FROM (SELECT id FROM nw UNION ALL SELECT id FROM od WHERE n <= 4000 - (SELECT count(*) FROM nw)) WHERE id NOT IN (SELECT id FROM h)""",
}
