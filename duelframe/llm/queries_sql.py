"""Reference SQL of the llm problems, where SQL can express them over whole tables."""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8203) || chr(12288) || chr(65279)"


def _cleaned(text: str, *steps: tuple[str, str]) -> str:
    """The text after the given replacements, one after the other."""
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def _replay_id(col: str) -> str:
    plain = _cleaned(f"replace(lower(trim({col}, {BLANKS})), '_', '-')", ("^(battle-)+", ""), ("^(.*-[0-9]+)-[a-z0-9]+pw$", "\\1"))
    return f"nullif({plain}, '')"


def _replay_place(col: str) -> str:
    plain = f"replace(lower(url_decode(replace(trim({col}, {BLANKS}), '+', '%2B'))), '\\', '/')"
    back = ("(^|/)([^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\./", "\\1")
    plain = _cleaned(plain, ("/{2,}", "/"), ("(^|/)(\\./)+", "\\1"), back, back, back, ("^(|.*?/)((data|replays|recrawl)/.*)$", "\\2"), ("^/+", ""), ("\\.(gz|zst|bz2|xz|zip)$", ""), ("\\s*\\([0-9]+\\)(\\.[a-z0-9]+)$", "\\1"))
    return f"nullif(trim({plain}, {BLANKS}), '')"


_REPEATS = f"""
WITH RECURSIVE raw AS (
  SELECT DISTINCT epoch_us(coalesce(loaded_at, TIMESTAMP '1970-01-01')) - 4611686018427387904 AS ord, battle_id, replay_path FROM battle
  UNION ALL SELECT DISTINCT row_id, battle_id, replay_path FROM battle_arrival WHERE row_id IS NOT NULL),
spelled AS (SELECT ord, battle_id, {_replay_id('battle_id')} AS id, {_replay_place('replay_path')} AS place FROM raw),
keys AS (
  SELECT ord, battle_id, 'id' AS kind, id AS text FROM spelled WHERE id IS NOT NULL
  UNION SELECT ord, battle_id, 'place', place FROM spelled WHERE place IS NOT NULL
  UNION SELECT ord, battle_id, 'id', {_replay_id("regexp_extract(place, '^replays/(?:.*/)?([^/#]+)\\.log$', 1)")} FROM spelled
    WHERE {_replay_id("regexp_extract(place, '^replays/(?:.*/)?([^/#]+)\\.log$', 1)")} IS NOT NULL),
firsts AS (SELECT kind, text, min((ord, battle_id)) AS o FROM keys GROUP BY kind, text),
links AS (
  SELECT k.ord AS row_id, min(f.o) AS o FROM keys k JOIN firsts f ON k.kind = f.kind AND k.text = f.text
  WHERE k.ord > 0 AND f.o[1] < k.ord GROUP BY k.ord),
chain AS (
  SELECT row_id, o FROM links
  UNION SELECT c.row_id, l.o FROM chain c JOIN links l ON c.o[1] = l.row_id),
known AS (SELECT row_id, min(o)[2] AS first_battle_id FROM chain GROUP BY row_id)
"""
P4_FOUND = _REPEATS + "SELECT row_id, first_battle_id FROM known"
P4_ARRIVALS = _REPEATS + """
SELECT DISTINCT a.row_id, a.batch_no, k.first_battle_id, k.first_battle_id IS NULL AS is_new FROM battle_arrival a LEFT JOIN known k ON a.row_id = k.row_id"""

_PAIRS = f"""
WITH m AS (
  SELECT DISTINCT nullif(lower(trim(battle_id, {BLANKS})), '') AS b, nullif(lower(trim(player_side, {BLANKS})), '') AS s, lower(trim(pokemon_name, {BLANKS})) AS item
  FROM battle_team_slot WHERE pokemon_name IS NOT NULL),
k AS (SELECT * FROM m WHERE b IS NOT NULL AND s IS NOT NULL),
t AS (SELECT count(*) AS n FROM (SELECT DISTINCT b, s FROM k)),
i AS (SELECT item, count(*) AS n FROM k GROUP BY item),
p AS (SELECT x.item AS name_a, y.item AS name_b, count(*) AS n_ab FROM k x JOIN k y ON x.b = y.b AND x.s = y.s AND x.item < y.item GROUP BY ALL),
r AS (SELECT name_a, name_b, n_ab, a.n AS n_a, c.n AS n_b, t.n FROM p JOIN i a ON a.item = name_a JOIN i c ON c.item = name_b CROSS JOIN t)
"""
P5_FOUND = _PAIRS + "SELECT name_a, name_b FROM r WHERE n_ab >= 10 AND n_ab::HUGEINT * n >= 3 * n_a::HUGEINT * n_b"
P5_PAIRS = _PAIRS + "SELECT name_a, name_b, n_ab, n_a, n_b, n, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift FROM r"

# Words and marks stand for tokens: the sources that are short are so under any common count of tokens.
P8_FOUND = """
WITH t AS (SELECT DISTINCT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[\\pL]{1,4}|[\\pN]{1,3}|[^\\s\\pL\\pN]')) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
s AS (SELECT source, sum(n) AS n FROM t GROUP BY source)
SELECT DISTINCT m.source FROM mix_target m LEFT JOIN s ON m.source = s.source
WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * (SELECT coalesce(sum(n), 0) FROM s)"""

SQL = {"p4_found": P4_FOUND, "p4_arrivals": P4_ARRIVALS, "p5_found": P5_FOUND, "p5_pairs": P5_PAIRS, "p8_found": P8_FOUND}
