"""Reference SQL of the schema changes: the layouts of the files by JSON functions, other names of columns from a fixed list."""

# The other names that the columns have in the files.
_NAMES = {
    "battle_leads": {"species": ("species_name", "speciesId", "actual_species", "mon_species"), "username": ("player_name", "user"), "lead_slot": ("lead_no", "leadSlot")},
    "battle_team_slot": {
        "player_side": ("side", "playerSide"), "slot_no": ("slotNo", "slot"), "form_status": ("fstat", "status_of_form", "form_state", "formStatus"),
        "was_sent_out": ("sent_out", "deployed", "wasSentOut", "entered_field"),
    },
}
_ROWS = ", ".join(f"('{t}', '{n}', '{c}')" for t, columns in _NAMES.items() for c, names in columns.items() for n in names)

_CHANGES = f"""
WITH r AS (
  SELECT DISTINCT feed, file_no, table_name, line_no, payload FROM raw_record
  WHERE feed IS NOT NULL AND file_no IS NOT NULL AND table_name IN ('battle_leads', 'battle_team_slot') AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
e AS (SELECT feed, file_no, table_name, payload, unnest(json_keys(payload)) AS field FROM r),
k AS (
  SELECT feed, file_no, table_name, field, CASE json_type(payload, '$."' || field || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'whole' WHEN 'UBIGINT' THEN 'whole'
    WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'decimal' END AS kind FROM e),
c AS (SELECT feed, file_no, table_name, field, kind, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT feed, file_no, table_name, field, arg_max(kind, (n, kind)) FILTER (WHERE kind IS NOT NULL) AS kind FROM c GROUP BY ALL),
o AS (SELECT feed, table_name, file_no, lag(file_no) OVER (PARTITION BY feed, table_name ORDER BY file_no) AS before FROM (SELECT DISTINCT feed, table_name, file_no FROM f)),
m AS (SELECT f.*, coalesce(a.col, f.field) AS same FROM f LEFT JOIN (VALUES {_ROWS}) AS a(t, name, col) ON f.table_name = a.t AND f.field = a.name),
b AS (
  SELECT feed, table_name, file_no, same, max(new_field) AS new_field, max(new_kind) AS new_kind, max(old_field) AS old_field, max(old_kind) AS old_kind FROM (
    SELECT o.feed, o.table_name, o.file_no, m.same, m.field AS new_field, m.kind AS new_kind, NULL AS old_field, NULL AS old_kind FROM o JOIN m USING (feed, table_name, file_no) WHERE o.before IS NOT NULL
    UNION ALL SELECT o.feed, o.table_name, o.file_no, m.same, NULL, NULL, m.field, m.kind FROM o JOIN m ON m.feed = o.feed AND m.table_name = o.table_name AND m.file_no = o.before) GROUP BY ALL),
ch AS (
  SELECT feed, file_no, table_name, same AS field, 'added' AS change_kind FROM b WHERE old_field IS NULL
  UNION ALL SELECT feed, file_no, table_name, same, 'removed' FROM b WHERE new_field IS NULL
  UNION ALL SELECT feed, file_no, table_name, same, 'renamed' FROM b WHERE old_field <> new_field
  UNION ALL SELECT feed, file_no, table_name, same, 'retyped' FROM b WHERE old_kind <> new_kind)
"""
FOUND = _CHANGES + "SELECT * FROM ch"
COUNTS = _CHANGES + "SELECT table_name, field, change_kind, count(*) AS files FROM ch GROUP BY ALL"

_TYPES = {"tinyint": "TINYINT", "smallint": "SMALLINT"}


def values(table: str, columns: dict[str, str]) -> str:
    """SQL for the typed columns of one table, each from whichever of its names the record has."""

    def text(name: str) -> str:
        at = f"""json_extract(payload, '$."{name}"')"""
        leaves = lambda path: f"array_to_string(list_filter(json_extract_string({at}, '{path}'), lambda x: x IS NOT NULL), '-')"
        return f"CASE json_type({at}) WHEN 'ARRAY' THEN {leaves('$[*]')} WHEN 'OBJECT' THEN {leaves('$.*')} WHEN 'NULL' THEN NULL ELSE {at} ->> '$' END"

    def plain(value: str) -> str:
        low = f"lower(trim({value}))"
        return f"CASE WHEN {low} IN ('true', 'yes', 'y', 't') THEN '1' WHEN {low} IN ('false', 'no', 'n', 'f') THEN '0' ELSE regexp_replace({low}, '^(-?[0-9]+)\\.0+$', '\\1') END"

    picked = []
    for column, kind in columns.items():
        names = (column, *_NAMES[table].get(column, ()))
        one = [text(n) if kind == "string" else f"CASE WHEN regexp_full_match({plain(text(n))}, '-?[0-9]+') THEN try_cast({plain(text(n))} AS {_TYPES[kind]}) END" for n in names]
        picked.append(f"coalesce({', '.join(one)}) AS {column}")
    return f"""
WITH r AS (SELECT DISTINCT feed, file_no, line_no, payload FROM raw_record WHERE table_name = '{table}' AND feed IS NOT NULL AND file_no IS NOT NULL)
SELECT feed, file_no, line_no, {', '.join(picked)} FROM r"""
