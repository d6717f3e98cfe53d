"""Problem 2: schemas that drift between files, by rescue-column ingestion.

Records come as JSON objects of files with changing layouts. `ingest` enforces a target
schema: a known column is brought to its type, and all that is unknown or cannot be cast
stays as JSON in the column `_rescued`; `_layout` keeps under which names and kinds the fields came. Everything
else works on what was ingested: `learn_names` finds other names of a column among the rescued fields,
`replay` brings their values and approved fields into typed columns, and `changes` lists, file by file,
what was added, removed, renamed or retyped.

Other names of a column are learned from content: the name never stands in a file
beside the column, and its values are the column's values. Only counts per (table, field, value) and
the layouts of the files are needed, all summed with map-side aggregation.

A file is one row with an array of its fields, and files are compared inside rows. Nothing that grows with the
records or the files is broadcast: a written table of files is many times larger in memory than on disk, so
joins of such tables are told to merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import Scratch

#: Target schemas.
LAYOUTS = {
    "battle_leads": {"battle_id": "string", "username": "string", "pokemon_name": "string", "species": "string", "lead_slot": "tinyint"},
    "battle_team_slot": {
        "battle_id": "string", "player_side": "string", "slot_no": "smallint", "pokemon_name": "string", "is_lead": "tinyint",
        "species_observed": "string", "form_status": "string", "was_sent_out": "tinyint",
    },
}
#: A column whose values are as concentrated as those of so many equally frequent ones must also be distributed alike.
FEW_VALUES = 20
#: The values of a column hardly repeat if there are so many distinct ones per value.
FRESH = 0.2
#: Lines of one file whose numbers share this many following values are brought together.
LINES_A_PART = 65536
#: Files of one feed whose numbers share this many following values are ordered in one task.
FILES_A_PART = 4096


def kind_of(kind: str) -> str:
    """SQL for the kind of a JSON value, from its variant schema: text, whole, decimal, bool, list or object; null for JSON null."""
    return (
        f"CASE WHEN {kind} = 'VOID' THEN NULL WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} = 'BOOLEAN' THEN 'bool' WHEN {kind} = 'BIGINT' THEN 'whole' "
        f"WHEN startswith({kind}, 'ARRAY') THEN 'list' WHEN startswith({kind}, 'OBJECT') THEN 'object' ELSE 'decimal' END"
    )


def text_of(value: Column, kind: Column | None = None) -> Column:
    """A JSON value as text; lists and objects by their values. kind: its variant schema, if it is at hand."""
    text = F.try_variant_get(value, "$", "string")
    return F.when((F.schema_of_variant(value) if kind is None else kind).rlike("^(ARRAY|OBJECT)"), leaves(text)).otherwise(text)


def leaves(json: Column) -> Column:
    """The values of a JSON list or object, without names and nulls, joined with '-'."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"\s*:', "")
    parts = F.regexp_extract_all(bare, F.lit(r'("(?:[^"\\]|\\.)*"|[^\[\]{},\s"]+)'), F.lit(1))
    return F.array_join(F.transform(F.filter(parts, lambda p: p != "null"), lambda p: F.regexp_replace(p, r'^"|"$', "")), "-")


def plain_value(text: Column) -> Column:
    """Form in which values of different types are compared and cast: 1.0, true and Y are 1."""
    t = F.lower(F.trim(text))
    t = F.when(t.isin("true", "yes", "y", "t"), "1").when(t.isin("false", "no", "n", "f"), "0").otherwise(F.regexp_replace(t, r"^(-?[0-9]+)\.0+$", "$1"))
    return t


def ingested_values(ingested: dict[str, DataFrame], layouts: dict[str, dict[str, str]]) -> DataFrame:
    """(table_name, field, known, value, n): counts of the typed values of the columns and of the rescued values of unknown fields."""
    out = None
    for table, rows in ingested.items():
        columns = list(layouts[table])
        typed = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])
        kept = F.from_json("_rescued", "map<string,variant>")
        known = rows.select(F.explode(typed).alias("e")).select("e.field", F.lit(True).alias("known"), "e.text")
        other = rows.where("_rescued IS NOT NULL").select(F.explode(kept).alias("field", "v")).where(~F.col("field").isin(columns)).select("field", F.lit(False).alias("known"), text_of(F.col("v")).alias("text"))
        # texts are counted as they are first, so that each is brought to its plain form once
        part = known.unionByName(other).where("text IS NOT NULL").groupBy("field", "known", "text").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), "field", "known", F.regexp_replace(plain_value(F.col("text")), r"[^\p{L}\p{N}]", "").alias("value"), "n")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table_name", "field", "known", "value").agg(F.sum("n").alias("n"))


def learn_names(ingested: dict[str, DataFrame], files: DataFrame, layouts: dict[str, dict[str, str]] = LAYOUTS, scratch: Scratch | None = None) -> DataFrame:
    """(table_name, field, column): the other names under which target columns are written.

    files: (feed, table_name, file_no, fields, before), see `with_previous`. A name that never stands beside a column in a file is taken for it if
    its values are the column's. Where a column's values hardly repeat, so is one that comes in exactly where the column goes, or goes
    where it comes in, provided that no other name or column changes there and its values look alike.
    """
    counts = (scratch or Scratch(next(iter(ingested.values())).sparkSession, "drift")).save(ingested_values(ingested, layouts))
    totals = counts.groupBy("table_name", "field", "known").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("values"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    shares = counts.join(totals, ["table_name", "field", "known"]).withColumn("share", F.col("n") / F.col("all")).withColumn("spread", F.col("all").cast("double") * F.col("all") / F.col("squares"))
    mine = shares.where("NOT known").select("table_name", "field", "value", "share")
    theirs = shares.where("known").select("table_name", F.col("field").alias("column"), "value", F.col("share").alias("other"), "spread")
    alike = theirs.join(mine.hint("merge"), ["table_name", "value"]).groupBy("table_name", "field", "column").agg(
        F.sum("share").alias("held"), F.sum(F.least("share", "other")).alias("overlap"), F.max("spread").alias("spread")
    )
    columns = F.create_map(*[x for table, names in layouts.items() for x in (F.lit(table), F.array(*map(F.lit, names)))])[F.col("table_name")]
    own = files.select("table_name", F.col("fields.field").alias("names")).distinct().select("table_name", F.array_except("names", columns).alias("others"), F.array_intersect("names", columns).alias("columns"))
    beside = own.select("table_name", F.explode("others").alias("field"), "columns").select("table_name", "field", F.explode("columns").alias("column")).distinct()
    few = F.col("spread") <= FEW_VALUES
    fit = alike.where(F.when(few, (F.col("held") >= 0.9) & (F.col("overlap") >= 0.5)).otherwise(F.col("held") >= 0.3)).select("*", F.lit(0).alias("by"))
    swapped = _shapes(counts, totals, _swaps(files, columns)).select("table_name", "field", "column", F.col("shared").alias("held"), F.lit(0.0).alias("overlap"), F.lit(0.0).alias("spread"), F.lit(1).alias("by"))
    best = Window.partitionBy("table_name", "field").orderBy("by", F.desc("held"), F.desc("overlap"), "column")
    chosen = fit.unionByName(swapped).join(beside, ["table_name", "field", "column"], "left_anti")
    return chosen.withColumn("r", F.row_number().over(best)).where("r = 1").select("table_name", "field", "column")


def _swaps(files: DataFrame, columns: Column) -> DataFrame:
    """(table_name, field, column): an unknown name and a column of which one goes and one comes in between two files of a feed, and nothing else does."""
    steps = files.where("before IS NOT NULL").select("table_name", F.col("fields.field").alias("fields"), F.col("before.field").alias("before")).distinct()
    moves = steps.select("table_name", F.array_except("fields", "before").alias("came"), F.array_except("before", "fields").alias("went"), columns.alias("columns")).where("size(came) = 1 AND size(went) = 1")
    moves = moves.select("table_name", F.array_union("came", "went").alias("both"), "columns").select("table_name", F.array_except("both", "columns").alias("names"), F.array_intersect("both", "columns").alias("columns"))
    return moves.where("size(names) = 1 AND size(columns) = 1").select("table_name", F.col("names")[0].alias("field"), F.col("columns")[0].alias("column")).distinct()


def _shapes(counts: DataFrame, totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(table_name, field, column, shared): how far the shapes of a name's values, such as letters or digits, are those of a column whose values hardly repeat.

    Only the given pairs (table_name, field, column) are looked at.
    """
    many = totals.where("known").where(F.col("values") / F.col("all") >= FRESH).select("table_name", F.col("field").alias("column"))
    pairs = pairs.join(many, ["table_name", "column"])
    asked = pairs.select("table_name", "field", F.lit(False).alias("known")).unionByName(pairs.select("table_name", F.col("column").alias("field"), F.lit(True).alias("known"))).distinct()
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), r"[0-9]+", "9")
    rows = counts.join(asked, ["table_name", "field", "known"], "left_semi").groupBy("table_name", "field", "known", shape.alias("shape")).agg(F.sum("n").alias("n"))
    rows = rows.join(totals.select("table_name", "field", "known", "all"), ["table_name", "field", "known"]).withColumn("share", F.col("n") / F.col("all"))
    mine = rows.where("NOT known").select("table_name", "field", "shape", "share")
    theirs = rows.where("known").select("table_name", F.col("field").alias("column"), "shape", F.col("share").alias("other"))
    both = pairs.join(mine, ["table_name", "field"]).join(theirs.hint("merge"), ["table_name", "column", "shape"]).groupBy("table_name", "field", "column").agg(F.sum(F.least("share", "other")).alias("shared"))
    return both.where("shared >= 0.8")


def with_previous(files: DataFrame) -> DataFrame:
    """(feed, table_name, file_no, fields, before): each file with the fields of the one with the next smaller number of its feed and table.

    Ordered within parts of the numbers; the first file of a part follows the last of the part
    before, so a feed with very many files is no single task.
    """
    own = ["feed", "table_name"]
    parted = files.withColumn("part", F.floor(F.col("file_no") / F.lit(FILES_A_PART)))
    last = parted.groupBy(*own, "part").agg(F.max_by("fields", "file_no").alias("last"))
    carry = last.select(*own, "part", F.lag("last").over(Window.partitionBy(*own).orderBy("part")).alias("carry")).where("carry IS NOT NULL")
    inside = F.lag("fields").over(Window.partitionBy(*own, "part").orderBy("file_no"))
    joined = parted.withColumn("inside", inside).join(carry.hint("merge"), [*own, "part"], "left")
    return joined.select(*own, "file_no", "fields", F.coalesce("inside", "carry").alias("before"))


def file_layouts(ingested: dict[str, DataFrame]) -> DataFrame:
    """(feed, table_name, file_no, fields): each file with its fields as an ordered array of (field, kind), of the kind of most non-null values; null if all are null.

    Records of one layout are counted first, so that only the layouts of a file are taken apart.
    """
    own = ["feed", "table_name", "file_no"]
    layouts = None
    for table, rows in ingested.items():
        part = rows.select("feed", F.lit(table).alias("table_name"), "file_no", F.sort_array(F.map_entries("_layout")).alias("layout")).where("size(layout) > 0").groupBy(*own, "layout").agg(F.count(F.lit(1)).alias("n"))
        layouts = part if layouts is None else layouts.unionByName(part)
    values = layouts.repartition(*own).select(*own, "n", F.inline("layout").alias("field", "kind"))
    counts = values.groupBy(*own, "field", "kind").agg(F.sum("n").alias("n"))
    most = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
    fields = counts.groupBy(*own, "field").agg(most["kind"].alias("kind"))
    return fields.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("field", "kind"))).alias("fields"))


class Ingestion:
    """The records of all tables under their target schemas, written once, with what was learned of them."""

    def __init__(self, raw: DataFrame, layouts: dict[str, dict[str, str]] = LAYOUTS):
        self.scratch, self.layouts = Scratch(raw.sparkSession, "drift"), layouts
        placed = raw.where("feed IS NOT NULL AND file_no IS NOT NULL")
        self.tables = {t: self.scratch.save(ingest(placed, t, types)) for t, types in layouts.items()}
        self.files = self.scratch.save(with_previous(file_layouts(self.tables)))
        self.names = self.scratch.save(learn_names(self.tables, self.files, layouts, self.scratch))

    def name_map(self, table: str) -> dict[str, list[str]]:
        """column -> its other names. Names are few: each stands for a target column."""
        out: dict[str, list[str]] = {}
        for r in self.names.where(F.col("table_name") == table).orderBy("column", "field").collect():
            out.setdefault(r.column, []).append(r.field)
        return out

    def replayed(self, table: str, promoted: dict[str, str]) -> DataFrame:
        """One table with the values of all names in their columns and the approved fields promoted."""
        return replay(self.tables[table], promoted, self.layouts[table], self.name_map(table)).drop("_layout")


def changes(raw: DataFrame, layouts: dict[str, dict[str, str]] = LAYOUTS) -> DataFrame:
    """(feed, file_no, table_name, field, change_kind) of each file against the one before it, from what was ingested.

    change_kind is added, removed, renamed or retyped; a field that is both gives two rows. field is
    the target column if it is one under any name, else the name in the file. The first file of a feed
    and a file without fields give no rows; a file without fields is passed over. Rows without feed,
    table or number are left out.
    """
    held = Ingestion(raw, layouts)
    others = {t: [F.lit(v) for column, names in held.name_map(t).items() for n in names for v in (n, column)] for t in layouts}
    maps = [v for t, pairs in others.items() if pairs for v in (F.lit(t), F.create_map(*pairs))]
    target = F.try_element_at(F.create_map(*maps), F.col("table_name")) if maps else F.lit(None).cast("map<string,string>")

    def entries(fields: str) -> Column:
        return F.sort_array(F.transform(fields, lambda x: F.struct(F.coalesce(F.try_element_at(F.col("target"), x["field"]), x["field"]).alias("same"), x.alias("held"))))

    def by_column(held: str) -> Column:  # of several names of one column in a file the last counts
        ends = F.filter(held, lambda x, i: F.coalesce(F.get(F.col(held), i + 1)["same"] != x["same"], F.lit(True)))
        return F.map_from_entries(ends)

    steps = held.files.where("before IS NOT NULL AND fields <> before").withColumn("target", target)
    steps = steps.withColumns({"new": entries("fields"), "old": entries("before")}).withColumns({"new": by_column("new"), "old": by_column("old")})
    both = steps.select("feed", "table_name", "file_no", "new", "old", F.explode(F.array_union(F.map_keys("new"), F.map_keys("old"))).alias("same"))
    both = both.withColumns({c: F.try_element_at(c, F.col("same")) for c in ("new", "old")})
    kinds = F.array_compact(F.array(
        F.when(F.col("old").isNull(), "added"), F.when(F.col("new").isNull(), "removed"),
        F.when(F.col("old.field") != F.col("new.field"), "renamed"), F.when(F.col("old.kind") != F.col("new.kind"), "retyped"),
    ))
    return both.select("feed", "file_no", "table_name", F.col("same").alias("field"), F.explode(kinds).alias("change_kind"))


def _typed(value: Column, kind: str, schema: Column | None = None) -> Column:
    """A JSON value in a target type, null if it cannot be cast; lists and objects by their values, 1.0, true and Y as 1."""
    return text_of(value, schema) if kind == "string" else plain_value(text_of(value, schema)).try_cast(kind)


def ingest(raw: DataFrame, table: str, types: dict[str, str]) -> DataFrame:
    """The records of one table under its target schema, with feed, file, line, `_rescued` and `_layout`.

    A value of another JSON type is cast. Unknown fields that are not null, values that cannot be cast and payloads that are no
    JSON objects (under '_payload') are kept in `_rescued`, a JSON object with the values as they were, null if there is nothing
    to keep. `_layout` maps every field of the record to its kind. Whole-row copies count once. Of a field that a record has twice the
    first counts. Each payload is parsed once; no shuffle but for the copies, which leaves the records of a file together, up to
    LINES_A_PART lines.
    """
    part = F.coalesce(F.shiftright("line_no", LINES_A_PART.bit_length() - 1), F.pmod(F.xxhash64("payload"), F.lit(16)).cast("int"))
    rows = raw.where(F.col("table_name") == table).select("feed", "file_no", part.alias("_part"), "line_no", "payload").repartition("feed", "file_no", "_part").distinct().drop("_part")
    rows = rows.withColumn("_map", F.from_json("payload", "map<string,variant>"))
    rows = rows.withColumn("_kinds", F.transform_values("_map", lambda k, v: F.schema_of_variant(v)))
    rows = rows.withColumns({f"_v_{c}": F.try_element_at("_map", F.lit(c)) for c in types} | {f"_k_{c}": F.try_element_at("_kinds", F.lit(c)) for c in types})
    rows = rows.withColumns({f"_t_{c}": _typed(F.col(f"_v_{c}"), kind, F.col(f"_k_{c}")) for c, kind in types.items()})
    failed = F.array_compact(F.array(*[F.when(F.col(f"_v_{c}").isNotNull() & F.col(f"_t_{c}").isNull(), F.lit(c)) for c in types]))
    known = list(types)
    kept = F.map_filter("_map", lambda k, v: ~F.is_variant_null(v) & (~k.isin(known) | F.array_contains(F.col("_failed"), k)))
    broken = F.when(F.col("_map").isNull() & F.col("payload").isNotNull(), F.to_json(F.create_map(F.lit("_payload"), F.col("payload"))))
    rows = rows.withColumn("_failed", failed).withColumn("_kept", kept)
    layout = F.expr(f"transform_values(_kinds, (k, v) -> {kind_of('v')})")
    return rows.select(
        "feed", "file_no", "line_no", *[F.col(f"_t_{c}").alias(c) for c in types],
        F.coalesce(F.when(F.size("_kept") > 0, F.to_json("_kept")), broken).alias("_rescued"), layout.alias("_layout"),
    )


def replay(ingested: DataFrame, promoted: dict[str, str], types: dict[str, str] | None = None, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Replays rescued values: those of approved fields become typed columns, those under other names of a column fill it.

    promoted: name -> type. types, names: column -> type and column -> its other names. Replayed values leave `_rescued`; a value that cannot
    be cast stays there; a promoted name that is a column already fills its nulls.
    """
    rows = ingested.withColumn("_kept", F.from_json("_rescued", "map<string,variant>"))
    sources = {c: [(n, (types or {})[c]) for n in others] for c, others in (names or {}).items()}
    for name, kind in promoted.items():
        sources.setdefault(name, []).append((name, kind))
    done, outs = [], {}
    for column, held in sources.items():
        values = []
        for name, kind in held:
            raw_value = F.try_element_at("_kept", F.lit(name))
            values.append(text_of(raw_value).try_cast("boolean") if kind == "boolean" else _typed(raw_value, kind))
            done.append(F.when(raw_value.isNotNull() & values[-1].isNotNull(), F.lit(name)))
        outs[column] = F.coalesce(*([F.col(column)] if column in ingested.columns else []), *values)
    rows = rows.withColumn("_done", F.array_compact(F.array(*done)) if done else F.array().cast("array<string>")).withColumns(outs)
    left = F.map_filter("_kept", lambda k, v: ~F.array_contains(F.col("_done"), k))
    return rows.withColumn("_left", left).withColumn("_rescued", F.when(F.size("_left") > 0, F.to_json("_left"))).drop("_kept", "_done", "_left")
