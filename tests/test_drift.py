"""Schema drift: changes, ingestion and replay on small files."""

import json

from pyspark.sql import functions as F

from duelframe.operators import drift as D

SCHEMA = "feed string, file_no int, table_name string, line_no int, payload string, field string"


def rows(feed, no, records, table="battle_team_slot"):
    return [(feed, no, table, i, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for i, r in enumerate(records)]


def base(i, **kw):
    return {"battle_id": f"b{i}", "player_side": f"p{i % 2 + 1}", "slot_no": i % 6 + 1, "form_status": ["listed", "observed"][i % 2], "was_sent_out": i % 2} | kw


def without(d, *names, **new):
    return {k: v for k, v in d.items() if k not in names} | new


def test_changes(spark):
    first = [base(i) for i in range(8)]
    second = [without(b, "was_sent_out", "form_status", deployed=float(b["was_sent_out"]), fs=b["form_status"], level=50) for b in first]
    third = [without(b, "slot_no", "level") for b in second]
    third[0]["deployed"] = "x"  # a single value of another type
    data = rows("f", 1, first) + rows("f", 2, second) + rows("f", 5000, third) + rows("f", 5001, ["not json", None, "[1]"]) + rows("g", 1, first) + rows("f", 1, first)
    got = {tuple(r) for r in D.changes(spark.createDataFrame(data, SCHEMA)).collect()}
    t = "battle_team_slot"
    assert got == {
        ("f", 2, t, "was_sent_out", "renamed"), ("f", 2, t, "was_sent_out", "retyped"), ("f", 2, t, "form_status", "renamed"), ("f", 2, t, "level", "added"),
        ("f", 5000, t, "slot_no", "removed"), ("f", 5000, t, "level", "removed"),
    }
    assert D.changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_rename_of_a_column_with_too_few_shared_values(spark):
    names = lambda k, n: [{"battle_id": f"b{k}{i}", "pokemon_name": "Nick", n: f"Name{k}{chr(97 + i)}"} for i in range(8)]
    data = rows("f", 1, names(1, "species"), "battle_leads") + rows("f", 2, names(2, "mon_species"), "battle_leads") + rows("f", 3, [without(r, "mon_species") for r in names(3, "mon_species")], "battle_leads")
    got = {tuple(r) for r in D.changes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {("f", 2, "battle_leads", "species", "renamed"), ("f", 3, "battle_leads", "species", "removed")}


def test_stray_values_do_not_change_how_a_column_is_judged(spark):
    many = [base(i) for i in range(200)] + [base(i, was_sent_out=100 + i) for i in range(30)]
    other = [without(base(i), "was_sent_out", rev=7 + i % 2) for i in range(200)]
    for first in (many, many[:200]):
        got = {r.change_kind for r in D.changes(spark.createDataFrame(rows("f", 1, first) + rows("f", 2, other), SCHEMA)).collect()}
        assert got == {"added", "removed"}


def test_ingest_and_replay(spark):
    data = rows("f", 1, [base(1, slot_no="2", was_sent_out="Y", form_status=["listed"]), base(2, slot_no="many", level=50, extra={"a": 1}), {"battle_id": None}, "broken", None, '{"slot_no": 3, "slot_no": 4}'])
    types = D.LAYOUTS["battle_team_slot"]
    df = D.ingest(spark.createDataFrame(data + data, SCHEMA), "battle_team_slot", types)
    out = {r.line_no: r for r in df.collect()}
    assert len(out) == df.count() == 6
    assert (out[0].slot_no, out[0].was_sent_out, out[0].form_status, out[0]._rescued) == (2, 1, "listed", None)
    assert out[0]._layout["slot_no"] == "text" and out[0]._layout["form_status"] == "list" and out[2]._layout == {"battle_id": None} and out[3]._layout is None
    assert out[1].slot_no is None and json.loads(out[1]._rescued) == {"slot_no": "many", "level": 50, "extra": {"a": 1}}
    assert out[2]._rescued is None and json.loads(out[3]._rescued) == {"_payload": "broken"} and out[4].battle_id is None and out[5].slot_no == 3
    again = {r.line_no: r for r in D.replay(df, {"level": "int", "slot_no": "smallint"}).collect()}
    assert again[1].level == 50 and json.loads(again[1]._rescued) == {"slot_no": "many", "extra": {"a": 1}} and again[0].level is None


def test_changes_and_tables_come_through_the_rescued_values(spark):
    first = [base(i) for i in range(8)]
    second = [without(b, "was_sent_out", deployed="Y" if b["was_sent_out"] else "N", level=50) for b in first]
    held = D.Ingestion(spark.createDataFrame(rows("f", 1, first) + rows("f", 2, second), SCHEMA))
    assert held.name_map("battle_team_slot") == {"was_sent_out": ["deployed"]}
    out = held.replayed("battle_team_slot", {"level": "int"}).collect()
    assert {(r.file_no, r.was_sent_out, r.level) for r in out} == {(1, 0, None), (1, 1, None), (2, 0, 50), (2, 1, 50)} and {r._rescued for r in out} == {None}
    # without the rescued values the other name is not known
    bare = {t: df.withColumn("_rescued", F.lit(None).cast("string")) for t, df in held.tables.items()}
    assert D.learn_names(bare, held.files).count() == 0


def test_files_are_compared_without_a_broadcast(spark):
    data = rows("f", 1, [base(i) for i in range(8)]) + rows("f", 9000, [base(i, level=50) for i in range(8)]) + rows("f", 9001, [base(i, level=5.5) for i in range(8)])
    found = D.changes(spark.createDataFrame(data, SCHEMA))
    assert {(r.file_no, r.field, r.change_kind) for r in found.collect()} == {(9000, "level", "added"), (9001, "level", "retyped")}
    assert "Join" not in found._jdf.queryExecution().toString()
    files = spark.createDataFrame([("f", "t", 1, [("a", "text")]), ("f", "t", 9000, [("b", "text")])], "feed string, table_name string, file_no int, fields array<struct<field:string,kind:string>>")
    linked = D.with_previous(files)
    assert "BroadcastHashJoin" not in linked._jdf.queryExecution().toString()
    assert {(r.file_no, r.before and r.before[0].field) for r in linked.collect()} == {(1, None), (9000, "a")}
