"""Master tables, saved teams, diagnosis of names and the quality checks on small tables."""

from pyspark.sql import functions as F

from duelframe.functions import contest as X
from duelframe.operators import diagnosis as D
from duelframe.operators import master as M
from duelframe.operators import quality as Q
from duelframe.sources import crawl

SIX = (1, 2, 3, 4, 5, 6)


def test_saved_teams_come_back_as_they_were(spark):
    member = lambda name, level=50, moves=("a", "b", "a"): (name, "ab", None, "calm", level, list(moves), SIX, SIX[::-1])
    teams = [("one", [member("x"), member("x", moves=()), member("y")]), ("two", [member("z", None)]), ("none", [])]
    df = spark.createDataFrame(teams, M.TEAM)
    tables = M.flat_teams(df)
    assert {n: t.count() for n, t in tables.items()} == {"team_master": 3, "team_pokemon": 4, "team_pokemon_moves": 9, "team_pokemon_evs": 4, "team_pokemon_ivs": 4}
    back = {r.team_name: r.members for r in M.nested_teams(M.team_members(tables)).collect()}
    assert set(back) == {"one", "two"} and [(m.pokemon, m.moves, tuple(m.ivs), tuple(m.evs), m.item) for m in back["one"]] == [(n, mv, SIX, SIX[::-1], None) for n, mv in (("x", ["a", "b", "a"]), ("x", []), ("y", ["a", "b", "a"]))]
    assert back["two"][0].level == 50
    (row,) = M.member_text(M.team_members(tables, "two")).collect()
    assert row.text.startswith("\nZ @ None\nAbility: ab\nLevel: 50\nCalm Nature\n\nEVs:\nHP  6\n") and row.text.endswith("Moves:\n\n- a\n- b\n- a")
    assert M.team_members(tables, "absent").count() == 0 and M.flat_teams(df.limit(0))["team_pokemon"].count() == 0


def test_types_of_creatures(spark):
    stats = spark.createDataFrame([(1, "a", *SIX), (2, "b", *SIX), (2, "b", *SIX)], "poke_id int, pokemon string, hp int, atk int, def int, spatk int, spdef int, spe int")
    owned = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 2, 9), (3, 1, 7)], "pokemon_id int, slot int, type_id int")
    types = spark.createDataFrame([(7, "fire"), (8, "ice")], "type_id int, type string")
    assert {tuple(r)[:4] for r in M.with_types(stats, owned, types).collect()} == {(1, "a", "fire", "ice"), (2, "b", None, None)}
    assert M.first_of_key(types, [F.col("type_id")], type="ice").first().type_id == 8 and M.first_of_key(types, [F.col("type_id")], type="none").count() == 0


def test_texts(spark):
    rows = spark.createDataFrame([(" Flash_Fire x", "Mr. X-2", "http://h/a/12//", [("fr", "f"), ("en", None), ("en", "x")]), (None, None, "http://h/a/", [("fr", "f")]), ("", "É", None, None)], "a string, b string, c string, d array<struct<language:string,short_effect:string>>")
    got = [tuple(r) for r in rows.select(X.ability_slug(rows.a), X.id_string(rows.b), X.id_of_url(rows.c), X.english_text(rows.d)).collect()]
    assert got == [("flash-fire-x", "mrx2", 12, ""), ("", None, None, None), ("", "", None, None)]


def _log(*more, left="|showteam|p1|A||i]Nick|Bb-Red|i]C|", right="|showteam|p2|D|]E|]F|"):
    listed = [f"|poke|p1|{n}, L50|" for n in ("A", "Nick-*", "C")] + [f"|poke|p2|{n}|" for n in ("D", "E", "F")]
    return "\n".join([*listed, left, right, "|", "|turn|1", *more])


def test_completeness_and_masked_names(spark):
    logs = spark.createDataFrame([("whole", _log()), ("disguised", _log("|x|Zoruark Zorua")), ("twins", _log(right="|showteam|p2|D|]D-E|]F|")), ("none", _log(right="")), ("short", _log().replace("|turn|1", "")), ("null", None)], "battle_id string, log string")
    assert {r.battle_id: r.ok for r in logs.select("battle_id", D.is_complete(F.col("log"), 3).alias("ok")).collect()} == {"whole": True, "disguised": False, "twins": False, "none": False, "short": False, "null": False}
    masked = spark.createDataFrame([("m", "|poke|p1|Bb-*, M|\n|poke|p2|Bb-*|\n|showteam|p1|Nick|Bb-Red|i]Bbx||\n|switch|p2a: y|Bb-Blue, M|1\n|drag|p2b: z|Bb|1\n|switch|p1a: q|Bby|1"), ("n", "|poke|p1|A|")], "battle_id string, log string")
    assert {(r.side, r.base): (r.by_team, r.by_events) for r in D.masked_slots(masked).collect()} == {("p1", "Bb"): (["Bb-Red"], []), ("p2", "Bb"): ([], ["Bb", "Bb-Blue"])}
    assert [tuple(r) for r in D.resolvability(D.masked_slots(masked)).collect()] == [("Bb", 2, 1, 1, 1, 0)]
    assert {tuple(r) for r in D.detail_frequency(masked, "bB-").collect()} == {("poke", "Bb-*, M", 1), ("poke", "Bb-*", 1), ("switch", "Bb-Blue, M", 1)}


def test_quality_checks(spark):
    rows = spark.createDataFrame([("g", f"b{i:02d}", i) for i in range(25)] + [("h", "b00", 0), (None, None, 1)], "part string, battle_id string, n int")
    kept = Q.without_edge_contests(rows, "part", [F.col("n")])
    assert kept.count() == 25 and {r.battle_id for r in kept.where("part = 'g'").collect()} == {f"b{i:02d}" for i in range(1, 24)}
    assert Q.first_rows(rows, "part", [F.col("n")], 2).count() == 4 and Q.first_rows(rows, "part", [], 0).count() == 27
    assert Q.first_contests(rows, 1).count() == 2 and Q.of_contests(rows, rows.limit(0)).count() == 0
    assert {tuple(r) for r in Q.rows_per_contest(rows).collect()} == {(1, 25), (2, 1)}
    players = spark.createDataFrame([(700,), (800,), (None,)], "rating_before int")
    assert tuple(Q.odd_ratings(players).first()) == (2, 1)
    share = spark.createDataFrame([(0.99,), (0.98,)], "share double")
    assert [r.passes for r in Q.coverage_gate(share).collect()] == [True, False]


def test_crawl_goes_forward_then_backward(spark, tmp_path):
    (tmp_path / "1.json").write_text('[{"id": "g-9", "uploadtime": 90}, {"id": "g-5", "uploadtime": 50}, {"id": "x-9", "uploadtime": 95}]')
    (tmp_path / "2.json").write_text('[{"id": "g-5", "uploadtime": 50}, {"id": "g-3", "uploadtime": 30}, {"id": "g-2", "uploadtime": 20}, {"id": "g-0", "uploadtime": null}]')
    listing = crawl.read_pages(spark, str(tmp_path))
    held = spark.createDataFrame([("g-5", 50, "old"), ("g-4", 40, "old")], crawl.REPLAY)
    ids = lambda want, h=held: {r.id for r in crawl.next_ids(listing, h, "g-", want).collect()}
    assert ids(0) == {"g-9"} and ids(3) == {"g-9", "g-3"} and ids(99) == {"g-9", "g-3", "g-2"} and ids(2, held.limit(0)) == {"g-9", "g-5"}
    whole = "\n".join([*[f"|poke|p{s}|{n}|" for s in (1, 2) for n in "ABCDEF"], *[f"|showteam|p{s}|A|]B|]C|]D|]E|]F|" for s in (1, 2)], "|", "|turn|1"])
    fetched = spark.createDataFrame([("g-5", 50, whole), ("g-9", 90, whole), ("g-9", 91, whole), ("g-3", 30, "|turn|1"), ("g-2", 20, None)], crawl.REPLAY)
    assert {(r.id, r.uploadtime, r.log == "old") for r in crawl.keep_new(fetched, held).collect()} == {("g-5", 50, False), ("g-4", 40, True), ("g-9", 91, False)}
