"""Log ingestion on a small own log."""

import pytest

from duelframe.sources import logs

LOG = "\n".join([
    "|player|p1|Ann|12|1300", "|player|p2|Bo|265|", "|player|p2|Bo|265|1250", "|gametype|doubles", "|tier|[Gen 9] VGC 2024 Reg X (Bo3)", "|t:|1704110400",
    "|poke|p1|Alpha-*, L50|", "|poke|p1|Beta, L50, M|", "|poke|p2|Gamma, L50|", "|poke|p2|Delta|", "|teampreview|4", "|start",
    "|switch|p1a: Al|Alpha-Red, L50|100/100", "|switch|p1b: Beta|Beta, L50, M|100/100", "|switch|p2a: Gamma|Gamma, L50|100/100", "|switch|p2b: Delta|Delta|100/100",
    "|turn|1", "|move|p1a: Al|Slap|p2a: Gamma", "|-damage|p2a: Gamma|40/100", "|move|p2a: Gamma|Punch|p1b: Beta|[miss]", "|-weather|Rain|[of] p2b: Delta", "|-weather|Rain|[upkeep]",
    "|-terastallize|p1a: Al|Fire", "|-status|p2b: Delta|psn", "|-ability|p1b: Beta|Calm",
    "|turn|2", "|detailschange|p1a: Al|Alpha-Blue, L50", "|move|p1a: Al|Slap|p2a: Gamma", "|-damage|p2a: Gamma|0 fnt", "|faint|p2a: Gamma", "|move|p2b: Delta|Kick|p1a: Al", "|-fail|p2b: Delta",
    "|switch|p1b: Al2|Epsilon|50/100", "|turn|3", "|win|Ann", "|move|p1a: Al|Late|p2b: Delta",
])


@pytest.fixture(scope="module")
def facts(spark):
    rows = spark.createDataFrame([("b1", LOG), ("b2", "  \n "), ("b3", None), ("b1", LOG)], "battle_id string, log string")
    good, errors = logs.valid_logs(rows)
    assert [tuple(r) for r in errors.collect()] == [(None, "b2", "Empty or non-string log")]
    return {k: [r.asDict() for r in v.collect()] for k, v in logs.fact_tables(good).items()}


def test_header(facts):
    (b,) = facts["battle"]
    assert (b["format_id"], b["upload_time"], b["winner_name"], b["turn_count"]) == ("gen9vgc2024regx(bo3)", 1704110400, "Ann", 3)
    assert {(p["side"], p["username"], p["rating_before"], p["result"]) for p in facts["battle_players"]} == {("p1", "Ann", 1300, "WIN"), ("p2", "Bo", 1250, "LOSS")}


def test_roster_and_leads(facts):
    slots = {(s["player_side"], s["slot_no"]): (s["pokemon_name"], s["species_observed"], s["form_status"], s["was_sent_out"], s["is_lead"]) for s in facts["battle_team_slot"]}
    assert slots[("p1", 1)] == ("Alpha-*", "Alpha-Red", "observed", 1, 1)
    assert slots[("p1", 2)] == ("Beta", "Beta", "listed", 1, 1)
    assert len(facts["battle_leads"]) == 4 and [s["species"] for s in facts["battle_switch"]] == ["Epsilon"]


def test_events(facts):
    moves = [(m["move_name"], m["success"], m["species"]) for m in sorted(facts["battle_move"], key=lambda m: (m["turn_no"], m["move_name"]))]
    assert moves == [("Punch", 0, "Gamma"), ("Slap", 1, "Alpha-Red"), ("Kick", 0, "Delta"), ("Slap", 1, "Alpha-Blue")]
    hits = sorted((d["hp_before"], d["hp_after"], d["damage_pct"], d["attacker_species"], d["move_name"]) for d in facts["battle_damage"])
    assert hits == [(40.0, 0.0, 40.0, "Alpha-Blue", "Slap"), (100.0, 40.0, 60.0, "Alpha-Red", "Slap")]
    (ko,) = facts["battle_ko"]
    assert (ko["killer_species"], ko["victim_species"], ko["ko_type"]) == ("Alpha-Blue", "Gamma", "MOVE")
    assert [(w["weather_name"], w["source_pokemon"]) for w in facts["battle_weather"]] == [("Rain", "Delta")]
    assert facts["battle_tera"][0]["tera_type"] == "Fire" and facts["battle_status"][0]["status_code"] == "psn" and facts["battle_ability"][0]["ability_name"] == "Calm"
    states = {f["turn_no"]: (f["p1_left"], f["p1_right"], f["p2_left"], f["p2_right"]) for f in facts["battle_field_state"]}
    assert states[1] == ("Al", "Beta", "Gamma", "Delta") and states[3][1] == "Al2"


def test_ko_type(spark):
    rows = spark.createDataFrame([("Toxic Spikes",), ("Snowscape",), ("Slap",), ("",), (None,)], "m string")
    assert [r[0] for r in rows.select(logs.ko_type(rows.m)).collect()] == ["POISON", "WEATHER", "MOVE", "MOVE", "MOVE"]


def read(spark, *lines, columns="battle_id string, log string", more=()):
    return logs.fact_tables(logs.valid_logs(spark.createDataFrame([("b", "\n".join(lines), *more)], columns))[0])


def test_lines_that_are_odd(spark):
    facts = read(
        spark, "|player|p1| Ann |1|--", "|player|p1|Zed|1|1500", "|player|p2", "|player|p2| |1|9", "|player|p2|Bo|1|", "|tier|A|B", "|t:|x", "|t:|77", "|rated|Tournament", "|poke|p1", "|poke|p1|Aa|", "|start",
        "|switch|p1a: Aa|Aa, L50|50/100", "|drag|p1a: Early|Early|77/100", "|drag|p2a: Cc|Cc, M|100/100", "|switch|p2b", "|turn|1", "|turn|x", "|-status|p1a: Early|", "|-status|p1a: Early", "|-ability|p2a: Cc", "|-weather|NONE", "|-weather|none",
        "|move|p2a: Cc|Hit|p1a: Early|[notarget] ", "|switch|p2a: Dd|Dd|90/100", "|-damage|p1a: Early|10/100|[of] p2a: Cc|[from] item: Orb", "|-damage|p1a: Early|0 fnt", "|-heal|p1a: Early|20/100", "|faint|p1a: Early", "|faint|p1a: Early",
        "|win| Ann ", "|tie",
    )
    rows = lambda n: [tuple(r) for r in facts[n].collect()]
    assert rows("battle") == [("b", "A|B", "a|b", 77, None, "Ann", None, 1)]
    assert set(rows("battle_players")) == {("b", "Ann", "p1", 1500, None, "WIN"), ("b", "Bo", "p2", None, None, "LOSS")}
    assert rows("battle_team_slot") == [("b", "p1", 1, "Aa", 1, "Aa", "listed", 1)]
    # a drag before the first turn is an opening, a second entry of a place is not
    assert {r[2:] for r in rows("battle_leads")} == {("Aa", "Aa", 1), ("Cc", "Cc", 1)}
    assert {(r[1], r[3]) for r in rows("battle_switch")} == {(0, "Early"), (1, "Dd")}
    assert rows("battle_status") == [("b", 1, "Ann", "Early", "Early", "")] and rows("battle_ability") == [] and [r[2] for r in rows("battle_weather")] == ["NONE"]
    assert [r[-1] for r in rows("battle_move")] == [0] and len(rows("battle_field_state")) == 2
    # the named attacker has left: its species is known by its nickname, its move by nothing that stands, so by [from]
    first, second = sorted(rows("battle_damage"), key=lambda r: -r[8])
    assert first[2:7] == ("Cc", "Early", "Cc", "Early", "item: Orb") and first[7:] == (77.0, 10.0, 67.0)
    assert second[2:7] == ("Dd", "Early", "Dd", "Early", "Hit")
    assert [r[2:] for r in rows("battle_ko")] == [("Dd", "Early", "Dd", "Early", "Hit", "MOVE")] and len(rows("battle_faint")) == 2


def test_errors_and_what_the_source_fills_in(spark):
    facts = read(spark, "|poke|p3|Aa|", "|start", "|turn|1")
    assert [tuple(r) for r in facts["errors"].collect()] == [(None, "b", "roster line of an unknown side")] and facts["battle"].count() == facts["battle_field_state"].count() == 0
    columns = "battle_id string, log string, replay_path string, uploadtime double, rating double, formatid string, format string"
    (b,) = read(spark, "|tier|Own", "|turn|2", columns=columns, more=("x/y", 12.5, 13.5, "meta", "Meta")).get("battle").collect()
    assert tuple(b) == ("b", "Own", "own", 12, 14, None, "x/y", 2)
    (b,) = read(spark, "|turn|2", columns=columns, more=("x/y", None, None, "meta", "Meta")).get("battle").collect()
    assert tuple(b) == ("b", "Meta", "meta", None, None, None, "x/y", 2)
