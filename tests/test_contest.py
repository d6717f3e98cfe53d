"""Contest aggregates on a small literal fixture, and invariants."""

import pytest

from duelframe.functions import contest as X
from duelframe.operators import contest as C
from duelframe.operators import eda, quality


H, A = "gen9vgc2025regh", "gen9championsvgc2026rega"
JAN, FEB = 1735732800, 1738411200


@pytest.fixture(scope="module")
def t(spark):
    """Seven contests, three of them in scope: m4 is of another format, m5 has no turns, m6 two winners, m7 one side."""
    contests = [("m1", H, 9, JAN), ("m2", H + "bo3", 12, FEB), ("m3", A, 7, FEB), ("m4", "gen8ou", 20, FEB), ("m5", H, None, JAN), ("m6", H, 6, JAN), ("m7", H, 6, JAN), ("m1", H, 9, JAN)]
    battle = spark.createDataFrame(contests, "battle_id string, format_id string, turn_count int, upload_time long")
    rows = [
        ("m1", "p1", "LOSS", 1432.0, "kim"), ("m1", "p2", "WIN", 1519.0, "lee"), ("m2", "p1", "WIN", None, "mo"), ("m2", "p2", "LOSS", 1010.0, "nat"), ("m3", "p1", "WIN", 1444.0, "oli"), ("m3", "p2", "LOSS", 1201.0, "pat"),
        ("m4", "p1", "WIN", 1700.0, "kim"), ("m4", "p2", "LOSS", 1650.0, "nat"), ("m5", "p1", "LOSS", 1222.0, "mo"), ("m5", "p2", "WIN", 1333.0, "pat"), ("m6", "p1", "WIN", 1111.0, "mo"), ("m6", "p2", "WIN", 1112.0, "oli"), ("m7", "p1", "WIN", 1450.0, "lee"),
    ]
    players = spark.createDataFrame(rows, "battle_id string, side string, result string, rating_before double, username string")
    slots = [
        ("m1", "p1", "Fern", "Fern", "listed", 1, 1), ("m1", "p1", "Moth-*", "Moth-Dusk", "observed", 1, 0), ("m1", "p2", "Fern", "Fern", "listed", 1, 0), ("m1", "p2", "Moth-*", "", "unobserved", 0, 0),
        ("m2", "p1", "Moth-*", "", "ambiguous", 1, None), ("m2", "p1", "Quill-Odd", "Quill-Odd", "listed", None, 0), ("m2", "p1", "Ghosted", "Ghosted", "listed", 1, 1), ("m2", "p2", "Fern", "Fern", "listed", 1, 1),
        ("m3", "p1", "Fern", "Fern", "listed", 1, 1), ("m3", "p2", "Moth-Dusk", "Moth-Dusk", "listed", 0, 0), ("m4", "p1", "Fern", "Fern", "listed", 1, 1), ("m7", "p1", "Fern", "Fern", "listed", 1, 1),
    ]
    slots = spark.createDataFrame(slots, "battle_id string, player_side string, pokemon_name string, species_observed string, form_status string, was_sent_out int, is_lead int")
    names = [("Fern", 31, "fern", 31, "exact", "known"), ("Moth-*", None, None, 44, "masked", "masked"), ("Moth-Dusk", 9044, "moth-dusk", 44, "exact", "known"), ("Quill-Odd", None, None, 57, "unlisted", "unlisted")]
    names = spark.createDataFrame(names, "showdown_name string, poke_id long, pokemon string, species_id long, method string, form_status string")
    return {"scope": C.scope(battle, players), "slots": slots, "names": names, "players": players}


def test_usage(t):
    rows = C.usage(t["slots"], t["scope"], t["names"]).collect()
    every = {(r.species_id, r.poke_id, r.form_basis): r for r in rows if r.rating_band == "all" and r.regulation == H}
    assert {k: (r.appearances, r.wins, r.sent_out, r.leads) for k, r in every.items()} == {
        (31, 31, "listed"): (3, 1, 3, 2), (44, 9044, "observed"): (1, 0, 1, 0), (44, None, "unobserved"): (2, 2, 1, 0), (57, None, "species_only"): (1, 1, 0, 0),
    }
    fern = every[(31, 31, "listed")]
    assert (fern.usage_share, fern.win_rate, fern.band_win_rate) == pytest.approx((3 / 4, 1 / 3, 4 / 7)) and fern.win_rate_delta == pytest.approx(1 / 3 - 4 / 7)
    assert C.unmapped_slots(t["slots"], t["scope"], t["names"]).first()[0] == 1
    for k in {(r.regulation, r.species_id, r.poke_id, r.form_basis) for r in rows}:
        same = [r for r in rows if (r.regulation, r.species_id, r.poke_id, r.form_basis) == k]
        assert sum(r.appearances for r in same if r.rating_band != "all") == sum(r.appearances for r in same if r.rating_band == "all")


def test_totals_bands_and_wilson(spark, t):
    bands = {(r.regulation, r.rating_band): (r.battles, r.player_battles) for r in C.band_totals(t["scope"]).collect()}
    assert bands == {
        (H, "all"): (2, 4), (H, "1400_1499"): (None, 1), (H, "1500_plus"): (None, 1), (H, "unknown"): (None, 1), (H, "below_1200"): (None, 1),
        (A, "all"): (1, 2), (A, "1400_1499"): (None, 1), (A, "1200_1399"): (None, 1),
    }
    edges = spark.createDataFrame([(x,) for x in (-5.0, 1199.0, 1200.5, 1399.0, 1401.0, 1499.5, 1777.0, float("nan"), None)], "r double")
    assert [r[0] for r in edges.select(X.rating_band(edges.r)).collect()] == ["below_1200", "below_1200", "1200_1399", "1200_1399", "1400_1499", "1400_1499", "1500_plus", "unknown", "unknown"]
    w = spark.createDataFrame([(7, 20), (0, 0)], "w long, n long")
    (lo, hi), none = [tuple(r) for r in w.select(*X.wilson(w.w, w.n)).collect()]
    assert (lo, hi) == pytest.approx((0.1812, 0.5671), abs=1e-4) and none == (None, None)


def test_pairs_matchups_months(t):
    pairs = C.partners(t["slots"], t["scope"], t["names"], 1).where("rating_band = 'all'").collect()
    assert {(r.regulation, r.species_a_id, r.species_b_id): (r.teams_both, r.wins_both) for r in pairs} == {(H, 31, 44): (2, 1), (H, 44, 57): (1, 1)}
    m = C.matchups(t["slots"], t["scope"], t["names"], 1)
    assert C.asymmetric_matchups(m).count() == 0
    every = m.where("rating_band = 'all'").collect()
    assert sum(r.battles for r in every) == 2 * sum(r.wins for r in every) and {(r.species_a_id, r.species_b_id) for r in every if r.regulation == A} == {(31, 44), (44, 31)}
    assert {(r.regulation, r.month): r.battles for r in C.monthly_totals(t["scope"]).collect()} == {(H, "2025-01"): 1, (H, "2025-02"): 1, (A, "2025-02"): 1}
    assert {r.label for r in C.dim_regulation(t["scope"]).collect()} == {"Reg H 2025", "Champions Reg A 2026"}


def test_spearman_and_normalize(spark):
    rows = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(12)] + [("b", float(i), 1.0) for i in range(4)], "k string, x double, y double")
    got = {r.k: r.rho for r in eda.spearman(rows, ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None
    names = spark.createDataFrame([("Rook’s  Nest",), (" Iron_ _Will ",), ("Señor 10%",), ("A.B: c--",), ("***",), (None,)], "n string")
    assert [r[0] for r in names.select(X.slug(names.n)).collect()] == ["rooks-nest", "iron-will", "senor-10", "ab-c", "***", None]


def test_mapping_strict(spark):
    master = spark.createDataFrame([(1, "cat-red", 7), (2, "cat-blue", 7), (3, "dog", 8)], "poke_id long, pokemon string, species_id long")
    counts = spark.createDataFrame([("Dog", 3), ("Cat-*", 2), ("Cat-Green", 1), ("Emu", 1), ("Doggo", 1)], "showdown_name string, n_rows long")
    over = spark.createDataFrame([("Doggo", "dog")], "showdown_name string, pokemon string")
    mapping, none = quality.build_mapping(counts, master, over)
    assert {r.showdown_name: (r.poke_id, r.species_id, r.method) for r in mapping.collect()} == {"Dog": (3, 8, "exact"), "Cat-*": (None, 7, "masked"), "Cat-Green": (None, 7, "unlisted"), "Doggo": (3, 8, "override")}
    assert [r.showdown_name for r in none.collect()] == ["Emu"]
    with pytest.raises(ValueError):
        quality.build_mapping(counts, master, spark.createDataFrame([("x", "nothing")], "showdown_name string, pokemon string"))


def test_report_and_tables(spark, t):
    usage = C.usage(t["slots"], t["scope"], t["names"]).persist()
    dim = C.dim_regulation(t["scope"])
    text = eda.report(usage, monthly=C.monthly_usage(t["slots"], t["scope"], t["names"]), pairs=C.partners(t["slots"], t["scope"], t["names"], 1), table=C.matchups(t["slots"], t["scope"], t["names"], 1), dim=dim, min_sides=3, min_teams=1, min_battles=1)
    assert "Left out with fewer than 3 sides: Champions Reg A 2026 (2)." in text and "## 1. Concentration of use" in text and "Pairs beyond chance, Reg H 2025" in text
    assert A not in text.split("## 1.")[1] and "Special events" not in text
    assert "No regulation is large enough." in eda.report(usage, min_sides=1000)
    assert eda.md_table(spark.createDataFrame([(1234, 0.5, None, float("nan"))], "a long, b double, c string, d double")).endswith("| 1,234 | 0.5 |  |  |")
    many = spark.range(7).select("id")
    assert eda.md_table(many, 3).endswith("4 further rows are left out.") and eda.md_table(many.limit(0)) == "_(no data)_"
