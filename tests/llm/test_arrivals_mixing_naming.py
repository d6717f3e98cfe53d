"""Arrival dedup, mixing and naming on small fixtures and against brute force."""

import datetime as dt
import shutil

import numpy as np
import pytest

from pyspark.sql import functions as F

from duelframe.llm import arrivals, mixing, naming

T = dt.datetime(2024, 1, 1)
BATTLE = "battle_id string, replay_path string, loaded_at timestamp_ntz, row_id int"
ARRIVAL = "row_id long, battle_id string, replay_path string, owner string, batch_no int"


def test_arrivals(spark):
    battles = spark.createDataFrame([("g-100", "data/v/X Y_part0.parquet#row1", T, 1), ("abcdef", "replays/2024/01/g-200.log", T, 1), ("g-100", "data/v/X Y_part0.parquet#row1", T, 1), (None, None, T, 1)], BATTLE)
    rows = [
        (1, "G-100 ", None, ""), (2, None, "/mnt/s/data//v/./X%20Y_part0.parquet#row1", ""), (3, "g-1000", "data/v/X Y_part0.parquet#row10", ""), (4, "battle-g_200", None, ""), (5, "g-300", "recrawl/a.parquet#row1", ""),
        (6, "", "RECRAWL\\A.parquet#ROW1", ""), (7, "g-300-abc123defpw", "recrawl/b.parquet#row9", ""), (8, None, "recrawl/b.parquet#row9", ""), (9, None, None, ""), (10, None, "", ""), (11, "zz", "replays/tmp/../2024/01/g-200 (1).log.gz", ""), (None, "g-100", None, ""), (8, None, "recrawl/b.parquet#row9", ""),
    ]
    rows = spark.createDataFrame([(*r, None if r[0] == 1 else (r[0] or 0) // 3) for r in rows], ARRIVAL)
    for at_once in (1, 4, 1000):  # how batches are grouped changes nothing
        got = {r.row_id: r.first_battle_id for r in arrivals.found(battles, rows, rows_at_once=at_once).collect()}
        assert got == {1: "g-100", 2: "g-100", 4: "abcdef", 6: "g-300", 7: "g-300", 8: "g-300", 11: "abcdef"}
    assert arrivals.found(battles.limit(0), spark.createDataFrame([], ARRIVAL)).count() == 0


def test_index_is_opened_again_and_history_is_read_once(spark, tmp_path):
    held, folder = str(tmp_path / "battle"), str(tmp_path / "index")
    spark.createDataFrame([("doublesplayground-2000000017", "data/a#row1", T, 1), ("g-1", "data/b#row1", T, 1)], BATTLE).write.parquet(held)
    arrivals.ReplayIndex(spark, folder).load_history(spark.read.parquet(held))
    shutil.rmtree(held)  # from here on history cannot be read
    one = spark.createDataFrame([(1, "g-1", None, "", 1), (2, "g-2", "data/a#row2", "", 1), (3, "", "data/a#row2", "", 1)], ARRIVAL)
    for _ in range(2):  # a batch that is accepted again replaces itself
        assert {(r.row_id, r.name) for r in arrivals.ReplayIndex(spark, folder).accept(one, "1").collect()} == {(1, "g-1"), (3, "g-2")}
    two = spark.createDataFrame([(4, None, "data/a#row2", "", 2), (5, "doublesplaygruond-2000000017", None, "", 2), (6, "doublesplayground-2000000071", None, "", 2), (7, "h-1", "data/b#row1", "", 2)], ARRIVAL)
    index = arrivals.ReplayIndex(spark, folder)
    # row 5 is met by its near fingerprint only: no text of the index equals its text
    assert {(r.row_id, r.name) for r in index.accept(two, "2").collect()} == {(4, "g-2"), (5, "doublesplayground-2000000017"), (7, "g-1")}
    assert index.tables.where("text = 'g-2'").count() == arrivals.BLOCKS


def test_the_index_is_read_no_more_often_for_more_of_both(spark, monkeypatch):
    battles = spark.createDataFrame([(f"g-{i}", f"data/a#row{i}", T, 1) for i in range(40)], BATTLE)
    rows = spark.createDataFrame([(i, f"G-{i % 30}", None, "", i) for i in range(60)], ARRIVAL)
    calls, accept = [], arrivals.ReplayIndex.accept
    monkeypatch.setattr(arrivals.ReplayIndex, "accept", lambda *a: calls.append(a[2]) or accept(*a))
    got = {r.row_id: r.first_battle_id for r in arrivals.found(battles, rows, rows_at_once=20).collect()}
    assert got == {i: f"g-{i % 30}" for i in range(60)} and calls == ["0-59"]


def test_entries_of_a_block_with_another_shape_are_not_compared(spark):
    entry = lambda n, text: ("id", text, -1, n, 5)
    index = spark.createDataFrame([entry("a", "playground-1"), entry("b", "playground-2"), entry("c", "plaiground-1")], "kind string, text string, owner long, name string, fp long")
    asked = spark.createDataFrame([(1, "id", "playground-1", 5), (2, "id", "playgrount-2", 4)], "ord long, kind string, text string, fp long")
    met = arrivals.matches(asked, arrivals.block_tables(index.withColumn("shape", arrivals.shape("text"))))
    # one row each, though all three blocks of the first are equal
    assert sorted((r.ord, r.name, r.equal) for r in met.collect()) == [(1, "a", True), (1, "c", False), (2, "b", False)]
    assert "shape" in met._jdf.queryExecution().executedPlan().toString().split("Join [")[1].split("]")[0]


def test_steps_back(spark):
    paths = [("a/b/../../data/x",), ("data/1/2/3/4/../../../../y",), ("../data/z",), ("data/..x/../w",)]
    got = [r[0] for r in spark.createDataFrame(paths, "p string").select(arrivals.replay_place(F.col("p"))).collect()]
    assert got == ["data/x", "data/y", "data/z", "data/w"]


def test_fingerprints():
    texts = ["gen9vgc2024regx-%d" % (2000000000 + 37 * i) for i in range(500)] + ["", None]
    prints = arrivals.fingerprints(texts)
    assert (prints == arrivals.fingerprints(texts[::-1])[::-1]).all()
    assert (prints == np.concatenate([arrivals.fingerprints([t]) for t in texts])).all()
    assert len(set(prints[:500].tolist())) == 500


def test_mixing(spark):
    sizes = [(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.55, 2), ("none", 0.05, 3), ("b", 0.55, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.source_plan(df, targets)
    p = {r.source: r for r in plan.collect()}
    assert p["b"].short == (sum(t for _, s, t in sizes if s == "b") * 2 < 0.55 * sum(t for *_, t in sizes)) and p["none"].short
    mix = mixing.chosen(df, plan, blocks=16).collect()
    assert len({r.doc_id for r in mix}) == len(mix)
    for s in "ab":
        docs = sum(x[1] == s for x in sizes)
        own = [r.repeats for r in mix if r.source == s]
        assert abs(sum(own) - p[s].copies * docs) < 1.001 and max(own) <= 2
    out = {r.source: r for r in mixing.reached(mixing.chosen(df, plan), plan).collect()}
    assert sum(r.actual_share for r in out.values()) == pytest.approx(1.0) and out["none"].mix_docs == 0
    empty = mixing.source_plan(df.limit(0), targets)
    assert mixing.chosen(df.limit(0), empty).count() == 0 and not any(r.actual_share for r in mixing.reached(mixing.chosen(df.limit(0), empty), empty).collect())


def test_short_sources_come_from_the_mix(spark):
    rows = [(i, "a" if i % 10 else "b", "one two three", "x") for i in range(400)] + [(1000, "c", None, "x"), (1001, "d", "word " * 50, "x"), (1, "a", "one two three", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target_share string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.05, 3), ("none", 0.05, 3), ("d", 0.1, 0), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    assert {r.source for r in mixing.short_sources(docs, targets).collect()} == {"b", "c", "none", "d"}
    mix, plan = mixing.mixed(docs, targets)
    out = {r.source: r for r in mixing.reached(mix, plan).collect()}
    assert out["b"].used_up and not out["a"].used_up and out["b"].mix_docs == 40 and out["b"].most_repeats == 2
    # rows of the result come through the draw: without one document of b in the mix, b is not used up
    assert not {r.source: r for r in mixing.reached(mix.where("doc_id <> 10"), plan).collect()}["b"].used_up
    assert mixing.short_sources(docs.limit(0), targets.limit(0)).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "s", "hello world, hello"), (1, "s", "hello world, hello"), (2, "s", None), (3, "s", ""), (4, None, "x"), (None, "s", "x"), (5, "s", "a" * 300_000)], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in mixing.sized(docs).collect()}
    assert got[1] == 4 and got[2] == 0 and got[3] == 0 and set(got) == {1, 2, 3, 5}
    # a long unbroken text is merged as a whole: pairs across any cut count as well
    import tiktoken

    ranks = mixing._encoder(mixing.VOCABULARY)._mergeable_ranks
    whole = tiktoken.Encoding("plain", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got[5] == len(whole.encode_ordinary("a" * 300_000))


def test_naming(spark):
    slots = ["Kreivos", "KREIVOSS", " kreivos-thorn ", "Thorn Kreivos", "Moss (Kreivos)", "Kreivos (Thorn)", "Kreivos-*", "Moss (Kreivos-*)", "Kreivos, L50", "Kreivos @ item", "Krеivos", "Kr​eivos", "egg", "", "???", "Fakemonix", "Fakemonik", "Bolmarun", "Bolmarum-S", "Nothingness", None, "Kreivos"]
    df = spark.createDataFrame([(s, "x") for s in slots], "pokemon_name string, entered string")
    stats = spark.createDataFrame([("kreivos",), ("kreivos-thorn",), ("bolmarun-tidal",), ("fakemonisto",)], "pokemon string")
    over = spark.createDataFrame([("Bolmarun", "Tidal bolmarun"), ("Bolmarun-S", "bolmarun-tidla"), ("Nothingness", "nowhere"), (None, None), ("Bolmarun", "Tidal bolmarun")], "showdown_name string, pokemon string")
    fakes = spark.createDataFrame([("Fakemonix", "CAP")], "showdown_name string, reason string")
    got = {(r.field, r.entered): r.pokemon for r in naming.found(df, stats, over, fakes).collect()}
    p = lambda s: got[("pokemon_name", s)]
    assert {p(s) for s in ("Kreivos", "KREIVOSS", "Moss (Kreivos)", "Kreivos, L50", "Kreivos @ item", "Krеivos", "Kr​eivos")} == {"kreivos"}
    assert {p(s) for s in (" kreivos-thorn ", "Thorn Kreivos", "Kreivos (Thorn)")} == {"kreivos-thorn"}
    assert {p(s) for s in ("Kreivos-*", "Moss (Kreivos-*)", "egg", "", "???", "Fakemonix", "Fakemonik", "Nothingness")} == {""}
    assert p("Bolmarun") == p("Bolmarum-S") == got[("pokemon", "bolmarun-tidla")] == got[("showdown_name", "Bolmarun-S")] == "bolmarun-tidal"
    assert len(got) == len(naming.entered_values(df, over).collect()) == 20 + 3 + 3
    assert naming.found(df.limit(0), stats.limit(0), over.limit(0), fakes.limit(0)).count() == 0
