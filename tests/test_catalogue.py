"""Registered contest queries against what their operators are to do in full."""

from types import SimpleNamespace

from duelframe.operators import similarity
from duelframe.plans import catalogue


def test_id_collisions_reads_past_a_shared_folder(spark):
    folder = "data/vgc_data/VGC 2024 Reg X_part0.parquet#row"
    paths = [f"{folder}{n}" for n in range(5)] + [f"{folder}0"]  # one real collision
    battle = spark.createDataFrame([(f"b{n}", p) for n, p in enumerate(paths)], "battle_id string, replay_path string")
    (row,) = catalogue._BUILD["id_collisions"](SimpleNamespace(battle=battle)).collect()
    assert row.asDict() == {"rows": 6, "ids": 6, "head_digests": 5}


def test_item_similarity_trains_the_whole_model(spark, monkeypatch):
    often, seldom = ["Nioholkrir", "A", "B"], "C"
    rows = [(f"b{b}", "p1", k, n) for b in range(100) for k, n in enumerate(often + [seldom] * (b < 99))]
    slots = spark.createDataFrame(rows, "battle_id string, player_side string, slot_no int, pokemon_name string")
    models, near = [], similarity.most_similar
    monkeypatch.setattr(similarity, "most_similar", lambda model, word, n: models.append(model) or near(model, word, n))
    found = {r.word for r in catalogue._BUILD["item_similarity"](SimpleNamespace(slots=slots)).collect()}
    (model,) = models
    assert found == {"A", "B"}  # a name of 99 rosters is below the least count
    assert (model.getVectorSize(), model.getWindowSize(), model.getMinCount(), model.getMaxIter()) == (128, 6, 100, 10)
    assert {len(r.vector) for r in model.getVectors().collect()} == {128}
