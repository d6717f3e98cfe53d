"""Item similarity from rosters as sentences (M1-M3)."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(slots: DataFrame) -> DataFrame:
    """(battle_id, player_side, team): the names of each roster in slot order; rosters are whole, null names left out.

    A sentence longer than the model's limit is split there by the model.
    """
    rows = slots.where("pokemon_name IS NOT NULL AND battle_id IS NOT NULL").select("battle_id", "player_side", "slot_no", "pokemon_name").distinct()
    return rows.groupBy("battle_id", "player_side").agg(F.array_sort(F.collect_list(F.struct("slot_no", "pokemon_name"))).alias("t")).select("battle_id", "player_side", F.transform("t", lambda x: x["pokemon_name"]).alias("team"))


def train(teams: DataFrame, size: int = 128, window: int = 6, min_count: int = 100, iterations: int = 10, seed: int = 7, partitions: int = 4) -> Word2VecModel:
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=partitions, inputCol="team", outputCol="v").fit(teams)


def most_similar(model: Word2VecModel, word: str, n: int = 20) -> DataFrame:
    """(word, similarity) nearest to a word of the vocabulary; no rows for an unknown word."""
    vectors = model.getVectors()
    if not vectors.where(F.col("word") == word).limit(1).count():
        return vectors.select("word", F.lit(0.0).alias("similarity")).where(F.lit(False))
    return model.findSynonyms(word, n)
