"""Joins of the master tables and the saved teams.

The master tables are small; all joins are plain equi-joins and Catalyst broadcasts what it knows to be small.
A saved team is one nested row; `flat_teams` and `nested_teams` turn it into five flat tables and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = ("hp", "atk", "def", "spatk", "spdef", "spe")
LEVEL = 50
_SPREAD = "struct<" + ",".join(f"{s}:int" for s in STATS) + ">"
MEMBER = f"struct<pokemon:string,ability:string,item:string,nature:string,level:int,moves:array<string>,ivs:{_SPREAD},evs:{_SPREAD}>"
TEAM = f"team_name string, members array<{MEMBER}>"


def with_types(stats: DataFrame, owned: DataFrame, types: DataFrame) -> DataFrame:
    """Every creature with its types of slot 1 and 2, null where it has none, and its stats."""
    named = owned.join(types, "type_id", "left").groupBy(F.col("pokemon_id").alias("poke_id")).agg(
        F.max(F.when(F.col("slot") == 1, F.col("type"))).alias("type_1"), F.max(F.when(F.col("slot") == 2, F.col("type"))).alias("type_2")
    )
    return stats.dropDuplicates(["poke_id", "pokemon", *STATS]).join(named, "poke_id", "left").select("poke_id", "pokemon", "type_1", "type_2", *STATS)


def learnset(stats: DataFrame, learned: DataFrame, moves: DataFrame, methods: DataFrame) -> DataFrame:
    """(pokemon, move_name, learn_method, level_learned)."""
    rows = learned.withColumnRenamed("learn_method", "learn_method_id").join(stats.select(F.col("poke_id").alias("pokemon_id"), "pokemon"), "pokemon_id")
    return rows.join(moves.select("move_id", "move_name"), "move_id").join(methods, "learn_method_id").select("pokemon", "move_name", "learn_method", "level_learned")


def abilities(stats: DataFrame, owned: DataFrame, names: DataFrame) -> DataFrame:
    """(pokemon, ability_name, hidden_abi)."""
    rows = owned.join(stats.select(F.col("poke_id").alias("pokemon_id"), "pokemon"), "pokemon_id")
    return rows.join(names.select(F.col("ability_id").alias("abi_id"), "ability_name"), "abi_id").select("pokemon", "ability_name", "hidden_abi")


def move_data(moves: DataFrame, types: DataFrame, classes: DataFrame) -> DataFrame:
    """(move_name, power, type, damage_class)."""
    return moves.join(types, "type_id").join(classes, "damage_class_id").select("move_name", "power", "type", "damage_class")


def type_chart(chart: DataFrame, types: DataFrame) -> DataFrame:
    """(attack_type, defense_type, multiplier): one dimension in two roles."""
    role = lambda name: types.select(F.col("type_id").alias(f"{name}_type_id"), F.col("type").alias(f"{name}_type"))
    return chart.join(role("attack"), "attack_type_id").join(role("defense"), "defense_type_id").select("attack_type", "defense_type", "multiplier")


def first_of_key(rows: DataFrame, order: list[Column], **keys: object) -> DataFrame:
    """The first row with the given keys in an order, no row where there is none."""
    found = rows
    for name, value in keys.items():
        found = found.where(F.col(name) == F.lit(value))
    return found.orderBy(*order).limit(1)


def read_query(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, **split: object) -> DataFrame:
    """The rows of a query that a database answers (S12); the driver's jar comes with the cluster.

    split: partitionColumn, lowerBound, upperBound and numPartitions for a parallel read.
    """
    reader = spark.read.format("jdbc").options(url=url, **(properties or {}))
    if split:
        return reader.option("dbtable", f"({query}) q").options(**split).load()
    return reader.option("query", query).load()


def flat_teams(teams: DataFrame) -> dict[str, DataFrame]:
    """The five tables of saved teams (V1): ids are digests of the name and the slot, so every table is written on its own.

    A member without a level has level 50; moves and members are numbered from 1 in their order.
    """
    team_id = F.xxhash64("team_name")
    masters = teams.select(team_id.alias("team_id"), "team_name").distinct()
    members = teams.select("team_name", team_id.alias("team_id"), F.posexplode("members").alias("i", "m")).withColumn("slot", F.col("i") + 1)
    members = members.withColumn("team_pokemon_id", F.xxhash64("team_name", "slot"))
    spread = lambda kind: members.select("team_pokemon_id", *[F.col(f"m.{kind}.{s}").alias(s) for s in STATS])
    moves = members.select("team_pokemon_id", F.posexplode("m.moves").alias("i", "move_name"))
    return {
        "team_master": masters,
        "team_pokemon": members.select(
            "team_pokemon_id", "team_id", F.col("m.pokemon").alias("pokemon_name"), "slot", "m.ability", "m.item", "m.nature", F.coalesce("m.level", F.lit(LEVEL)).alias("level")
        ),
        "team_pokemon_moves": moves.select("team_pokemon_id", "move_name", (F.col("i") + 1).alias("move_slot")),
        "team_pokemon_evs": spread("evs"), "team_pokemon_ivs": spread("ivs"),
    }


def team_members(tables: dict[str, DataFrame], team_name: str | None = None) -> DataFrame:
    """One row per member with its spreads and, in one join instead of a query per member, its moves in order.

    team_name: only the members of that team, else of all.
    """
    master = tables["team_master"] if team_name is None else tables["team_master"].where(F.col("team_name") == team_name)
    rows = tables["team_pokemon"].join(master, "team_id")
    for kind in ("ev", "iv"):
        spread = tables[f"team_pokemon_{kind}s"].select("team_pokemon_id", *[F.col(s).alias(f"{s}_{kind}") for s in STATS])
        rows = rows.join(spread, "team_pokemon_id", "left")
    moves = tables["team_pokemon_moves"].groupBy("team_pokemon_id").agg(F.array_sort(F.collect_list(F.struct("move_slot", "move_name"))).alias("m"))
    moves = moves.select("team_pokemon_id", F.transform("m", lambda x: x["move_name"]).alias("moves"))
    rows = rows.join(moves, "team_pokemon_id", "left").withColumn("moves", F.coalesce("moves", F.array().cast("array<string>")))
    return rows.select("team_name", "slot", "pokemon_name", "ability", "item", "nature", "level", *[f"{s}_{k}" for k in ("ev", "iv") for s in STATS], "moves")


def nested_teams(members: DataFrame) -> DataFrame:
    """One row per team with its members in order (V2)."""
    spread = lambda kind: F.struct(*[F.col(f"{s}_{kind}").alias(s) for s in STATS])
    one = F.struct(
        "slot", F.struct(F.col("pokemon_name").alias("pokemon"), "ability", "item", "nature", "level", "moves", spread("iv").alias("ivs"), spread("ev").alias("evs")).alias("m")
    )
    return members.groupBy("team_name").agg(F.array_sort(F.collect_list(one)).alias("l")).select("team_name", F.transform("l", lambda x: x["m"]).alias("members"))


def member_text(members: DataFrame) -> DataFrame:
    """(team_name, slot, text): the export block of each member (V3); nulls are written as None."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    labels = ("HP ", "Atk", "Def", "SpA", "SpD", "Spe")
    lines = [
        F.lit(""), F.concat(F.initcap(said("pokemon_name")), F.lit(" @ "), said("item")), F.concat(F.lit("Ability: "), said("ability")), F.concat(F.lit("Level: "), said("level")),
        F.concat(F.initcap(said("nature")), F.lit(" Nature")), F.lit(""), F.lit("EVs:"), *[F.concat(F.lit(f"{n} "), said(f"{s}_ev")) for n, s in zip(labels, STATS, strict=True)], F.lit(""), F.lit("Moves:"), F.lit(""),
    ]
    moves = F.array_join(F.transform("moves", lambda m: F.concat(F.lit("\n- "), m)), "")
    return members.select("team_name", "slot", F.concat(F.array_join(F.array(*lines), "\n"), moves).alias("text"))
