"""Problem 5: items that appear together, by basket collapsing.

Rows become one sorted, deduplicated array of item digests per basket; identical arrays are
collapsed into one weighted basket, pairs are enumerated once per distinct basket and
their weights summed. The counts of single items come from the same weighted baskets, so the rows are
shuffled once. Names come back only for the pairs that reach the support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.joins import BROADCAST_ROWS, look_up
from duelframe.functions.text import key, trimmed
from duelframe.session import Scratch

#: The pairs of a basket of more items are enumerated by many tasks instead of one.
WIDE = 256


def item_rows(rows: DataFrame, basket: list[Column], item: Column) -> DataFrame:
    """(b0.., item): rows where no basket key and no item is null."""
    picked = rows.select(*[b.alias(f"b{i}") for i, b in enumerate(basket)], item.alias("item"))
    for i in range(len(basket)):
        picked = picked.where(F.col(f"b{i}").isNotNull())
    return picked.where("item IS NOT NULL")


def collapsed(rows: DataFrame) -> DataFrame:
    """(items, weight): distinct baskets as sorted arrays of item digests, with how many baskets are like that.

    Repeated rows count once. Sets are built map-side first, so a hot basket or item is no hot task.
    """
    keys = [c for c in rows.columns if c != "item"]
    baskets = rows.select(*keys, F.xxhash64("item").alias("h")).groupBy(*keys).agg(F.array_sort(F.collect_set("h")).alias("items"))
    return baskets.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def pair_counts(rows: DataFrame, min_support: int = 1, wide: int = WIDE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(name_a, name_b, n_ab, n_a, n_b, n): pairs in at least `min_support` baskets.

    rows: (basket keys, item), see `item_rows`. n counts all baskets. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    baskets = scratch.save(collapsed(rows))
    names = rows.select("item").distinct().withColumn("h", F.xxhash64("item"))
    singles = baskets.select("weight", F.explode("items").alias("h")).groupBy("h").agg(F.sum("weight").alias("n"))
    known = scratch.save(singles.join(names, "h"))
    if known.count() != known.select("h").distinct().count():
        raise ValueError("two item names share one digest")
    total = baskets.agg(F.sum("weight").alias("n"))
    rest = F.expr("slice(items, pos + 2, size(items))")
    each = baskets.where(F.size("items") <= wide).select("weight", F.posexplode("items").alias("pos", "a"), "items").select("weight", "a", rest.alias("rest"))
    # a wide basket is dealt out item by item before its pairs are made
    broad = baskets.where(F.size("items") > wide).select("weight", F.posexplode("items").alias("pos", "a"), "items").select("weight", "a", rest.alias("rest")).repartition("a", "weight", F.size("rest"))
    pairs = each.unionByName(broad).select("weight", "a", F.explode("rest").alias("b")).groupBy("a", "b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_support)
    for s in "ab":
        pairs = look_up(pairs, known.select(F.col("h").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}")), s, "inner", ["a", "b"], broadcast_rows)
    swap = F.col("item_a") > F.col("item_b")
    ordered = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        ordered("item_a", "item_b").alias("name_a"), ordered("item_b", "item_a").alias("name_b"), "n_ab", ordered("n_a", "n_b").alias("n_a"), ordered("n_b", "n_a").alias("n_b")
    ).join(F.broadcast(total), how="inner")  # one row


def scored(pairs: DataFrame) -> DataFrame:
    """Adds support, confidence of a for b, lift and conviction; conviction is null where b never fails."""
    n_ab, n_a, n_b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    return pairs.withColumns({
        "support": n_ab / n,
        "confidence": n_ab / n_a,
        "lift": n_ab * n / (n_a * n_b),
        "conviction": F.try_divide(1 - n_b / n, 1 - n_ab / n_a),
    })


def roster_items(slots: DataFrame) -> DataFrame:
    """Rosters of battle_team_slot: battle and side without regard to case and blanks, names in
    lower case without surrounding blanks; rows with a blank key or a null name give nothing."""
    return item_rows(slots, [key("battle_id"), key("player_side")], F.lower(trimmed("pokemon_name")))


def found(slots: DataFrame, min_support: int = 10, times_chance: int = 3) -> DataFrame:
    """Pairs in at least `min_support` rosters and `times_chance` times as often as chance.

    The comparison uses exact decimals, so it holds for any counts.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    pairs = pair_counts(roster_items(slots), min_support)
    return pairs.where(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(times_chance)).select("name_a", "name_b")
