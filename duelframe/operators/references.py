"""Problem 1: references to records that do not exist.

Records and references become signed change deltas per key: a record adds one to
existence when it is loaded and takes it away when it is deleted, a reference adds one to the references
at the time its row was loaded. The running sums at a reference tell whether the
key exists then; keys with positive references and no existence are orphans. `ReferenceLedger` keeps the
sums of each key between batches, so a batch is judged from its own deltas and the sums of its keys, and
no row of an earlier batch is read again.

A row that refers to a battle and to a side of the battle is one delta of two nested keys,
so it is shuffled once, by the outer key; the running sums of both keys then need no other shuffle. A
count of rows per hash bucket of the keys tells whether some key is hot. Hot keys are summed in two levels, per (key, hour) and
over the hours of a key, and the references of one hour are dealt over salts, each with a copy of the
pre-summed existence deltas, so that neither a key nor a moment with a third of all rows is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.text import key

BUCKETS = 65_536
#: Rows of one key that one task may sort without harm. Keys of buckets with more are split.
HOT_ROWS = 2_000_000
#: With more hot buckets than this every key is split.
MOST_HOT = 4_096
#: References of a hot key and hour are dealt over so many tasks.
SALTS = 16
HOUR = 3_600_000_000
#: The hour of deltas without a time, before all others.
NO_HOUR = -(1 << 31)
#: Columns of a delta: key space, outer and inner key, time, signed existence and loads of the outer (a_) and
#: inner (b_) key, and for references the row's spelling (null where it equals the key) and slot.
DELTA = "space string, k1 string, k2 string, at long, a_exists int, a_loads int, b_exists int, b_loads int, refers int, spelled_1 string, spelled_2 string, slot int"


def _at(col: str) -> Column:
    """Microseconds of a timestamp with or without zone (UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def _delta(rows: DataFrame, **values: Column) -> DataFrame:
    columns = [part.split() for part in DELTA.split(", ")]
    return rows.select(*[(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in columns])


def existence_deltas(records: DataFrame, space: str, keys: list[Column], deleted: str | None = "deleted_at") -> DataFrame:
    """Signed existence deltas of the records of one table, for the outer key or, with two keys, the inner one.

    A record deleted before or when it is loaded never exists, one without a load time neither;
    both still count as records of the key. Blank keys give nothing. Copies of a record cancel as they add.
    """
    loaded = _at("loaded_at")
    gone = _at(deleted) if deleted else F.lit(None).cast("long")
    lives = loaded.isNotNull() & (gone.isNull() | (gone > loaded))
    steps = F.array(
        F.struct(loaded.alias("at"), F.when(lives, 1).otherwise(0).alias("exists"), F.lit(1).alias("loads")),
        F.struct(F.when(lives, gone).alias("at"), F.lit(-1).alias("exists"), F.lit(0).alias("loads")),
    )
    if not deleted:
        steps = F.slice(steps, 1, 1)
    k2 = keys[1] if len(keys) > 1 else F.lit(None)
    rows = records.select(keys[0].alias("k1"), k2.cast("string").alias("k2"), F.explode(steps).alias("s")).where("k1 IS NOT NULL AND (s.at IS NOT NULL OR s.loads = 1)")
    if len(keys) > 1:
        rows = rows.where("k2 IS NOT NULL")
    level = "b" if len(keys) > 1 else "a"
    return _delta(rows, space=F.lit(space), k1=F.col("k1"), k2=F.col("k2"), at=F.col("s.at"), refers=F.lit(0), **{f"{level}_exists": F.col("s.exists"), f"{level}_loads": F.col("s.loads")})


def reference_deltas(rows: DataFrame, space: str, keys: list[Column], spelling: list[Column], slot: Column) -> DataFrame:
    """One delta per referring row; the outer key must not be blank."""
    k2 = keys[1] if len(keys) > 1 else F.lit(None).cast("string")
    picked = rows.select(keys[0].alias("k1"), k2.alias("k2"), _at("loaded_at").alias("at"), spelling[0].alias("s1"), spelling[1].alias("s2"), slot.alias("slot")).where("k1 IS NOT NULL")
    return _delta(
        picked, space=F.lit(space), k1=F.col("k1"), k2=F.col("k2"), at=F.col("at"), refers=F.lit(1), slot=F.col("slot"),
        spelled_1=F.when(~F.col("s1").eqNullSafe(F.col("k1")), F.coalesce("s1", F.lit(ABSENT))), spelled_2=F.when(~F.col("s2").eqNullSafe(F.col("k2")), F.coalesce("s2", F.lit(ABSENT))),
    )


#: Stands for a null spelling beside a key that is not null.
ABSENT = "\x00null"


def _bucket(k1: Column) -> Column:
    return F.pmod(F.xxhash64(k1), F.lit(BUCKETS)).cast("int")


def hot_buckets(keys: list[DataFrame], hot_rows: int = HOT_ROWS, most: int = MOST_HOT) -> list[int] | None:
    """Hash buckets of the key with more than `hot_rows` rows; None if they are more than `most`: then all count as hot.

    Reads the key columns only; at most `most` numbers come to the driver.
    """
    rows = keys[0]
    for k in keys[1:]:
        rows = rows.union(k)
    counts = rows.groupBy(_bucket(F.col(rows.columns[0])).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    hot = [r.bucket for r in counts.where(F.col("n") > hot_rows).select("bucket").limit(most + 1).collect()]
    return None if len(hot) > most else hot


LEVELS = (("a", ["space", "k1"]), ("b", ["space", "k1", "k2"]))


def _split(deltas: DataFrame, is_hot: Column) -> tuple[DataFrame, DataFrame]:
    """(events, held): the deltas with part and salt, and the hot ones summed per key and hour before they are dealt over salts."""
    hour = F.coalesce(F.floor(F.col("at") / F.lit(HOUR)).cast("int"), F.lit(NO_HOUR))
    hot = deltas.where(is_hot).withColumn("part", hour)
    steps = hot.where("refers = 0").groupBy("space", "k1", "k2", "at", "part").agg(*[F.sum(c).cast("int").alias(c) for c in ("a_exists", "a_loads", "b_exists", "b_loads")])
    names = [part.split()[0] for part in DELTA.split(", ")]
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = _delta(steps, **{c: F.col(c) for c in steps.columns if c != "part"}, refers=F.lit(0)).withColumn("part", hour).withColumn("salt", every)
    dealt = hot.where("refers > 0").withColumn("salt", F.pmod(F.xxhash64("k2", "at", "spelled_1", "spelled_2", "slot"), F.lit(SALTS)).cast("int"))
    plain = deltas.where(~is_hot).select(*names, F.lit(0).alias("part"), F.lit(0).alias("salt"))
    return plain.unionByName(copies.select(*plain.columns)).unionByName(dealt.select(*plain.columns)), hot


def judged_references(deltas: DataFrame, hot: list[int] | None = (), held: DataFrame | None = None) -> DataFrame:
    """The references with a_reason and b_reason: missing, late, deleted, or null where the key exists.

    missing: no record has the key; late: none was loaded by then; deleted: otherwise. hot:
    buckets from `hot_buckets`, None for all. held: sums of earlier batches from `ReferenceLedger.sums`. A reference without a
    time is judged by whether its key has any record.
    """
    is_hot = F.lit(True) if hot is None else _bucket(F.col("k1")).isin(list(hot)) if hot else F.lit(False)
    splits = hot is None or bool(hot)
    events, hot_rows = _split(deltas, is_hot) if splits else (deltas.withColumns({"part": F.lit(0), "salt": F.lit(0)}), None)
    out = events
    for level, keys in LEVELS:
        exists, loads = F.col(f"{level}_exists"), F.col(f"{level}_loads")
        # a record without a load time is no load before anything
        timed = F.when(F.col("at").isNull(), 0).otherwise(loads)
        # records come before references of the same time
        whole = Window.partitionBy(*keys, "part", "salt")
        within = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
        sums = {"now": F.sum(exists).over(within), "past": F.sum(timed).over(within), "all": F.sum(loads).over(whole)}
        out = out.withColumns({f"{level}_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
        if splits:
            named = hot_rows.withColumn("k2", F.coalesce("k2", F.lit(ABSENT)))
            parts = named.groupBy(*keys, "part").agg(F.sum(exists).alias("e"), F.sum(timed).alias("t"), F.sum(loads).alias("l"))
            earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            carry = parts.select(*keys, "part", F.sum("e").over(earlier).alias("e"), F.sum("t").over(earlier).alias("t"), F.sum("l").over(Window.partitionBy(*keys)).alias("l"))
            out = out.join(carry, [*keys, "part"], "left").withColumns({
                f"{level}_now": F.col(f"{level}_now") + F.coalesce("e", F.lit(0)),
                f"{level}_past": F.col(f"{level}_past") + F.coalesce("t", F.lit(0)),
                f"{level}_all": F.coalesce("l", f"{level}_all"),
            }).drop("e", "t", "l")
        if held is not None:
            past = held.where(F.col("level") == level).select(*keys, F.col("exists").alias("e"), F.col("timed").alias("t"), F.col("loads").alias("l"))
            out = out.join(past, keys, "left").withColumns({
                f"{level}_now": F.col(f"{level}_now") + F.coalesce("e", F.lit(0)),
                f"{level}_past": F.col(f"{level}_past") + F.coalesce("t", F.lit(0)),
                f"{level}_all": F.col(f"{level}_all") + F.coalesce("l", F.lit(0)),
            }).drop("e", "t", "l")
    for level, _ in LEVELS:
        total, now, past = (F.col(f"{level}_{n}") for n in ("all", "now", "past"))
        reason = F.when(total == 0, "missing").when(F.col("at").isNull() | (now > 0), None).when(past <= 0, "late").otherwise("deleted")
        out = out.withColumn(f"{level}_reason", reason)
    return out.where("refers > 0")


class ReferenceLedger:
    """Signed counts of references, existence and loads per key, kept in a folder and advanced by batches of deltas.

    Every batch adds one small table of the sums of its keys, under the batch's own name, so a batch that is repeated replaces
    itself. Batches come in the order of time: what a batch says is final but for `missing`, which becomes late when
    a record of the key comes (`settled`).
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def sums(self, without: str | None = None) -> DataFrame | None:
        """(level, space, k1, k2, refers, exists, timed, loads) of all batches so far; k2 is null on the outer level."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        rows = self.spark.read.parquet(self.path).where(F.col("step") != f"of-{without}")
        return rows.groupBy("level", "space", "k1", "k2").agg(*[F.sum(c).alias(c) for c in ("refers", "exists", "timed", "loads")])

    def advance(self, deltas: DataFrame, step: str, hot: list[int] | None = ()) -> DataFrame:
        """Judges the references of a batch and adds its sums. Reads the deltas and the sums, nothing else."""
        held = self.sums(step)
        judged = judged_references(deltas, hot, held)
        parts = None
        for level, keys in LEVELS:
            counted = deltas if level == "a" else deltas.where("k2 IS NOT NULL")
            exists, loads = F.col(f"{level}_exists"), F.col(f"{level}_loads")
            part = counted.groupBy(*keys).agg(
                F.sum("refers").alias("refers"), F.coalesce(F.sum(exists), F.lit(0)).alias("exists"),
                F.coalesce(F.sum(F.when(F.col("at").isNotNull(), loads)), F.lit(0)).alias("timed"), F.coalesce(F.sum(loads), F.lit(0)).alias("loads"),
            )
            part = part.select(F.lit(level).alias("level"), "space", "k1", (F.col("k2") if level == "b" else F.lit(None).cast("string")).alias("k2"), "refers", "exists", "timed", "loads")
            parts = part if parts is None else parts.unionByName(part)
        parts.write.mode("overwrite").parquet(f"{self.path}/step=of-{step}")
        return judged

    def orphans(self) -> DataFrame:
        """The keys that have references and do not exist now, with their number and whether a record ever was."""
        return self.sums().where("refers > 0 AND exists <= 0").select("level", "space", "k1", "k2", "refers", F.when(F.col("loads") > 0, "deleted").otherwise("missing").alias("reason"))

    def settled(self, step: str) -> DataFrame:
        """Keys that had references and no record before a batch and got one in it: their missing references become late."""
        keys = ["level", "space", "k1", "k2"]
        own = self.spark.read.parquet(self.path).where((F.col("step") == f"of-{step}") & (F.col("loads") > 0)).select(*keys)
        before = self.sums(step).where("refers > 0 AND loads = 0").select(*[F.col(k).alias(f"b_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
        return own.join(before, same, "left_semi")


def contest_deltas(slots: DataFrame, players: DataFrame, battles: DataFrame, accounts: DataFrame) -> DataFrame:
    """The deltas of the three references of the contest tables: slots to battles and to sides, players to accounts."""
    battle, side, user = key("battle_id"), key("player_side"), key("username")
    return (
        reference_deltas(slots, "battle", [battle, side], [F.col("battle_id"), F.col("player_side")], F.col("slot_no"))
        # a user row is spelled by its battle and side, so these are carried as they are
        .unionByName(reference_deltas(players, "user", [user], [F.col("battle_id"), F.col("side")], F.lit(0)))
        .unionByName(existence_deltas(battles, "battle", [battle]))
        .unionByName(existence_deltas(players, "battle", [battle, key("side")], None))
        .unionByName(existence_deltas(accounts, "user", [user]))
    )


def contest_orphans(slots: DataFrame, players: DataFrame, battles: DataFrame, accounts: DataFrame, hot_rows: int = HOT_ROWS, most_hot: int = MOST_HOT) -> DataFrame:
    """(table_name, field, period, battle_id, player_side, slot_no, reason) without repeated rows.

    Keys are compared without case and surrounding blanks; blank keys refer to nothing. slot_no is 0
    for battle_players, null where the row has none; period is null for a row without a load time.
    """
    battle, user = key("battle_id"), key("username")
    hot = hot_buckets([slots.select(battle), players.select(battle), players.select(user), battles.select(battle), accounts.select(user)], hot_rows, most_hot)
    return orphan_rows(judged_references(contest_deltas(slots, players, battles, accounts), hot))


def orphan_rows(judged: DataFrame) -> DataFrame:
    """The judged references that are orphans, as rows of the report."""
    orphans = judged.where("a_reason IS NOT NULL OR (b_reason IS NOT NULL AND k2 IS NOT NULL AND space = 'battle')")
    row = lambda table, field, reason: F.struct(F.lit(table).alias("table_name"), F.lit(field).alias("field"), reason.alias("reason"))
    of_slot = F.array(row("battle_team_slot", "battle_id", F.col("a_reason")), row("battle_team_slot", "player_side", F.when(F.col("k2").isNotNull(), F.col("b_reason"))))
    of_user = F.array(row("battle_players", "username", F.col("a_reason")))
    spelled = lambda n: F.nullif(F.coalesce(f"spelled_{n}", f"k{n}"), F.lit(ABSENT))
    return (
        orphans.select(F.explode(F.when(F.col("space") == "battle", of_slot).otherwise(of_user)).alias("o"), F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"), spelled(1).alias("battle_id"), spelled(2).alias("player_side"), F.col("slot").alias("slot_no"))
        .where("o.reason IS NOT NULL")
        .select("o.table_name", "o.field", "period", "battle_id", "player_side", "slot_no", "o.reason").distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(table_name, field, period, reason, orphans): the report per table and month."""
    return orphans.groupBy("table_name", "field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))
