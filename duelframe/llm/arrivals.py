"""Problem 4: new batches against all history, by fingerprints in rotated block tables.

A record is known by texts: its replay id and the place of its replay, each brought to one
spelling. Every distinct text gets a 64-bit similarity fingerprint (weighted votes of
character grams). The index stores it once per rotation: `blocks` tables, table i keyed
by block i of the fingerprint. Two fingerprints that differ in fewer than `blocks` bits agree
in a whole block, so an exact look-up in the tables finds them; the Hamming distance and
then the texts decide: equal, or the same digits and all short words with a slip in a long word.
Texts that can be one have the same shape (all but the long words), so a digest of the shape is looked
up with the block: entries of a block, which grow with history, are not compared one by one.

The index is a folder that can be opened again. `accept` looks a batch up and appends the
fingerprints of its new texts, each with the first record it stands for, so history is read
once, when it is indexed, and never again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import LongType

from duelframe.functions.text import key, trimmed
from duelframe.session import Scratch

BLOCKS = 3  # rotations; finds all fingerprints that differ in at most two bits
GRAM = 4
#: First folders of known places; what stands before them is a mount point.
ROOTS = ("data", "replays", "recrawl")
#: Near texts are one if they differ by at most SLIPS edits inside words of LONG letters or more.
LONG, SLIPS = 5, 2
#: Batches that wait together are looked up together up to so many arrivals, or as many as there are indexed texts.
ROWS_AT_ONCE = 200_000
ENTRY = "kind string, text string, owner long, name string, fp long, rotation int, block long, shape int"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: list[str | None], gram: int = GRAM, rows_at_once: int = 4096) -> np.ndarray:
    """64-bit similarity fingerprints; a null text counts as ''.

    Grams with digits weigh four times as much as others, since the digits tell records
    apart while formats and folders are shared by very many.
    """
    out = np.zeros(len(texts), np.uint64)
    for low in range(0, len(texts), rows_at_once):
        raws = [((t or "") + "\x00" * gram).encode() for t in texts[low : low + rows_at_once]]
        data = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(r) for r in raws])
        begin = np.cumsum(sizes) - sizes
        code = np.zeros(len(data), np.uint64)
        digit = np.zeros(len(data), bool)
        padded = np.concatenate([data, np.zeros(gram, np.uint8)])
        for i in range(gram):
            part = padded[i : i + len(data)]
            code = code * np.uint64(257) + part
            digit |= (part >= 48) & (part <= 57)
        nth = np.arange(len(data)) - np.repeat(begin, sizes)
        inside = nth < np.repeat(sizes, sizes) - gram  # grams of the padding would reach into the next text
        # grams with digits also tell the how manieth of them they are, so that swapped digits matter and a slip in a word does not
        ordinal = np.cumsum(digit)
        ordinal = np.where(digit, ordinal - np.repeat(ordinal[begin] - digit[begin], sizes), 0)
        bits = np.unpackbits(_mixed(code * _MIX + ordinal.astype(np.uint64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        weight = (np.where(digit, 4, 1) * inside).astype(np.uint8)
        bits *= weight[:, None]
        votes = np.add.reduceat(bits, begin, axis=0, dtype=np.uint32)
        whole = np.add.reduceat(weight, begin, dtype=np.uint32)
        out[low : low + len(raws)] = np.packbits(2 * votes > whole[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batch(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts.to_pylist()).view(np.int64))


_fingerprint = arrow_udf(_fingerprint_batch, LongType())


def fingerprint(text: Column | str) -> Column:
    return _fingerprint(F.col(text) if isinstance(text, str) else text)


def replay_id(col: Column) -> Column:
    """One spelling of a replay id: no case, blanks, 'battle-' in front or private key behind; null if blank."""
    plain = F.regexp_replace(F.regexp_replace(key(col), "_", "-"), r"^(battle-)+", "")
    return F.nullif(F.regexp_replace(plain, r"^(.*-[0-9]+)-[a-z0-9]+pw$", "$1"), F.lit(""))


def _stepped(path: Column) -> Column:
    """A path without steps back, however nested: each '..' takes the folder before it away, if there is one."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, part: F.when((part == "..") & (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(parts, "/")


def replay_place(col: Column, roots: tuple[str, ...] = ROOTS) -> Column:
    """One spelling of a place: decoded, '/' between folders, no case, '.', '..', mount point, copy number or packing."""
    p = F.regexp_replace(trimmed(col), r"\+", "%2B")
    p = F.lower(F.translate(F.coalesce(F.try_url_decode(p), F.regexp_replace(p, "%2B", "+")), "\\", "/"))
    p = F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"(?<=^|/)(\./)+", "")
    p = F.transform(F.array(p), lambda x: F.when(x.contains("/../"), _stepped(x)).otherwise(x))[0]  # the steps before are taken once
    p = F.regexp_replace(p, rf"^.*?(?=(?<=^|/)({'|'.join(roots)})/)", "")
    p = F.regexp_replace(p, r"^/+", "")
    p = F.regexp_replace(p, r"\.(gz|zst|bz2|xz|zip)$", "")
    return F.nullif(trimmed(F.regexp_replace(p, r"\s*\([0-9]+\)(?=\.[a-z0-9]+$)", "")), F.lit(""))


def keyed(records: DataFrame, order: Column, *carry: str) -> DataFrame:
    """(order, carry.., kind, text): the texts by which each record is known; records with none vanish.

    A single-replay file is named after its replay id, so that name is an id as well.
    """
    placed = records.select(order.alias("ord"), *carry, replay_id(F.col("battle_id")).alias("_id"), replay_place(F.col("replay_path")).alias("_place"))
    place = F.col("_place")
    stem = replay_id(F.nullif(F.regexp_extract(place, r"^replays/(?:.*/)?([^/#]+)\.log$", 1), F.lit("")))
    texts = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("_id").alias("text")),
        F.struct(F.lit("place").alias("kind"), place.alias("text")),
        F.struct(F.lit("id").alias("kind"), stem.alias("text")),
    )
    return placed.select("ord", *carry, F.explode(F.array_distinct(texts)).alias("k")).select("ord", *carry, "k.kind", "k.text").where("text IS NOT NULL")


def first_texts(keys: DataFrame) -> DataFrame:
    """(kind, text, owner, name): one row per distinct text with its first record."""
    first = keys.groupBy("kind", "text").agg(F.min(F.struct("ord", "battle_id")).alias("o"))
    return first.select("kind", "text", F.col("o.ord").alias("owner"), F.col("o.battle_id").alias("name"))


def block_tables(index: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Every entry once per rotation, with the leading block of the rotated fingerprint as key."""
    width = 64 // blocks
    cuts = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(blocks)]
    rotations = F.array(*[F.struct(F.lit(i).alias("rotation"), c.alias("block")) for i, c in enumerate(cuts)])
    return index.select("*", F.explode(rotations).alias("r")).select("*", "r.rotation", "r.block").drop("r")


def skeleton(text: str) -> Column:
    """A text with its words of LONG letters or more blotted out."""
    return F.regexp_replace(text, rf"[a-z]{{{LONG},}}", "~")


def shape(text: str) -> Column:
    """Short digest of what two texts that stand for one record have in common; with a block it is enough to tell entries apart."""
    return F.pmod(F.xxhash64(skeleton(text)), F.lit(1 << 16)).cast("int")


def _looked_up(entries: DataFrame) -> DataFrame:
    """The entries that can meet another: without a long word a text meets its equals only, which the first rotation finds."""
    return entries.where((F.col("rotation") == 0) | F.col("text").rlike(rf"[a-z]{{{LONG},}}"))


def same_text(a: str, b: str) -> Column:
    """Whether two texts of near fingerprints stand for one record: equal, or at most SLIPS edits apart,
    all of them inside words of LONG letters or more. Digits and short words tell records apart."""
    return (F.col(a) == F.col(b)) | ((skeleton(a) == skeleton(b)) & (F.levenshtein(F.col(a), F.col(b), SLIPS) >= 0))


def matches(asked: DataFrame, tables: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(ord, kind, asked, owner, name, equal): index entries that stand for the same record as a text that is asked for.

    asked: (ord, kind, text, fp). Block and shape match, then Hamming distance, then text. An entry is met in the first rotation whose blocks are equal.
    """
    probe = _looked_up(block_tables(asked.select("ord", "kind", "text", F.col("fp").alias("asked_fp"), "fp", shape("text").alias("shape")), blocks)).drop("fp").withColumnRenamed("text", "asked")
    entries = _looked_up(tables).select("kind", "rotation", "block", "shape", "text", "owner", "name", "fp")
    differ = F.col("asked_fp").bitwiseXOR(F.col("fp"))
    width = 64 // blocks
    before = F.lit(True)
    for i in range(blocks - 1):
        before = before & ((F.col("rotation") <= i) | (F.shiftrightunsigned(differ, i * width).bitwiseAND(F.lit((1 << width) - 1)) != 0))
    near = probe.join(entries, ["kind", "rotation", "block", "shape"]).where((F.bit_count(differ) < blocks) & before)
    return near.where(same_text("asked", "text")).where("owner < ord").select("ord", "kind", "asked", "owner", "name", (F.col("asked") == F.col("text")).alias("equal"))


class ReplayIndex:
    """Block tables in a folder, extended batch by batch; the same folder can be opened again later.

    Each append is a subfolder of its own, named by the caller, so an append that is repeated after
    a crash replaces itself.
    """

    def __init__(self, spark, path: str, blocks: int = BLOCKS, scratch: Scratch | None = None):
        self.spark, self.path, self.blocks = spark, path.rstrip("/"), blocks
        self.scratch = scratch or Scratch(spark, "replay-index")

    @property
    def tables(self) -> DataFrame:
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/step=*")
        return rows.withColumn("shape", F.coalesce("shape", shape("text")))  # older folders have none

    def append(self, texts: DataFrame, step: str) -> None:
        """Add (kind, text, owner, name, fp) entries; files are sorted by block, so that row groups can be passed over."""
        rows = block_tables(texts.withColumn("shape", shape("text")), self.blocks).select("kind", "text", "owner", "name", "fp", "rotation", "block", "shape")
        rows.sortWithinPartitions("rotation", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/step=of-{step}")

    def load_history(self, battles: DataFrame) -> None:
        """Index the accepted records, once."""
        self.append(first_texts(history_keys(battles)).withColumn("fp", fingerprint("text")), "history")

    def accept(self, arrivals: DataFrame, step: str) -> DataFrame:
        """(row_id, owner, name): the arrivals of one batch (or of some that wait together) that repeat a record.

        Of several records, accepted battles (owner < 0) come before arrivals, and earlier ones before later
        ones. Only the batch is fingerprinted. Its new texts are appended with the first record that they
        stand for, so that later batches meet that record at once; repeats of repeats inside the batch are followed by
        pointer jumping, whose rounds grow with the logarithm of the longest chain.
        """
        save, drop = self.scratch.save, self.scratch.drop
        keys = save(keyed(arrivals, F.col("row_id"), "battle_id").withColumn("fp", fingerprint("text")))
        own = block_tables(keys.groupBy("kind", "text", "fp").agg(F.min(F.struct("ord", "battle_id")).alias("o")).select("kind", "text", F.col("o.ord").alias("owner"), F.col("o.battle_id").alias("name"), "fp", shape("text").alias("shape")), self.blocks)
        hits = save(matches(keys, self.tables.unionByName(own.select(*[f.split()[0] for f in ENTRY.split(", ")])), self.blocks).distinct())
        links = hits.groupBy(F.col("ord").alias("row_id")).agg(F.min(F.struct("owner", "name")).alias("o")).select("row_id", "o.owner", "o.name")
        links = self._followed(links)
        known = hits.join(keys.select("ord").distinct().withColumnRenamed("ord", "owner"), "owner", "left_anti").where("equal").select("kind", F.col("asked").alias("text")).distinct()
        fresh = keys.join(known, ["kind", "text"], "left_anti").join(links.select(F.col("row_id").alias("ord"), "owner", "name"), "ord", "left")
        fresh = fresh.groupBy("kind", "text", "fp").agg(F.min(F.struct(F.coalesce("owner", "ord").alias("owner"), F.when(F.col("owner").isNull(), F.col("battle_id")).otherwise(F.col("name")).alias("name"))).alias("o"))
        self.append(fresh.select("kind", "text", "o.owner", "o.name", "fp"), step)
        for df in (keys, hits):
            drop(df)
        return links

    def _followed(self, links: DataFrame) -> DataFrame:
        """The links with the first record of each chain of repeats."""
        links = self.scratch.save(links)
        while True:
            up = links.select(F.col("row_id").alias("owner"), F.col("owner").alias("next_owner"), F.col("name").alias("next_name"))
            moved = F.col("next_owner").isNotNull()
            step = links.join(up, "owner", "left").select("row_id", F.coalesce("next_owner", "owner").alias("owner"), F.when(moved, F.col("next_name")).otherwise(F.col("name")).alias("name"), moved.alias("moved"))
            step = self.scratch.save(step)
            self.scratch.drop(links)
            if step.where("moved").limit(1).count() == 0:
                return step.drop("moved")
            links = step.drop("moved")


def history_keys(battles: DataFrame) -> DataFrame:
    """Keys of accepted battles; their order is before every arrival, earlier loads first."""
    before = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0)) - F.lit(1 << 62)
    return keyed(battles, before, "battle_id")


def found(battles: DataFrame, arrivals: DataFrame, blocks: int = BLOCKS, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(row_id, first_battle_id): arrivals that repeat an accepted battle or an earlier arrival.

    The accepted battles are indexed, then the batches are accepted in order. Batches that wait
    together are looked up together, up to `rows_at_once` arrivals or as many as there are indexed texts, so that
    the index is not read the more often the more there are of both; how they are grouped changes no row. Rows
    without an id and a place repeat nothing; rows without a row_id are left out, rows without a batch come
    first; repeated rows count once; empty tables give no rows.
    """
    spark = arrivals.sparkSession
    scratch = Scratch(spark, "p4")
    index = ReplayIndex(spark, f"{scratch.root}/index", blocks, scratch)
    index.load_history(battles)
    at_once = max(rows_at_once, index.tables.count() // blocks)
    named = arrivals.where("row_id IS NOT NULL").withColumn("batch_no", F.coalesce("batch_no", F.lit(-1)))
    # one number per batch
    sizes = named.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_no").collect()
    groups: list[tuple[int, int]] = []
    held = 0
    for r in sizes:
        if groups and held + r.n <= at_once:
            groups[-1], held = (groups[-1][0], r.batch_no), held + r.n
        else:
            groups.append((r.batch_no, r.batch_no))
            held = r.n
    out = None
    for low, high in groups:
        got = index.accept(named.where(F.col("batch_no").between(low, high)), f"{low}-{high}")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return named.select("row_id", F.col("battle_id").alias("first_battle_id")).where(F.lit(False))
    return out.select("row_id", F.col("name").alias("first_battle_id"))
