"""Problem 8: mixing sources to target weights by systematic sampling.

Every document of a source is expected min(target tokens / tokens of the source,
max_repeats) times. Documents are put in a fixed pseudo-random order, the expected copies
are summed as a prefix sum, one random offset per source is added, and a document is
emitted once for every whole number that its step crosses. So a document is used
floor or ceil of the expectation, never more than max_repeats times, and the number of
copies of a source differs from the expectation by less than one document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from duelframe.session import Scratch

#: Place of the vocabulary; a parameter of every function that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: GPT-2's public pattern for words, needed beside the ranks of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents of one source are spread over so many blocks for the prefix sum.
BLOCKS = 4096

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        _encoders[path] = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each whole text under a public tokenizer; null and empty texts have 0.

    The encoder merges unbroken pieces in nearly linear time, so long texts are not cut.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, LongType())(F.col(text) if isinstance(text, str) else text)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens); whole-row copies count once, documents without an id or source are left out."""
    rows = documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL AND source IS NOT NULL")
    rows = rows.select("doc_id", "source", token_count("text", vocabulary).alias("tokens"))
    return rows.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: tokens, documents, wanted tokens, expected copies per document.

    The mix is as large as all documents together. A source that is too small is used
    max_repeats times and flagged; a source without documents or tokens expects 0 copies. A repeated
    target row counts once.
    """
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    total = own.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    wanted = F.col("target_share") * F.col("all_tokens")
    return (
        targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"])
        .join(own, "source", "left")
        .fillna(0, ["source_tokens", "source_docs"])
        .join(F.broadcast(total), how="inner")  # one row
        .withColumn("wanted_tokens", wanted)
        .withColumn("short", F.col("source_tokens") * F.col("max_repeats") < wanted)
        .withColumn("copies", F.coalesce(F.least(F.try_divide("wanted_tokens", "source_tokens"), F.col("max_repeats").cast("double")), F.lit(0.0)))
    )


def chosen(sizes: DataFrame, plan: DataFrame, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents of the mix, repeats at least 1.

    The prefix sum has two levels: totals per (source, block) are summed over the blocks,
    which are bounded in number, and each block is summed on its own, so no task holds a
    source. Inside a block documents are ordered by size, which evens out the tokens. plan has one row
    per source; a source without a plan is not used.
    """
    placed = sizes.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"))
    totals = placed.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "block").orderBy("tokens", "doc_id"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    step = F.col("start") + F.col("rank")
    repeats = F.floor(offset + F.col("copies") * step) - F.floor(offset + F.col("copies") * (step - 1))
    return (
        placed.withColumn("rank", rank)
        .join(starts, ["source", "block"])
        .join(plan.select("source", "copies", "max_repeats"), "source")
        .select("doc_id", "source", "tokens", F.least(repeats, F.col("max_repeats").cast("long")).alias("repeats"))
        .where("repeats > 0")
    )


def reached(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: wanted and actual share of the mix, its tokens and documents, and whether it is used up.

    A source is used up if every document of it is in the mix max_repeats times, also if it has none.
    """
    got = mix.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.count(F.lit(1)).alias("mix_docs"),
        F.max("repeats").alias("most_repeats"), F.min("repeats").alias("least_repeats"),
    )
    total = got.agg(F.sum("mix_tokens").alias("total"))
    all_full = (F.col("mix_docs") == F.col("source_docs")) & (F.col("least_repeats") == F.col("max_repeats"))
    return (
        plan.select("source", "target_share", "max_repeats", "short", "wanted_tokens", "source_docs").join(got, "source", "left")
        .fillna(0, ["mix_tokens", "mix_docs", "most_repeats", "least_repeats"])
        .join(F.broadcast(total), how="inner")  # one row
        .withColumn("actual_share", F.coalesce(F.try_divide("mix_tokens", "total"), F.lit(0.0)))
        .withColumn("used_up", F.coalesce(all_full | (F.col("source_docs") == 0) | (F.col("max_repeats") == 0), F.lit(False)))
        .drop("total", "source_docs", "least_repeats")
    )


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mix, plan) of the whole documents; their sizes are counted once and written to the shared folder."""
    sizes = Scratch(documents.sparkSession, "p8").save(sized(documents, vocabulary))
    plan = source_plan(sizes, targets)
    return chosen(sizes, plan), plan


def short_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source): sources that the drawn mix uses up without reaching their share of the tokens."""
    return reached(*mixed(documents, targets, vocabulary)).where("used_up AND mix_tokens < wanted_tokens").select("source")
