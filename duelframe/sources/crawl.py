"""Incremental crawl of replays: what to fetch next, and what of the fetched to keep.

Fetching itself is the caller's; listings and replays are tables of what came back, such as JSON pages in a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators.diagnosis import is_complete

LISTED = "id string, uploadtime long"
REPLAY = "id string, uploadtime long, log string"


def read_pages(spark: SparkSession, folder: str, schema: str = LISTED) -> DataFrame:
    """The entries of JSON pages (arrays of objects, one page a file) without repeats."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).distinct()


def next_ids(listing: DataFrame, held: DataFrame, prefix: str, want: int) -> DataFrame:
    """(id) to fetch next: forward all from the newest held one on, then backward from the oldest held one until `want` are listed.

    Only ids of the prefix; held ids do not come again, though they count for `want`. Without held ones all is backward from the
    newest. Entries without a time are left out; of entries of one time the smaller id comes first.
    """
    ours = listing.where(F.startswith("id", F.lit(prefix)) & F.col("uploadtime").isNotNull()).select("id", "uploadtime").distinct()
    ends = held.where(F.startswith("id", F.lit(prefix))).agg(F.min("uploadtime"), F.max("uploadtime")).first()
    newer = ours.where(F.col("uploadtime") >= ends[1]) if ends[1] is not None else ours.limit(0)
    older = ours.where(F.col("uploadtime") <= ends[0]) if ends[0] is not None else ours
    rest = max(0, want - newer.count())
    picked = newer.unionByName(older.orderBy(F.desc("uploadtime"), "id").limit(rest))
    return picked.select("id").distinct().join(held.select("id"), "id", "left_anti")


def keep_new(fetched: DataFrame, held: DataFrame) -> DataFrame:
    """Held replays and the complete ones of those that were fetched (P12); of one id the fetched one counts, of several the latest."""
    good = fetched.where(is_complete(F.col("log"))).select("id", "uploadtime", "log")
    rows = good.withColumn("fresh", F.lit(1)).unionByName(held.select("id", "uploadtime", "log").withColumn("fresh", F.lit(0)))
    best = rows.groupBy("id").agg(F.max_by(F.struct("uploadtime", "log"), F.struct("fresh", "uploadtime", F.md5("log"))).alias("r"))
    return best.select("id", "r.uploadtime", "r.log")
