"""Resumable ingestion of raw logs with Structured Streaming.

A checkpoint remembers which files were read. Each micro-batch writes its fact tables under its
own batch number, so a batch that is repeated after a crash replaces itself; contests that an earlier
batch holds are left out by a join on their ids, of which only the hash buckets of the batch are read.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from duelframe.session import Scratch
from duelframe.sources.logs import META, contest_id, fact_tables, valid_logs

#: Ids of accepted contests are kept in so many folders by their hash.
ID_BUCKETS = 64
TABLES_AT_ONCE = 4


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _bucket(battle_id: Column) -> Column:
    return F.pmod(F.xxhash64(battle_id), F.lit(ID_BUCKETS)).cast("int")


def source_logs(rows: DataFrame, log_col: str = "log", id_col: str | None = "battle_id", limit_rows: int = 0) -> DataFrame:
    """(battle_id, log, replay_path, source_file, row_no and the META columns there are) of Parquet rows with logs.

    limit_rows: only so many first rows of each file, 0 for all. Without an id column the id is a digest of the log's head.
    """
    meta = [c for c, _, _ in META if c in rows.columns]
    number = F.col("_metadata.row_index")
    ident = F.col(id_col).cast("string") if id_col else contest_id(F.col(log_col))
    path = F.col("_metadata.file_path")
    picked = rows.select(ident.alias("battle_id"), F.col(log_col).alias("log"), path.alias("replay_path"), path.alias("source_file"), number.alias("row_no"), *meta)
    return picked.where(F.col("row_no") < limit_rows) if limit_rows else picked


def write_batch(logs: DataFrame, number: int, out: str) -> dict[str, int]:
    """One batch of logs: new contests to the fact tables, the rest to errors. Gives the rows written per table (K3)."""
    spark = logs.sparkSession
    scratch = Scratch(spark, "ingest")
    good, errors = valid_logs(logs)
    ids = f"{out}/ids"
    if _exists(spark, ids):
        good = good.withColumn("bucket", _bucket(F.col("battle_id")))
        held = [r.bucket for r in good.select("bucket").distinct().collect()]  # at most ID_BUCKETS numbers
        known = spark.read.parquet(ids).where((F.col("batch") != number) & F.col("bucket").isin(held)).select("bucket", "battle_id")
        good = good.join(known, ["bucket", "battle_id"], "left_anti").drop("bucket")
    good = scratch.save(good)
    facts = fact_tables(good, scratch.save)

    def write(df: DataFrame, path: str, *by: str) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*by).parquet(path)
        return seen.get.get("n", 0)

    facts.damages  # noqa: B018 - written before tables are made at the same time
    found = errors.unionByName(facts["errors"]).select("source_file", "battle_id", F.left("error", F.lit(1000)).alias("error"))
    tables = {**facts, "errors": found}
    # the tables are projections of one written state: some at a time fill the cores
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        jobs = {name: pool.submit(write, df, f"{out}/{name}/batch={number}") for name, df in tables.items()}
        counts = {name: job.result() for name, job in jobs.items()}
    # the ids come last: a batch that fails before is read again as a whole
    write(facts["battle"].select("battle_id", _bucket(F.col("battle_id")).alias("bucket")), f"{ids}/batch={number}", "bucket")
    scratch.clear()
    return counts


def read_parts(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All batches of a fact table as one, in the types of the first (K4); parts that differ are cast."""
    first = spark.read.parquet(f"{out}/{name}").schema
    return spark.read.option("mergeSchema", True).parquet(f"{out}/{name}").select(*[F.col(f.name).cast(f.dataType) for f in first if f.name != "batch"])


def ingest_stream(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, files_a_batch: int = 100, log_col: str = "log", id_col: str | None = "battle_id", limit_rows: int = 0
) -> StreamingQuery:
    """Reads all files that are new under `source` and ends; the same call goes on where the last one stopped."""
    rows = source_logs(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source), log_col, id_col, limit_rows)
    return rows.writeStream.foreachBatch(lambda df, n: write_batch(df, n, out) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
