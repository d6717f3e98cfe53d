"""Readers and checked writers of tables (S-rows, K-rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from duelframe.functions.text import bare


class LoadError(ValueError):
    """A target that must not be written."""


def log_column(df: DataFrame) -> str:
    """The column that holds logs: by its usual names, else the first text column of which a sample has player lines."""
    for name in ("log", "replay_log", "battle_log", "raw_log"):
        if name in df.columns:
            return name
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    rows = df.select(*texts).limit(5).collect() if texts else []
    for name in texts:
        if any("|player|" in (r[name] or "") for r in rows):
            return name
    raise LoadError("no column holds logs")


def read_logs(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """(stem, log) of a tree of text files, one row a file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"), F.col("value").alias("log"))


def read_first(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame | None:
    """An aggregate as Parquet, else as CSV with the schema, else None."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    there = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    if there(f"{folder}/{name}.parquet"):
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if there(f"{folder}/{name}.csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(f"{folder}/{name}.csv")
    return None


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A CSV lookup as text, rows with nulls dropped, values trimmed."""
    df = spark.read.option("header", True).csv(path).dropna()
    return df.select(*[bare(F.col(c)).alias(c) for c in df.columns])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema in its order: absent ones null, values that cannot be cast null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def check_target(df: DataFrame, target: StructType) -> None:
    """Every column must exist in the target, which may have more (K6)."""
    extra = [c for c in df.columns if c not in target.fieldNames()]
    if extra:
        raise LoadError(f"columns that the target does not have: {extra}")


def write_all(tables: dict[str, DataFrame], folder: str, targets: dict[str, StructType] | None = None, overwrite: bool = False) -> None:
    """Writes tables as Parquet after all have been checked; a table that is there is refused unless overwritten (K1, K6, K8)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if targets:
            check_target(df, targets[name])
        if not overwrite and read_first(spark, folder, name) is not None:
            raise LoadError(f"{name} is there already")
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{name}.parquet")


def write_pair(df: DataFrame, folder: str, name: str) -> None:
    """An aggregate as Parquet and as CSV with a header."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_jdbc(
    df: DataFrame, url: str, name: str, widths: dict[str, int], properties: dict[str, str] | None = None, overwrite: bool = True, indexes: list[list[str]] | None = None
) -> list[str]:
    """An aggregate to a database table with bounded text columns (K9, K12); gives the statements that make its indexes.

    An index over a column that the table does not have is an error before anything is written. The driver's jar comes with the cluster.
    """
    made = index_statements(df, name, indexes or [])
    types = ", ".join(f"{c} VARCHAR({w})" for c, w in widths.items() if c in df.columns)
    writer = df.write.mode("overwrite" if overwrite else "append").option("truncate", True)
    (writer.option("createTableColumnTypes", types) if types else writer).jdbc(url, name, properties=properties or {})
    return made


def index_statements(df: DataFrame, name: str, indexes: list[list[str]]) -> list[str]:
    """CREATE INDEX statements, numbered from 1."""
    for columns in indexes:
        absent = [c for c in columns if c not in df.columns]
        if absent:
            raise LoadError(f"{name}: no such columns to index: {absent}")
    return [f"CREATE INDEX idx_{name}_{i} ON {name} ({', '.join(columns)})" for i, columns in enumerate(indexes, start=1)]


def write_indexed(df: DataFrame, path: str, by: list[str], bloom: list[str] | None = None, partitions: int | None = None) -> None:
    """A fact table laid out for look-ups (K13): hashed and sorted by the key, so that row groups have narrow ranges, with Bloom filters of the given columns."""
    parted = df.repartition(partitions, *by) if partitions else df.repartition(*by)
    writer = parted.sortWithinPartitions(*by).write.mode("overwrite")
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def write_sorted(df: DataFrame, path: str, order: list[tuple[str, bool]], ties: list[str]) -> None:
    """An aggregate table in its published order (O1): columns with whether they descend, then tie-breakers; aggregates are small beside the facts."""
    df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order], *ties).write.mode("overwrite").parquet(path)


def resume_point(groups: DataFrame, existing: int) -> int:
    """The first chunk that is not loaded yet, of chunks (chunk, rows) loaded in order, when so many rows are there.

    A number of rows that is no boundary of chunks means that the target is no clean prefix: an error.
    """
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))  # one row per chunk
    hit = starts.where(F.col("start") == existing).agg(F.min("chunk")).first()[0]
    if hit is not None:
        return hit
    whole = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("chunk") + 1, F.lit(0))).first()
    if whole[0] == existing:
        return whole[1]
    raise LoadError(f"{existing} rows do not end on a boundary of the {whole[0]} rows to load")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def insert_lines(df: DataFrame, name: str) -> DataFrame:
    """(value): one INSERT statement per row with escaped text."""
    def literal(c: str, kind: str):
        text = F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.coalesce(F.col(c).cast("string") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else text, F.lit("NULL"))

    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *[literal(c, t) for c, t in df.dtypes]), F.lit(");")).alias("value"))


def table_sizes(tables: dict[str, DataFrame]) -> dict[str, tuple[int, list[tuple[str, str]]]]:
    """Rows and schema of every table."""
    return {n: (df.count(), df.dtypes) for n, df in tables.items()}
