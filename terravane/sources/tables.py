"""Chunk cache, asset parts and table writers.

A table is a folder of Parquet files. A write goes to a new folder beside the old one and takes its place when it is
whole, so a job that fails leaves the old table as it was, and a table can be replaced by a frame that reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.functions import geo
from terravane.operators import upsert
from terravane.runtime import materialize


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system; other errors than absence are raised."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def truncate_and_load(df: DataFrame, path: str, *by: str) -> int:
    """Replace the whole table by ``df``, partitioned by ``by``; the number of rows written."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(new) if by else df.write.parquet(new)
    fs, target = _fs(spark, path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, jpath(old))
    fs.rename(jpath(new), target)
    fs.delete(jpath(old), True)
    return spark.read.schema(df.schema).parquet(path).count()


def append_rows(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Append ``df``; with rows_per_file no file holds more."""
    out = df.write.mode("append")
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)


def insert_with_geometry(df: DataFrame, path: str, wkt: str = "wkt") -> None:
    """Append rows with their WKT and its points; text that is no geometry has NULL points."""
    append_rows(df.withColumn("points", geo.wkt_points(F.col(wkt))), path)


def replace_partition(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that ``df`` has: a run's rows are deleted and written again in one step."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_table(df: DataFrame, path: str, keys: list[str], *order) -> int:
    """Rows of ``df`` take the place of those with their keys; the last write wins."""
    spark = df.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else df.limit(0)
    return truncate_and_load(upsert.last_wins(old, df, keys, *order), path)


def update_from(path: str, staged: DataFrame, keys: list[str], columns: list[str]) -> int:
    """Set ``columns`` of the rows whose keys are staged, a NULL too; other rows and columns stay."""
    old = staged.sparkSession.read.parquet(path)
    fresh = staged.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = old.join(upsert.first_kept(fresh, keys, *(F.desc_nulls_last(f"_new_{c}") for c in columns)), keys, "left")
    out = out.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
    return truncate_and_load(out.select(*old.columns), path)


def migrate(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Bring the table at ``path`` to ``schema``: make it if it is missing, add columns as NULL, widen types; what was done.

    Columns that the schema does not have stay. Running it again does nothing.
    """
    if not exists(spark, path):
        truncate_and_load(spark.createDataFrame([], schema), path)
        return ["made"]
    old = spark.read.parquet(path)
    kinds, done, columns = dict(old.dtypes), [], {}
    for f in schema:
        kind = f.dataType.simpleString()
        if f.name not in kinds:
            columns[f.name] = F.lit(None).cast(kind)
            done.append(f"added {f.name}")
        elif kinds[f.name] != kind:
            columns[f.name] = F.col(f.name).cast(kind)
            done.append(f"{f.name} to {kind}")
    if done:
        truncate_and_load(old.withColumns(columns), path)
    return done


def append_letters(letters: DataFrame, path: str) -> int:
    """Append dead letters with the time of their rejection; how many."""
    n = letters.count()
    if n:
        append_rows(letters.withColumn("rejected_at", F.current_timestamp()), path)
    return n


def pending(items: DataFrame, done: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows whose key is not finished yet; keys, not chunk numbers, so a changed grid reuses nothing wrong."""
    return items.join(done.select(key), key, "left_anti")


def append_chunk(df: DataFrame, path: str, chunk: str) -> None:
    df.withColumn("chunk", F.lit(chunk)).write.mode("append").partitionBy("chunk").parquet(path)


def run_chunks(
    cells: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, chunk_size: int, on_chunk: Callable[[str, DataFrame], None] | None = None, key: str = "cell_id"
) -> DataFrame:
    """The table at ``path``, with a row of ``compute`` for every cell; cells without one get NULLs.

    Cells that the table has are not computed again. The others are numbered by key (from the counts of key ranges, so no
    task sees them all) and cut into chunks of ``chunk_size``, all computed in one job and appended by chunk; ``on_chunk``
    is called once for each, in the chunks' order.
    """
    spark = cells.sparkSession
    todo = pending(cells, spark.read.parquet(path), key) if exists(spark, path) else cells
    ranged = todo.repartitionByRange(key).sortWithinPartitions(key)
    ranged = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "todo")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if n:
        batch, chunks, first, at = uuid.uuid4().hex[:8], -(-n // chunk_size), {}, 0
        for p in sorted(sizes):
            first[p], at = at, at + sizes[p]
        start = F.create_map(*(F.lit(x).cast("long") for kv in first.items() for x in kv))[F.col("_part").cast("long")]
        number = F.floor((start + F.col("_row")) / chunk_size) + 1
        todo = ranged.withColumn("chunk", F.format_string(f"{batch}-%06d", number)).drop("_part", "_row")
        out = todo.select(key, "chunk").join(compute(todo.drop("chunk")), key, "left")
        out.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(path)
        if on_chunk:
            for k in range(1, chunks + 1):
                name = f"{batch}-{k:06d}"
                on_chunk(name, spark.read.parquet(path).filter(F.col("chunk") == name))
    return spark.read.parquet(path)


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Parts of one layer together, missing columns NULL."""
    found = [spark.read.parquet(p) for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(paths)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def discover_parts(spark: SparkSession, path: str) -> list[str]:
    """``path`` and its numbered parts (path_part_0001, ...), those that exist, in order."""
    fs, _ = _fs(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_part_[0-9]*"))
    parts = sorted(str(s.getPath().toString()) for s in found or [])
    return ([path] if exists(spark, path) else []) + parts


def read_asset(spark: SparkSession, path: str) -> DataFrame:
    """All parts of an asset together; an asset without any is an error."""
    return read_parts(spark, *(discover_parts(spark, path) or [path]))


def batches(df: DataFrame, size: int = 5000) -> Iterator[list[Row]]:
    """Rows in lists of ``size``, one partition on the driver at a time."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
