"""Session settings and lineage cuts shared by the library."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terravane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on a local master may do without that setting; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="terravane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _written(spark: SparkSession) -> list:
    return spark.__dict__.setdefault("_terravane_written", [])


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(spark).append((None, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by its keys, so that joins on them move no rows of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(buckets, *by).option("path", path).format("parquet").saveAsTable(table)
    _written(spark).append((table, path, threading.get_ident()))
    return spark.table(table)


def _delete(spark: SparkSession, table: str | None, path: str) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete every table that this session has written by ``materialize`` and ``bucketed``, and say how many.

    For callers who have used or stored their results; frames that still read those tables fail afterwards.
    """
    written = _written(spark)
    for table, path, _ in written:
        _delete(spark, table, path)
    n = len(written)
    written.clear()
    return n


@contextmanager
def scratch(spark: SparkSession):
    """Delete on leaving what this thread has written inside but for the tables that were appended to the list given."""
    keep: list[DataFrame] = []
    before = {path for _, path, _ in _written(spark)}
    yield keep
    held = [f for df in keep for f in df.inputFiles()]
    for x in list(_written(spark)):
        name = x[1].rsplit("/", 1)[-1]
        if x[1] not in before and x[2] == threading.get_ident() and not any(f"/{name}/" in f for f in held):
            _delete(spark, *x[:2])
            _written(spark).remove(x)


def ship(spark: SparkSession) -> None:
    """Make the session ready for Arrow functions: workers get this package, as they may start without it on their path.

    Batches of the default 10,000 rows of text would take much memory; they are cut to 1,000 unless the caller has set a
    number. The setting is read when a job starts, so it cannot be given to one operator alone.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(batch):
        spark.conf.set(batch, "1000")
    context = spark.sparkContext
    if getattr(context, "_terravane_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="terravane-")) / "terravane.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    context._terravane_shipped = True


def lean(run):
    """``run``, a function of Arrow batches, that gives the memory it has freed back to the system when it ends.

    Workers are used again, also while idle stages of other operators run beside them, and would hold their peak.
    """

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return wrapped
