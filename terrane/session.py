"""Session helpers: tables, the shared folder, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes beyond which a side is joined by shuffling instead of being broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

_own_folder: str | None = None
#: Tables made by :func:`written` that haven't been deleted yet.
_tables: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where the session names none.

    A folder of our own lies on this machine, so it is refused unless executors run in this process (tests).
    """
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="terrane-")
    return _own_folder


def written(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage and survives lost executors.

    ``by`` names columns that get a folder per value.
    Tables stay until :func:`discard`, the end of :func:`scratch` or of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terrane/{label}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.unregister(_release_all)
        atexit.register(_release_all)
    _tables.append((spark, path))
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0) -> None:
    """Delete the tables written after the first ``since`` of those that are left."""
    while len(_tables) > since:
        _delete(*_tables.pop())


def _release_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release()


@contextlib.contextmanager
def scratch():
    """Deletes what is written inside the block at its end; results must have been consumed by then."""
    since = len(_tables)
    try:
        yield
    finally:
        release(since)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for spark, path in [t for t in _tables if any(f.endswith(t[1].split("/terrane/")[1]) for f in folders)]:
        _tables.remove((spark, path))
        _delete(spark, path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` if its counted rows are within the bounds; otherwise leave the join to shuffle.

    ``df`` should be cheap to count (a written table or an aggregate). ``rows`` is the count where the caller knows it.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else df


def without_name_clash(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with those an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="terrane-"), "terrane_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("terrane", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer parts than the session has cores (few or small files)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
