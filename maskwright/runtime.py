"""Session helpers: settings that suit the engine and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("maskwright")
    settings = SESSION_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir``; a local one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="maskwright-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def once(function: Callable) -> Callable:
    """A Python function that Spark evaluates once a row.

    The optimiser copies a deterministic function into every filter over its result and pushes that filter down, below joins and
    distincts even; it leaves alone what it holds for random. The functions of this package are deterministic all the same.
    """
    return function.asNondeterministic()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is so small that reading it would not give each of them a part; larger inputs are not shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    return df.repartition(cores) if size < cores * least else df


_written: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a table written to the shared checkpoint folder, so that a lost executor costs no recomputation.

    The table is columnar. It is removed by ``discard``, at the end of a ``scratch`` block, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(df: DataFrame) -> None:
    """Remove the table that ``cut`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path in _written:
        files, where = _folder(_written.pop(path), path)
        files.delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables cut inside the block are removed at its end: build a query and write its result in it."""
    before = set(_written)
    try:
        yield
    finally:
        _clean([p for p in _written if p not in before])


def _clean(paths: list[str] | None = None) -> None:
    for path in list(_written) if paths is None else paths:
        try:
            files, where = _folder(_written.pop(path), path)
            files.delete(where, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


#: Bytes on disk up to which a table written by ``cut`` is broadcast.
BROADCAST_BYTES = 2 << 20


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table written by ``cut``, to be broadcast if its files are small enough for that, else to be joined by shuffle."""
    files, where = _folder(df.sparkSession, df._written_path)
    return F.broadcast(df) if files.getContentSummary(where).getLength() <= most else df.hint("merge")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, where neither their path nor their working folder has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    folder = tempfile.mkdtemp(prefix="maskwright-")  # the driver serves the file until it ends
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "maskwright"), "zip", root, "maskwright"))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(table_path(sf_dir, name))
