"""Where iterative jobs cut their lineage: parquet tables in a shared folder.

A written table survives lost executors, has exact size statistics (so the
planner's broadcast decisions rest on real bytes) and can be read back by any
later job.  The folder is the one the cluster names in ``spark.checkpoint.dir``; a run's own
sub-folder is removed when the driver ends.
"""

import atexit
import contextlib
import itertools
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows that a task of a large join or grouping holds.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` fill, which are not put together again.

    Keys that repeat are a hundred times smaller in a shuffle file than in a task, so partitions put together by their bytes
    give a task the more rows the larger the input is.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def spread(df: DataFrame, made: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` for a step that makes ``made`` rows of each, unless one task holds them all.

    A source file of few bytes is one task, however many rows it has.
    """
    rows = df.count() * made
    return df if rows <= TASK_ROWS else dealt(df, rows, *keys)


class Workspace:
    """A run's own sub-folder of the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/quercus-{uuid.uuid4().hex}"
        self._n, self._ids = 0, itertools.count(1)
        atexit.register(self._at_end)

    def _at_end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have gone first
            self.remove()

    def remove(self) -> None:
        """Delete the run's tables; frames that read them are of no use any more."""
        atexit.unregister(self._at_end)
        if self._n and self.spark.sparkContext._jsc is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def path(self, name: str) -> str:
        self._n = n = next(self._ids)  # a number of its own, whichever thread asks
        return f"{self.root}/{n:04d}-{name}"

    def write(self, df: DataFrame, name: str, partition_by=None):
        """Write ``df``; return (path, exact number of rows written)."""
        path = self.path(name)
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return path, seen.get["n"]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise ``df`` and hand back a scan of the written table."""
        path, _ = self.write(df, name)
        return self.spark.read.schema(df.schema).parquet(path)

    def sized_tables(self, **frames: DataFrame) -> dict:
        """Materialise frames that do not rest on each other, side by side: name -> (scan of the written table, rows)."""

        def one(name, frame):
            path, n = self.write(frame, name)
            return self.spark.read.schema(frame.schema).parquet(path), n

        return self.beside(**{name: partial(one, name, frame) for name, frame in frames.items()})

    @staticmethod
    def beside(**steps) -> dict:
        """Run steps (functions without arguments) that do not rest on each other side by side: name -> what it returned."""
        with ThreadPoolExecutor(max(1, len(steps))) as pool:
            started = {name: pool.submit(step) for name, step in steps.items()}
            return {name: one.result() for name, one in started.items()}
