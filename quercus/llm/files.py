"""Binary files in the shared folder: written whole by tasks, read back by byte ranges.

Spark's writers keep to tables, so tasks write through pyarrow's filesystems (local paths,
hdfs, s3, gs). A file's name holds the task attempt that wrote it, and a file counts only
when the rows which that attempt returned name it: a second attempt leaves a stray file, never
a wrong result.
"""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quercus.workspace import Workspace


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's default filesystem has it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(conf).makeQualified(found).toString()


def opened(url: str):
    """(filesystem, path) of a qualified path."""
    scheme, _, rest = url.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


class TaskFile:
    """One output file of this task attempt; whoever uses it names it in its rows."""

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"
        self.url = f"{folder}/{name}"
        fs, path = opened(self.url)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream, self.size = fs.open_output_stream(path, compression=None), 0

    def write(self, data) -> int:
        """Append; returns where the data begin."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self):
        self.stream.close()


def byte_ranges(files: DataFrame, block: int, ws: Workspace, unit: int = 1) -> DataFrame:
    """(file, start, bytes): the distinct files of column ``file`` cut in blocks of whole units, one per task."""
    step = max(1, block // unit) * unit

    def cut(batches):
        for batch in batches:
            for url in batch.column("file").to_pylist():
                fs, path = opened(url)
                size = fs.get_file_info(path).size // unit * unit
                starts = np.arange(0, size, step)
                yield pa.record_batch(
                    [
                        pa.array([url] * len(starts), pa.string()), pa.array(starts, pa.int64()),
                        pa.array(np.minimum(step, size - starts), pa.int64()),
                    ],
                    names=["file", "start", "bytes"],
                )

    ranges = ws.table(files.select("file").distinct().mapInArrow(cut, "file string, start long, bytes long"), "ranges")
    return ranges.repartition(max(1, ranges.count()))
