"""Token ids as ORC: stripes of run-length encoded integers, row indexes, Bloom filters on ids.

Documents are range-partitioned by id, sorted, encoded and written by Spark's ORC writer:
token lists are integer run-length encoded, every stripe carries min/max statistics per row
group of ``doc_id`` and a Bloom filter. Reading splits by stripe; a range of ids prunes stripes and
row groups by statistics, single ids by the filter (``between``, ``lookup``). ``digest`` reads
the files back and gives each document its place in the whole sequence of ids.

Defined cases: a null or empty text is the end token alone. Equal ids lie side by side,
ordered by size and content; null ids come first. Other columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.llm.tokens import default_vocabulary, encoded
from quercus.llm.words import column
from quercus.workspace import Workspace

END = 2
ORC_OPTIONS = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def _encoder(vocabulary: str, end: int):
    def run(batches):
        for table, ids, offsets in encoded(batches, vocabulary, end):
            # vocabularies fit in 31 bits, so the signed array holds the same ids
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.record_batch([column(table, "doc_id"), lists], names=["doc_id", "token_ids"])

    return run


def write(documents: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Write (doc_id, token_ids) in ascending doc_id order, each document closed by ``end``."""
    kind = dict(documents.dtypes)["doc_id"]
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(_encoder(vocabulary or default_vocabulary(), end), f"doc_id {kind}, token_ids array<int>")
    rows.write.options(**ORC_OPTIONS).orc(path)


def between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents of an id range; stripes and row groups outside it are not read."""
    return spark.read.orc(path).where(F.col("doc_id").between(first, last))


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Documents of single ids; Bloom filters skip row groups without them."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids))


def _measure(batches):
    for batch in batches:
        lists = batch.column("token_ids")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().astype("<u4").tobytes()
        crc = [zlib.crc32(flat[a * 4 : b * 4]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("file"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "file", "n_tokens", "ids_crc32"],
        )


def digest(spark: SparkSession, path: str, ws: Workspace) -> DataFrame:
    """Per document from the files: the ids before it, its ids and their checksum."""
    stored = spark.read.orc(path)
    kind = dict(stored.dtypes)["doc_id"]
    sized = ws.table(
        stored.select("doc_id", "token_ids", F.col("_metadata.file_name").alias("file")).mapInArrow(
            _measure, f"doc_id {kind}, file string, n_tokens long, ids_crc32 long"
        ),
        "sizes",
    )
    # one row per file; a file holds a range of ids, so files line up by their smallest
    files = sized.groupBy("file").agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32")
    placed = sized.withColumn(
        "inside", F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return placed.join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
