"""Documents dealt to shards of near equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Groups (rows of one text) are added up first. Every group larger than the grain, a fixed share of a
shard, is an item of its own, and there are at most ``GRAINS`` of them for each shard; smaller
groups are bundled by their hash into as many items again. These items, whose number does
not follow the input, are differenced: every item starts as a partial partition (its size in one
subset, nothing in the others), and the two partial partitions with the largest spread are
combined over and over, one in descending and one in ascending order of its sums, until one is left. A
second walk from the last combination back to the items gives each its shard.

``write`` lays the rows out as Parquet, a folder per shard, in order of ids and in files that follow from
the size of the data; ``digest`` reads them back. A row's slot is its place in its file plus the
rows of the shard's earlier files, so no task ranks a whole shard.

Defined cases: a null text is empty, and equal to the empty text; rows that repeat, and a group that
is larger than a shard should be, stay whole, so such a group's shard is the largest; sizes that tie go by
their keys; null ids come first in their shard; an empty table gives no rows. A row is written with all its columns inside
the struct ``document``, so no name clashes. Texts are told apart by MD5, and very long ones are never cut.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.workspace import Workspace

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: A group above a shard's mean divided by this is an item by itself; the rest share as many bundles.
GRAINS = 1000

ITEM = "key binary, bundle long, shard int"


def difference(sizes: list[int], shards: int) -> np.ndarray:
    """The shard of every item, by k-way differencing."""
    n = len(sizes)
    out = np.zeros(n, np.int32)
    if n < 2 or shards == 1:
        return out
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)

    def taken(node):
        if node >= n:
            return sums.pop(node)
        alone = np.zeros(shards, np.int64)
        alone[0] = sizes[node]
        return alone

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = taken(a) + taken(b)[::-1]
        order = np.argsort(-both, kind="stable")
        node = n + len(merges)
        sums[node] = both[order]
        merges.append((a, b, order.astype(np.int16)))
        heapq.heappush(heap, (-int(both[order[0]] - both[order[-1]]), node))
    of: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(shards, dtype=np.int16)}
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        place, mine = np.empty(shards, np.int16), of.pop(node)
        place[order] = mine
        for child, subset in ((a, place), (b, place[::-1])):
            if child < n:
                out[child] = subset[0]
            else:
                of[child] = subset
    return out


def _dealer(shards: int):
    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("bytes", "descending"), ("key", "ascending"), ("bundle", "ascending")])
        shard = difference(table.column("bytes").to_pylist(), shards)
        for batch in table.select(["key", "bundle"]).append_column("shard", pa.array(shard, pa.int32())).to_batches():
            yield batch

    return run


def _size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def assignment(documents: DataFrame, shards: int, ws: Workspace, grains: int = GRAINS) -> tuple[DataFrame, int]:
    """(key or bundle, shard) of every item, at most 2 * shards * grains rows, and the number of bundles."""
    groups = ws.table(documents.groupBy(_key(F.col("text")).alias("key")).agg(F.sum(_size(F.col("text"))).alias("bytes")), "groups")
    bundles = shards * grains
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * bundles > total
    alone = groups.where(large).select("key", F.lit(None).cast("long").alias("bundle"), "bytes")
    small = groups.where(~large).groupBy(_bundle("key", bundles).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    items = alone.unionByName(small.select(F.lit(None).cast("binary").alias("key"), "bundle", "bytes"))
    # one task: the number of items is bounded by shards and grains, whatever the input
    return ws.table(items.repartition(1).mapInArrow(_dealer(shards), ITEM), "assignment"), bundles


def _bundle(key, bundles: int):
    return F.pmod(F.xxhash64(key), F.lit(bundles))


def write(documents: DataFrame, path: str, ws: Workspace, shards: int = SHARDS, grains: int = GRAINS) -> None:
    """Write every row, as the struct ``document``, to its shard's folder, in order of doc_id."""
    found, bundles = assignment(documents, shards, ws, grains)
    alone = found.where("key is not null").select("key", F.col("shard").alias("own"))
    shared = found.where("bundle is not null").select("bundle", F.col("shard").alias("common"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")).select(
        "document", _key(F.col("document.text")).alias("key"), F.monotonically_increasing_id().alias("position")
    )
    # both sides of the assignment are bounded, see above
    dealt = (
        rows.join(F.broadcast(alone), "key", "left")
        .withColumn("bundle", _bundle("key", bundles))
        .join(F.broadcast(shared), "bundle", "left")
        .select(F.coalesce("own", "common").alias("shard"), "document", F.col("document.doc_id").alias("id"), "key", "position")
    )
    order = ["shard", F.col("id").asc_nulls_first(), "key", "position"]  # the position splits rows that repeat without end
    laid = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.select("document", "shard").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, document_type, *columns) -> DataFrame:
    """(document, shard, slot): the shards' rows; slots of a shard count from 0 without gaps.

    With ``columns``, expressions over ``document``, these come back in its place, and are all that meets the files' rows.
    """
    stored = spark.read.schema(f"document {document_type}, shard int").parquet(path)
    file, row = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    rows = stored.select(F.struct(*columns).alias("kept") if columns else F.struct("document").alias("kept"), "shard", file, row)
    files = stored.select("shard", file).groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", "file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return rows.join(files, ["shard", "file"]).select("kept.*", "shard", (F.col("base") + F.col("row")).alias("slot"))


def document_type(documents: DataFrame) -> str:
    """The struct type of a row of ``documents``, as ``read`` takes it."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")).schema["document"].dataType.simpleString()


def digest(spark: SparkSession, path: str, document_type: str) -> DataFrame:
    """Per row of the shards its size, checksum, shard and slot."""
    text = F.col("document.text")
    rows = read(
        spark, path, document_type, F.col("document.doc_id").alias("doc_id"), _size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
