"""Token counts by separator scan over flat token files that carry no index.

A file is ids of 16 or 32 bits, documents closed by a separator id. Tasks read blocks of
bytes, wherever they begin, and find the separators in one vectorised comparison. What a block
cannot know, the tokens of the document that reaches into it and the number of documents
before it, comes from a prefix scan over one row per block.

Defined cases: an empty text is a document of no tokens (its separator follows at once);
null texts are empty. Tokens behind the last separator of a file are no document.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.llm.files import TaskFile, byte_ranges, opened, qualified
from quercus.llm.tokens import default_vocabulary, encoded
from quercus.llm.words import column
from quercus.workspace import Workspace

#: Id of <|endoftext|> in word_bpe_49k.json; its text in a document is encoded as plain text.
SEPARATOR = 49407
BLOCK_BYTES = 8 << 20


def _writer(folder: str, vocabulary: str, separator: int, width: int):
    def run(batches):
        file, ordinal = None, 0
        for table, ids, _ in encoded(batches, vocabulary, separator, plain_specials=True):
            file = file or TaskFile(folder, ".tok")
            file.write(ids.astype(f"<u{width}").tobytes())
            n = table.num_rows
            yield pa.record_batch(
                [column(table, "doc_id"), pa.array([file.url] * n), pa.array(np.arange(ordinal, ordinal + n))],
                names=["doc_id", "file", "ordinal"],
            )
            ordinal += n
        if file:
            file.close()

    return run


def write(documents: DataFrame, ws: Workspace, vocabulary: str | None = None, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Write flat files of ``width`` bytes an id. Returns which document is which of its file, for whoever asks
    later; the scan does not look at it."""
    kind = dict(documents.dtypes)["doc_id"]
    folder = qualified(ws.spark, ws.path("tokens"))
    return ws.table(
        documents.select("doc_id", "text").mapInArrow(
            _writer(folder, vocabulary or default_vocabulary(), separator, width), f"doc_id {kind}, file string, ordinal long"
        ),
        "written",
    )


def _scanner(separator: int, width: int):
    def run(batches):
        for batch in batches:
            for url, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "bytes")), strict=True):
                fs, path = opened(url)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(size, start), f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.record_batch(
                    [
                        pa.array([url]), pa.array([start // width]), pa.array([len(ends)], pa.int64()), pa.array([tail], pa.int64()),
                        pa.array([np.diff(ends, prepend=-1) - 1], pa.list_(pa.int64())),
                    ],
                    names=["file", "at", "ends", "tail", "lengths"],
                )

    return run


def counts(spark: SparkSession, files: DataFrame, ws: Workspace, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in ``files`` (column file), separators not counted."""
    scanned = ws.table(
        byte_ranges(files, block, ws, width).mapInArrow(_scanner(separator, width), "file string, at long, ends long, tail long, lengths array<long>"), "scanned"
    )
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "at", "ends", "tail")
    # a block's run begins behind the last earlier block that holds a separator
    summary = summary.withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn(
        "run", F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before), F.lit(0))
    )
    carried = summary.withColumn("key", F.col("run") + F.when(F.col("ends") > 0, 1).otherwise(0))
    # open tokens by the run that they flow into: a block with separators leaves its tail to the next run
    flow = carried.groupBy("file", "key").agg(F.sum("tail").alias("open"))
    first = carried.where("ends > 0").join(
        flow.select("file", F.col("key").alias("run"), "open"), ["file", "run"], "left"
    )
    stitched = first.select("file", "at", "base", F.coalesce("open", F.lit(0)).alias("carry"))
    docs = (
        scanned.where("ends > 0")
        .select("file", "at", "lengths")
        .join(stitched, ["file", "at"])
        .select("file", "at", "base", "carry", F.posexplode("lengths").alias("i", "length"))
    )
    sized = docs.select(
        "file",
        (F.col("base") + F.col("i")).alias("ordinal"),
        (F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
    )
    reached = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum(F.col("n_tokens") + 1).over(reached), F.lit(0)))


def document_counts(documents: DataFrame, ws: Workspace, block: int = BLOCK_BYTES, vocabulary: str | None = None) -> DataFrame:
    """Token counts of ``documents``, found in their flat files."""
    written = write(documents, ws, vocabulary)
    found = counts(ws.spark, written, ws, block=block)
    return written.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
