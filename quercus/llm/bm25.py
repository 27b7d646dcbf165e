"""Exact top-k BM25 search: an inverted index per shard with block-max pruning, merged by global statistics.

``build_index`` turns every task's documents into shards: postings by term and document, written
to a table with the counts that add up to the global statistics. ``search`` takes its queries in
blocks of bounded size; per block the document frequencies of its terms are summed over
all shards, so every shard scores with the same numbers and its best k can be merged as they are.

In a shard, a query's rare terms are its essential lists and are scored outright. Its common terms
(in more than one document of ``COMMON``) are skipped dynamically: blocks of ``BLOCK`` documents hold the
largest weight of each, and only blocks of which a document's rare score plus the bound can reach
the k-th best score so far are scored on them, as a matrix product over the queries they are alive for. The threshold carries over between a task's shards.
No document that belongs in the result is passed over.

Words are lower-cased runs of 0-9, a-z and non-ASCII. A query term counts as often as the query
holds it. Ties rank by doc_id (scores are compared to nine decimals). Defined cases: a query
without words, or none of whose words occurs, has no rows; a null or empty document is never
found; rows that repeat are found each; rows without an id are searched but ask nothing. Two texts
under one id are two queries: each has its own ranks and its own k rows, under the id they share.
"""

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.decontamination import text_key
from quercus.llm.words import chunks, column, ranges, split
from quercus.workspace import Workspace

K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES = 16 << 20
QUERY_BYTES = 8 << 20
BLOCK = 64
COMMON = 24
DIGITS = 9
#: Queries scored together, and the relative error allowed to single precision.
GROUP = 256
SLACK = 1e-4
NO_ID = -(1 << 63)

INDEX = "index binary, docs long, words long"
FOUND = "query_id long, text_key long, doc_id long, score double"


def _ipc(array: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", array.type)])) as out:
        out.write_batch(pa.record_batch([array], names=["x"]))
    return sink.getvalue().to_pybytes()


def _of_ipc(data: bytes) -> pa.Array:
    return pa.concat_arrays(pa.ipc.open_stream(data).read_all().column("x").chunks)


def postings(texts: pa.Array):
    """(vocab, first posting of each term, document of each posting, its count, words of each document)."""
    words = split(texts, fold=True)
    n = max(1, len(texts))
    key, count = np.unique(words.codes.astype(np.int64) * n + words.owners(), return_counts=True)
    first = np.searchsorted(key, np.arange(len(words.vocab) + 1) * n)
    return words.vocab, first, (key % n).astype(np.int32), count.astype(np.int32), np.diff(words.offsets).astype(np.int32)


def _index_shards(batches):
    for table in chunks(batches, most=SHARD_BYTES):
        vocab, first, doc, count, sizes = postings(column(table, "text"))
        state = (_ipc(vocab.cast(pa.large_string())), first, doc, count, sizes, column(table, "doc_id").to_pylist())
        yield pa.record_batch(
            [
                pa.array([zstandard.compress(pickle.dumps(state, 5), 1)], pa.binary()),
                pa.array([table.num_rows], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
            ],
            names=["index", "docs", "words"],
        )


def build_index(documents: DataFrame, ws: Workspace) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ws.table(rows.mapInArrow(_index_shards, INDEX), "inverted")


def _shards(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield pickle.loads(zstandard.decompress(batch.column("index")[row].as_py()))


def _counter(vocab: list[str]):
    """Documents of the shards that hold each of the block's terms."""

    def run(batches):
        total, terms = np.zeros(len(vocab), np.int64), pa.array(vocab, pa.large_string())
        for own, first, *_ in _shards(batches):
            place = pc.index_in(terms, _of_ipc(own)).fill_null(-1).to_numpy(zero_copy_only=False)
            total += np.where(place >= 0, np.diff(first)[place], 0) if len(first) > 1 else 0
        has = np.flatnonzero(total)
        yield pa.record_batch([pa.array(has), pa.array(total[has])], names=["term", "df"])

    return run


class Best:
    """The k best (score, doc_id) of one query."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def bar(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else 0.0

    def add(self, scores, ids):
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -np.round(scores, DIGITS)))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Shard:
    """A shard made ready for a block of queries."""

    def __init__(self, state, vocab: pa.Array, average: float):
        own, self.first, self.doc, self.count, sizes, ids = state
        self.n = len(sizes)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.norm = K1 * (1 - B + B * sizes / max(average, 1e-9))
        self.place = pc.index_in(vocab, _of_ipc(own)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        df = np.append(np.diff(self.first), 0)[self.place]
        df[self.place < 0] = 0
        self.common = np.flatnonzero(df * COMMON > self.n)  # terms of the block, and their columns
        self.column = np.full(len(self.place), -1, np.int64)
        self.column[self.common] = np.arange(len(self.common))
        self.rare = np.flatnonzero((df > 0) & (self.column < 0))
        self.sparse = np.zeros(len(self.place), bool)
        self.sparse[self.rare] = True
        self.dense = np.zeros((self.n, len(self.common)))
        for c, term in enumerate(self.common):
            doc, weight = self._list(np.array([term]))
            self.dense[doc, c] = weight
        self.blocks = -(-self.n // BLOCK)
        padded = np.zeros((self.blocks * BLOCK, len(self.common)))
        padded[: self.n] = self.dense
        self.bounds = padded.reshape(self.blocks, BLOCK, len(self.common)).max(1)
        self.single = self.dense.astype(np.float32)

    def _list(self, terms):
        """Documents and BM25 weights (without idf) of the terms' lists, one behind the other."""
        start = self.first[self.place[terms]]
        at = ranges(start, self.first[self.place[terms] + 1] - start)
        doc, count = self.doc[at], self.count[at]
        return doc, count * (K1 + 1) / (count + self.norm[doc])

    def search(self, asked, idf, found: list[Best]):
        """Let the shard's documents compete for a group of queries."""
        partial, pull = np.zeros((len(asked), self.blocks * BLOCK)), np.zeros((len(self.common), len(asked)))
        for q, (_, terms, counts) in enumerate(asked):
            weights = idf[terms] * counts
            few = self.sparse[terms]
            if few.any():
                doc, weight = self._list(terms[few])
                place = self.place[terms[few]]
                weight *= np.repeat(weights[few], self.first[place + 1] - self.first[place])
                partial[q] = np.bincount(doc, weight, self.blocks * BLOCK)
            column = self.column[terms]
            pull[column[column >= 0], q] = weights[column >= 0]
        bar = np.array([best.bar for best in found])
        # a block is alive for a query if its best document could enter
        reach = partial.reshape(len(asked), self.blocks, BLOCK).max(2) + (self.bounds @ pull).T
        alive = (reach > 0) & (reach * (1 + SLACK) >= bar[:, None])
        rough, narrow = np.full(partial.shape, -np.inf, np.float32), pull.astype(np.float32)
        for b in range(self.blocks):
            q = np.flatnonzero(alive[:, b])
            rows = slice(b * BLOCK, min((b + 1) * BLOCK, self.n))
            if len(q):
                rough[q, rows] = partial[q, rows] + (self.single[rows] @ narrow[:, q]).T
        for q, best in enumerate(found):
            if not alive[q].any():
                continue
            # what single precision cannot tell from the k-th best is scored again in double
            score = rough[q, : self.n]
            cut = np.partition(score, self.n - best.k)[self.n - best.k] if self.n > best.k else -np.inf
            docs = np.flatnonzero((score > 0) & (score * (1 + SLACK) >= max(cut, best.bar)))
            if len(docs):
                best.add(partial[q, docs] + self.dense[docs] @ pull[:, q], self.ids[docs])


def _searcher(queries, vocab: list[str], idf: np.ndarray, average: float, k: int):
    def run(batches):
        terms_, found = pa.array(vocab, pa.large_string()), [Best(k) for _ in queries]
        for state in _shards(batches):
            if len(state[1]) < 2:
                continue
            shard = Shard(state, terms_, average)
            for at in range(0, len(queries), GROUP):
                shard.search(queries[at : at + GROUP], idf, found[at : at + GROUP])
        for ((query, key), _, _), best in zip(queries, found, strict=True):
            if len(best.ids):
                n = len(best.ids)
                yield pa.record_batch(
                    [pa.array([query] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(best.ids), pa.array(best.scores)],
                    names=["query_id", "text_key", "doc_id", "score"],
                )

    return run


def _query_blocks(queries: DataFrame, most: int):
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    for b in range(n):
        yield queries.where(part == b).toArrow()


def search(index: DataFrame, queries: DataFrame, ws: Workspace, k: int = TOP, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (columns doc_id, text)."""
    spark = index.sparkSession
    total = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n, average = total["docs"] or 0, (total["words"] or 0) / max(1, total["docs"] or 0)
    rows = queries.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    rows = rows.where("text IS NOT NULL AND doc_id IS NOT NULL").distinct()
    # a task takes several shards, so that its threshold carries over and few lists are merged
    shards = index.select("index").coalesce(max(1, spark.sparkContext.defaultParallelism))
    out = None
    for block in _query_blocks(rows, block_bytes):
        if not block.num_rows:
            continue
        words = split(column(block.combine_chunks(), "text"), fold=True)
        vocab = words.vocab.to_pylist()
        counted = shards.mapInArrow(_counter(vocab), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(vocab))
        for r in counted.collect():  # the block's terms
            df[r["term"]] = r["df"]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        asked = []
        for i, query in enumerate(zip(block.column("doc_id").to_pylist(), block.column("text_key").to_pylist(), strict=True)):
            terms, counts = np.unique(words.codes[words.offsets[i] : words.offsets[i + 1]], return_counts=True)
            asked.append((query, terms.astype(np.int64), counts.astype(np.float64)))
        part = shards.mapInArrow(_searcher(asked, vocab, idf, average, k), FOUND)
        part = ws.table(part, "best")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id", "text_key").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.round("score", DIGITS).alias("score"))
