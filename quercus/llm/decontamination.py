"""Benchmark decontamination with an FM-index per training shard.

``build_index`` turns every task's documents into shards: FM-indexes over word symbols,
written to a table. ``hit_spans`` backward-searches every window of the benchmark through
the wavelet matrices of each shard, locates occurrences by sampled suffix positions and
merges them to spans of words per document. The benchmark is searched in blocks of bounded
size, so neither side has to fit anywhere whole: what is broadcast is one block.

Words are lower-cased runs of 0-9, a-z and non-ASCII characters. A window is ``width``
consecutive words of an item; an item with fewer words, but not none, is one window.

Defined cases: a null or empty text has no words (a document: n_words 0, clean; an item: no
window). Rows that repeat (doc_id, text) get the same result each; a null doc_id is kept as
a key of its own. Items with a null id still hit words but are listed nowhere. Ties do not
arise: the result is a set of positions. Other columns are ignored or carried along.
"""

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.llm.fm_index import FMIndex
from quercus.llm.words import chunks, column, covered, split
from quercus.workspace import Workspace

#: Words of an item that make a window.
WIDTH = 10
#: Bytes of benchmark text in a block that is broadcast.
BLOCK_BYTES = 8 << 20
#: Text bytes in a shard: 2^21 words need about twice as many.
SHARD_BYTES = 8 << 20

INDEX = "index binary, doc_id array<long>, text_key array<long>, n_words array<int>"
HITS = "doc_id long, text_key long, item_id string, start int, stop int"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def text_key() -> Column:
    return F.xxhash64("text")


def _shard(table: pa.Table):
    """One shard as a row of the index table."""
    words = split(column(table, "text"), fold=True)
    sizes = np.diff(words.offsets)
    # a separator in front of every document, and one at the end
    starts = words.offsets[:-1] + np.arange(1, len(sizes) + 1)
    symbols = np.zeros(len(words.codes) + len(sizes) + 1, np.int64)
    symbols[np.arange(len(words.codes)) + 1 + words.owners()] = words.codes + 1
    index = FMIndex(symbols, len(words.vocab) + 1).compact()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.large_string())])) as out:
        out.write_batch(pa.record_batch([words.vocab.cast(pa.large_string())], names=["word"]))
    blob = pickle.dumps((index.state(), starts.astype(np.int64), sink.getvalue().to_pybytes()), 5)
    return zstandard.compress(blob, 1), sizes


def _index_shards(batches):
    for table in chunks(batches, most=SHARD_BYTES):
        blob, sizes = _shard(table)
        yield pa.record_batch(
            [
                pa.array([blob], pa.binary()),
                pa.array([column(table, "doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([column(table, "text_key").to_pylist()], pa.list_(pa.int64())),
                pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
            ],
            names=["index", "doc_id", "text_key", "n_words"],
        )


def build_index(documents: DataFrame, ws: Workspace) -> DataFrame:
    """One row per shard: its index, and the ids, text keys and word counts of its documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return ws.table(rows.mapInArrow(_index_shards, INDEX), "fm-index")


def windows(texts: pa.Array, width: int):
    """Distinct windows of a block as (item number, word codes right-aligned, length), and the vocabulary."""
    words = split(texts, fold=True)
    sizes = np.diff(words.offsets)
    many = np.where(sizes == 0, 0, np.maximum(sizes - width, 0) + 1)
    item = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(sizes, width)[item]
    at = words.offsets[item] + nth
    lanes = np.arange(width)[None, :] - (width - length)[:, None]
    if not len(item):
        return item, np.zeros((0, width), np.int64), length, words.vocab
    patterns = np.where(lanes >= 0, words.codes[np.maximum(at[:, None] + lanes, 0)] + 1, 0)
    return item, patterns.astype(np.int64), length, words.vocab


def _searcher(block, width: int):
    ids, texts = block

    def search(batches):
        texts_ = pa.array(texts, pa.large_string())
        item, patterns, length, vocab = windows(texts_, width)
        for batch in batches:
            for row in range(batch.num_rows):
                blob = zstandard.decompress(batch.column("index")[row].as_py())
                state, starts, dictionary = pickle.loads(blob)
                index = FMIndex.of(state)
                own = pa.ipc.open_stream(dictionary).read_all().column("word").combine_chunks()
                found = pc.index_in(vocab.cast(pa.large_string()), own).fill_null(-1).to_numpy(zero_copy_only=False)
                known = np.concatenate(([0], found + 1)).astype(np.int64)  # a word that the shard lacks is 0
                low, high = index.search(known[patterns], length)
                many = np.maximum(high - low, 0)
                which = np.repeat(np.arange(len(many)), many)
                rows = np.repeat(low, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                place = index.locate(rows)
                doc = np.searchsorted(starts, place, "right") - 1
                begin = place - starts[doc]
                yield from _spans(batch, row, ids, doc, item[which], begin, begin + length[which])

    return search


def _spans(batch, row, ids, doc, item, begin, end):
    """Overlapping and adjacent occurrences of an item in a document become one span."""
    order = np.lexsort((begin, item, doc))
    doc, item, begin, end = doc[order], item[order], begin[order], end[order]
    if not len(doc):
        return
    new = np.ones(len(doc), bool)
    # windows of one item all have one length, so sorted starts mean sorted ends
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    take = pa.array(doc[first])
    yield pa.record_batch(
        [
            batch.column("doc_id")[row].values.take(take),
            batch.column("text_key")[row].values.take(take),
            pa.array([ids[i] for i in item[first]], pa.string()),
            pa.array(begin[first].astype(np.int32)),
            pa.array(end[last].astype(np.int32)),
        ],
        names=["doc_id", "text_key", "item_id", "start", "stop"],
    )


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The benchmark as (ids, texts) of about ``most`` bytes each, by a hash of the row."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        got = rows.where(part == k).distinct().toArrow()
        yield got.column("item_id").to_pylist(), got.column("text").to_pylist()


def hit_spans(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, item_id, start, stop): words [start, stop) of the document lie in windows of the item."""
    out = None
    for block in blocks(benchmark, block_bytes):
        part = index.select("index", "doc_id", "text_key").mapInArrow(_searcher(block, width), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def _merged(starts, stops):
    return covered(max(stops), np.array(starts), np.array(stops))


def removal_spans(index: DataFrame, benchmark: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """Per contaminated document its hit words as disjoint spans, their number, and the items that occur."""
    spans = hit_spans(index, benchmark, width)
    # (doc, start) ties between items carry the same words once; the last one that reaches furthest stays
    grouped = (
        spans.groupBy("doc_id", "text_key", "start")
        .agg(F.max("stop").alias("stop"), F.collect_set("item_id").alias("items"))
        .groupBy("doc_id", "text_key")
        .agg(
            F.collect_list(F.struct("start", "stop")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    )

    def merge(batches):
        for batch in batches:
            spans_, hits = [], []
            for row in batch.column("spans").to_pylist():
                mask = _merged([s["start"] for s in row], [s["stop"] for s in row])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                spans_.append(edge.astype(np.int32))
                hits.append(int(mask.sum()))
            items = [sorted(i for i in row if i is not None) for row in batch.column("items").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(spans_, pa.list_(pa.int32())),
                    pa.array(hits, pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
                ],
                names=["doc_id", "text_key", "edges", "n_hit", "n_items", "items_sha256"],
            )

    return grouped.mapInArrow(
        merge, "doc_id long, text_key long, edges array<int>, n_hit long, n_items long, items_sha256 string"
    )


def contamination(documents: DataFrame, benchmark: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """One row per document: words, hit words, and the items that occur in it."""
    index = build_index(documents, ws)
    docs = index.select(F.explode(F.arrays_zip("doc_id", "text_key", "n_words")).alias("d")).select("d.*")
    hits = removal_spans(index, benchmark, ws, width).withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    empty = hashlib.sha256(b"").hexdigest()
    return docs.join(
        hits, docs.doc_id.eqNullSafe(hits.hit_id) & (docs.text_key == hits.hit_key), "left"
    ).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(empty)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def cut(text: str, edges, word=WORD) -> str:
    """Text without the words of [edges[0], edges[1]), [edges[2], edges[3]), ... and what follows them up to the next word."""
    data = text.encode()
    at = [m.start() for m in word.finditer(data)]
    at.append(len(data))
    out, place = [], 0
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        out.append(data[place : at[begin]])
        place = at[end]
    out.append(data[place:])
    return b"".join(out).decode()


def _cut_batches(batches):
    for batch in batches:
        texts, edges = batch.column("text"), batch.column("_quercus_edges")
        out = texts.to_pylist()
        for i in np.flatnonzero(edges.is_valid().to_numpy(zero_copy_only=False)):
            out[i] = cut(out[i], edges[i].as_py())
        names = [n for n in batch.schema.names if n != "_quercus_edges"]
        yield pa.record_batch([pa.array(out, texts.type) if n == "text" else batch.column(n) for n in names], names=names)


def decontaminated(documents: DataFrame, benchmark: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """``documents`` with the hit words cut out of their texts; a document of which no word is left goes."""
    index = build_index(documents, ws)
    hits = removal_spans(index, benchmark, ws, width).select(
        F.col("doc_id").alias("_quercus_id"), F.col("text_key").alias("_quercus_key"), F.col("edges").alias("_quercus_edges"), "n_hit"
    )
    sizes = index.select(F.explode(F.arrays_zip("doc_id", "text_key", "n_words")).alias("d")).select("d.*")
    hits = (
        hits.join(sizes.distinct(), F.col("_quercus_id").eqNullSafe(F.col("doc_id")) & (F.col("_quercus_key") == F.col("text_key")))
        .select("_quercus_id", "_quercus_key", "_quercus_edges", (F.col("n_hit") >= F.col("n_words")).alias("_quercus_gone"))
    )
    keyed = documents.withColumn("_quercus_row_key", text_key())
    joined = keyed.join(
        hits, keyed.doc_id.eqNullSafe(hits._quercus_id) & (keyed._quercus_row_key == hits._quercus_key), "left"
    ).where(F.coalesce(~F.col("_quercus_gone"), F.lit(True)))
    kept = joined.select(*documents.columns, "_quercus_edges").mapInArrow(_cut_batches, documents.schema)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else kept
