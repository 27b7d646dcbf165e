"""Substring deduplication with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words. A word goes when a window over it also starts in
a document with a smaller id. Equal windows have to meet in one shard without every document
visiting every shard, so text is routed by content: a window's anchor is the smallest hash
of its word pairs, a run of neighbouring windows with one anchor is a *segment*, and a
segment goes to the shard of its anchor. Each window thus lies in one shard, equal windows
in the same one, and the work grows with the text.

Frequent word pairs anchor nothing, or a shard would grow with the commonest pair: a first pass
counts the different windows that begin or end with a pair or longer gram over the whole input (a chunk's copies of a
window count once, so a passage that many documents hold keeps its anchors; a task leaves out grams so rare in it that
all that is left out stays under half the bound), and a window is anchored at the smallest hash of its pairs
that are not frequent, without one at that of its longer grams that are not, else at the hash of all its
words. The table of frequent grams is the same for every task, so equal windows still meet. A pair that is not frequent
brings a shard few words for each window that it begins or ends.

In a shard an FM-index over the segments is searched backwards through its wavelet matrix by
every segment in turn. The search extends to the left; at full length it drops the
rightmost word (the parent interval, from the boundaries of 12-word prefixes) before it takes
the next, so every window costs one step. The matching statistic of a position is then the
interval of its window, and the smallest document id in it decides.

Hot passages: a task ships of equal segments in its input only the smallest id's; the others
are decided on the spot (a smaller id holds the same words), so a shard gets each passage once
per task, however many documents hold it. Three words in a row that only one document of
a shard holds cannot lie in a repeated window; segments are cut at them, and pieces shorter than a window are not
indexed: an exact pruning, no limit.

Defined cases: null and empty texts have no words. A null doc_id is neither smaller nor
larger than any: its rows stay whole and remove nothing. Rows with one doc_id are one
document as to order: a window does not remove its equal in a row with the same id. Rows that
repeat (doc_id, text) are treated alike. Segments and texts are identified by 64-bit hashes.
"""

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.decontamination import cut, text_key
from quercus.llm.fm_index import FMIndex
from quercus.llm.words import chunks, column, covered, grams, hand_back, joined, mixed, ranges, split
from quercus.workspace import Workspace

#: Words of a window.
WINDOW = 13
#: Words of an anchor, and of the longer one of windows that hold frequent pairs only.
ANCHORS = (2, 6)
#: A gram is frequent if it begins or ends more than one window for so many bytes of an average shard.
OFTEN = 256
#: A longer run of windows with one anchor is cut, so that no search is long.
RUN = 64
#: Words of a run that has to be common before a window over it is indexed, and bits of the table of runs.
PROBE = 3
#: At least; a shard of more words has as many slots as words.
SLOT_BITS = 23
#: Words used more often in a task's input are numbered first.
FREQUENT = 12
#: Text bytes per shard of the corpus.
SHARD_BYTES = 8 << 20
#: Text bytes that a task looks at together.
MAP_BYTES = 9 << 20

SPANS = "doc_id long, text_key long, start int, stop int"
NONE = np.uint64((1 << 64) - 1)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if width > span:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def _anchors(h: np.ndarray, frequent: dict, whole: np.ndarray) -> np.ndarray:
    """The anchor of every window; ``frequent`` holds the sorted hashes of frequent grams by their words."""
    anchor, open_ = whole.copy(), np.ones(len(whole), bool)
    for width in ANCHORS:
        values, often = grams(h, width), frequent[width]
        if len(often):
            values[often[np.minimum(np.searchsorted(often, values), len(often) - 1)] == values] = NONE
        low = _lowest(values, WINDOW - width + 1)
        found = open_ & (low != NONE)
        anchor[found] = low[found]
        open_ &= ~found
        if not open_.any():
            break
    return anchor


def _segments(words, frequent):
    """Runs of windows with one anchor: first word, number of windows, anchor; and window hashes."""
    h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = len(h)
    if n < WINDOW:
        return None
    whole = grams(h, WINDOW)
    low = _anchors(h, frequent, whole)
    sizes = np.diff(words.offsets)
    valid = np.zeros(n + 1, np.int64)
    many = np.maximum(sizes - WINDOW + 1, 0)
    np.add.at(valid, words.offsets[:-1], (many > 0).astype(np.int64))
    np.add.at(valid, words.offsets[:-1] + many, -(many > 0).astype(np.int64))
    valid = np.cumsum(valid[:-1])[: len(low)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    new[words.offsets[:-1][many > 0]] = True
    starts = np.flatnonzero(new)
    if not len(starts):
        return None
    ends = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    runs = -(-(ends - starts) // RUN)
    piece = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    first = np.repeat(starts, runs) + piece * RUN
    count = np.minimum(np.repeat(ends, runs) - first, RUN)
    return first, count, low[first], whole


def _pack(arrays: dict) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 3)


def _strings(array: pa.Array):
    """An Arrow string array as (lengths, bytes)."""
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.diff(offsets).astype(np.int32), data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""


def _front_coded(lengths: np.ndarray, text: bytes):
    """Every word as the number of first bytes that it shares with the word before, and the rest."""
    data, ends = np.frombuffer(text, np.uint8), np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    shared = np.zeros(len(lengths), np.int64)
    open_ = np.arange(1, len(lengths))
    for k in range(255):
        open_ = open_[(lengths[open_] > k) & (lengths[open_ - 1] > k)]
        open_ = open_[data[starts[open_] + k] == data[starts[open_ - 1] + k]]
        if not len(open_):
            break
        shared[open_] = k + 1
    return shared.astype(np.uint8), (lengths - shared).astype(np.int32), data[ranges(starts + shared, lengths - shared)].tobytes()


def _unfolded(shared, rest, text: bytes):
    """The lengths and bytes that ``_front_coded`` took."""
    shared = shared.astype(np.int64)
    lengths = shared + rest
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ranges(starts + shared, rest.astype(np.int64))] = np.frombuffer(text, np.uint8)
    # a shared byte is the one at its place in the word before; chains end at a word that spells it
    source = np.arange(len(lengths))
    for k in range(int(shared.max()) if len(shared) else 0):
        copied = shared > k
        origin = np.maximum.accumulate(np.where(copied, 0, source))
        has = np.flatnonzero(copied)
        out[starts[has] + k] = out[starts[origin[has]] + k]
    return lengths, out.tobytes()


def _in_contexts(words):
    """(width, grams): every gram once for each of the chunk's different windows that begin or end with it.

    The words of a passage that many documents hold stand in the same windows, however often; only where a copy
    meets other words do its grams count for each copy, and there they do begin or end different windows.
    """
    h, sizes = words.hashes()[words.codes], np.diff(words.offsets)
    whole = grams(h, WINDOW)
    many = np.maximum(sizes - WINDOW + 1, 0)
    start = ranges(words.offsets[:-1], many)
    if not len(start):
        return
    start = start[np.unique(whole[start], return_index=True)[1]]
    for width in ANCHORS:
        values = grams(h, width)
        yield width, np.concatenate((values[start], values[start + WINDOW - width]))


def _counter(share: float):
    """Grams that begin or end more than ``share`` different windows for a byte of a chunk's text."""

    def run(batches):
        for table in chunks(batches, most=MAP_BYTES):
            text = column(table, "text")
            words, least = split(text), share * (pc.sum(pc.binary_length(text)).as_py() or 0)
            if len(words.codes) < WINDOW:
                continue
            for width, gram in _in_contexts(words):
                gram, n = np.unique(gram, return_counts=True)
                often = n > least
                gram, n = gram[often].view(np.int64), n[often]
                yield pa.record_batch([pa.array(np.full(len(n), width, np.int32)), pa.array(gram), pa.array(n)], names=["width", "gram", "n"])
            hand_back()

    return run


def frequent_grams(rows: DataFrame, size: int, shards: int) -> dict:
    """Sorted hashes of the frequent grams by their words: all that begin or end ``size / shards / OFTEN`` windows, none under half of it."""
    least = size / shards / OFTEN / 2
    counted = rows.mapInArrow(_counter(least / max(size, 1)), "width int, gram long, n long")
    # what counts so often are at most 4 * OFTEN grams of each length for a shard's bytes
    found = counted.groupBy("width", "gram").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("width", "gram").toArrow()
    width, gram = (column(found, c).to_numpy(zero_copy_only=False) for c in ("width", "gram"))
    return {w: np.sort(gram[width == w].astype(np.int64).view(np.uint64)) for w in ANCHORS}


def _merged(decided, doc, begin, count):
    """Of decided segments, in order of their places, the first of each run that leaves no word out, and the run's words."""
    if not len(decided):
        return decided, decided
    stop = begin[decided] + count[decided] + WINDOW - 1
    head = np.ones(len(decided), bool)
    head[1:] = (doc[decided][1:] != doc[decided][:-1]) | (begin[decided][1:] > stop[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(decided)) - 1
    return decided[first], stop[last] - begin[decided[first]]


def _router(shards: int, frequent):
    def route(batches):
        for table in chunks(batches, most=MAP_BYTES):
            yield from _route(table, shards, frequent.value)
            hand_back()

    return route


def _route(table: pa.Table, shards: int, frequent: dict):
    words = split(column(table, "text"))
    found = _segments(words, frequent)
    if found is None:
        return
    first, count, anchor, whole = found
    doc = np.searchsorted(words.offsets, first, "right") - 1
    ids = column(table, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    keys = column(table, "text_key").to_numpy(zero_copy_only=False).astype(np.int64)
    # equal segments of this input: the smallest id's is shipped, the others are decided
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(whole), dtype=np.uint64)))
    print_ = joined(joined(whole[first], whole[first + count - 1]), total[first + count] - total[first])
    print_ = joined(print_, count.astype(np.uint64))
    del total, whole
    order = np.argsort(print_, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = print_[order][1:] != print_[order][:-1]
    group = np.cumsum(head) - 1
    smallest = np.minimum.reduceat(ids[doc[order]], np.flatnonzero(head))
    later = np.zeros(len(order), bool)
    later[order] = ids[doc[order]] > smallest[group]
    begin = first - words.offsets[doc]
    decided, span = _merged(np.flatnonzero(later), doc, begin, count)
    sent = np.flatnonzero(~later)
    shard = (mixed(anchor[sent]) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    sent, shard = sent[by], shard[by]
    via = (doc[decided] * 2654435761 >> 7) % shards  # decided spans ride along, evenly dealt
    ride = np.argsort(via, kind="stable")
    decided, span, via = decided[ride], span[ride], via[ride]
    present = np.union1d(shard, via)  # of very many shards a task's input meets a few
    bounds, rides = (np.append(np.searchsorted(x, present), len(x)) for x in (shard, via))
    # a shard's words: frequent ones first, in order of appearance, then the others by spelling, which compresses well
    uses = np.bincount(words.codes, minlength=len(words.vocab))
    spelled = np.zeros(len(words.vocab), np.int64)
    spelled[pc.array_sort_indices(words.vocab).to_numpy()] = np.arange(len(words.vocab))
    place = np.where(uses > FREQUENT, np.arange(len(words.vocab)), len(words.vocab) + spelled)
    remap = np.zeros(len(words.vocab), np.int64)
    names, blobs = [], []
    for k, s in enumerate(present.tolist()):
        mine, aside, words_of = sent[bounds[k] : bounds[k + 1]], decided[rides[k] : rides[k + 1]], span[rides[k] : rides[k + 1]]
        codes = words.codes[ranges(first[mine], count[mine] + WINDOW - 1)]
        if len(codes) * 8 < len(words.vocab):
            local = np.unique(codes)
        else:
            used = np.zeros(len(words.vocab), bool)
            used[codes] = True
            local = np.flatnonzero(used)
        local = local[np.argsort(place[local])]
        remap[local] = np.arange(len(local))
        codes = remap[codes].astype(np.uint32)
        docs, at = np.unique(np.concatenate((doc[mine], doc[aside])), return_inverse=True)
        lengths, text = _strings(words.vocab.take(pa.array(local)))
        names.append(s)
        blobs.append(
            _pack(
                {
                    "vocab": _front_coded(lengths, text),
                    "codes": ((codes & 255).astype(np.uint8), (codes >> 8 & 255).astype(np.uint8), (codes >> 16).astype(np.uint16)),
                    "count": count[mine].astype(np.uint8),
                    "start": begin[mine].astype(np.int32),
                    "doc": np.diff(at[: len(mine)], prepend=0).astype(np.int32),
                    "ids": ids[docs],
                    "keys": keys[docs],
                    "decided": (at[len(mine) :].astype(np.int32), begin[aside].astype(np.int32), words_of.astype(np.int32)),
                }
            )
        )
        if len(blobs) >= 64:
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "segments"])
            names, blobs = [], []
    if blobs:
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "segments"])


def _span_batch(ids, keys, start, stop):
    return pa.record_batch(
        [pa.array(ids), pa.array(keys), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
        names=["doc_id", "text_key", "start", "stop"],
    )


def _search_shards(batches):
    """A task holds one shard, or several if the planner merged small ones; equal windows share a shard."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, blob in zip(batch.column("shard").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            held.setdefault(s, []).append(blob)
    for s in sorted(held):
        yield from _search(held.pop(s))
        hand_back()


def _search(blobs):
    offsets, texts, codes, base, counts, starts, ids, keys = [np.zeros(1, np.int64)], [], [], 0, [], [], [], []
    size = 0
    for i, blob in enumerate(blobs):
        x = pickle.loads(zstandard.decompress(blob))
        blobs[i] = None
        doc, begin, many = x["decided"]
        if len(doc):
            yield _span_batch(x["ids"][doc], x["keys"][doc], begin, begin + many)
        lengths, text = _unfolded(*x["vocab"])
        offsets.append(size + np.cumsum(lengths, dtype=np.int64))
        size += len(text)
        texts.append(text)
        low, mid, top = x["codes"]
        codes.append((low.astype(np.int32) | mid.astype(np.int32) << 8 | top.astype(np.int32) << 16) + np.int32(base))
        base += len(lengths)
        doc = np.cumsum(x["doc"])
        counts.append(x["count"].astype(np.int64))
        starts.append(x["start"].astype(np.int64))
        ids.append(x["ids"][doc])
        keys.append(x["keys"][doc])
    if not base:
        return
    vocab = pa.LargeStringArray.from_buffers(base, pa.py_buffer(np.concatenate(offsets)), pa.py_buffer(b"".join(texts)))
    encoded = vocab.dictionary_encode()
    codes = encoded.indices.to_numpy()[np.concatenate(codes)]
    sigma = len(encoded.dictionary)
    del vocab, encoded, texts, offsets
    counts, starts, ids, keys = (np.concatenate(x) for x in (counts, starts, ids, keys))
    yield from _matching(codes, sigma, counts, starts, ids, keys)


def _matching(codes, sigma, counts, starts, ids, keys):
    lengths = counts + WINDOW - 1
    # a run of PROBE words of one document only cannot repeat; runs that share a slot pass as common
    owner = np.repeat(ids, lengths)
    slot = codes.astype(np.uint64)
    run = slot[: len(slot) - PROBE + 1].copy()
    for k in range(1, PROBE):
        run = run * np.uint64(0x9E3779B97F4A7C15) + slot[k : len(slot) - PROBE + 1 + k]
    bits = max(SLOT_BITS, len(run).bit_length())
    slot = (run * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int32)
    del run
    last = np.zeros(1 << bits, np.int64)
    last[slot] = owner[: len(slot)]
    shared = np.zeros(1 << bits, bool)
    shared[slot[last[slot] != owner[: len(slot)]]] = True
    dead = np.concatenate((np.zeros(1, np.int32), np.cumsum(~shared[slot], dtype=np.int32)))
    del owner, last, shared, slot
    at = np.cumsum(lengths) - lengths
    window = ranges(at, counts)
    alive = dead[window + WINDOW - PROBE + 1] == dead[window]
    # what is indexed are the runs of windows without such words
    inner = np.repeat(np.arange(len(counts)), counts)
    head = alive.copy()
    head[1:] &= ~alive[:-1] | (inner[1:] != inner[:-1])
    tail = alive.copy()
    tail[:-1] &= ~alive[1:] | (inner[1:] != inner[:-1])
    first, count, inner = window[head], np.flatnonzero(tail) - np.flatnonzero(head) + 1, inner[head]
    del dead, window, alive, head, tail
    if not len(first):
        return
    starts = starts[inner] + first - at[inner]
    ids, keys, lengths = ids[inner], keys[inner], count + WINDOW - 1
    codes = codes[ranges(first, lengths)]
    used = np.zeros(sigma, bool)
    used[codes] = True
    symbol = np.cumsum(used)
    sigma = int(symbol[-1]) + 1
    at = np.cumsum(lengths) - lengths + np.arange(1, len(lengths) + 1)  # a separator before each, and one at the end
    symbols = np.zeros(len(codes) + len(lengths) + 1, np.int64)
    symbols[ranges(at, lengths)] = symbol[codes]
    del codes, symbol, used
    index = FMIndex(symbols, sigma, keep=8)
    sa, by8, n = index.sa, index.kept, len(symbols)
    owner = np.full(n, np.iinfo(np.int64).max)
    owner[ranges(at, lengths)] = np.repeat(ids, lengths)

    def heads(width):
        """Rows that begin a group with one prefix of ``width`` words, 8 < width <= 16."""
        later = by8[np.minimum(sa + width - 8, n - 1)]
        own = by8[sa]
        return np.append(True, (own[1:] != own[:-1]) | (later[1:] != later[:-1]))

    head = heads(WINDOW - 1)
    parent, parents = np.cumsum(head) - 1, np.append(np.flatnonzero(head), n)
    head = heads(WINDOW)
    group = np.cumsum(head) - 1
    smallest = np.minimum.reduceat(owner[sa], np.flatnonzero(head))
    del by8, sa, owner, head
    index.sa = index.kept = index.rank = None
    order = np.argsort(-lengths, kind="stable")
    hits = np.zeros(n + 1, np.int64)
    longest = lengths[order]
    for t in range(int(longest[0])):
        active = np.searchsorted(-longest, -t, "left")  # segments longer than t
        place = at[order[:active]] + longest[:active] - 1 - t
        symbol = symbols[place]
        if not t:
            low, high = index.first[symbol], index.first[symbol + 1]
            continue
        low, high = low[:active], high[:active]
        if t >= WINDOW:
            row = parent[low]
            low, high = parents[row], parents[row + 1]
        step = index.wavelet.step(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        low, high = step[:active], step[active:]
        if t < WINDOW - 1:
            continue
        repeated = np.flatnonzero(smallest[group[low]] < ids[order[:active]])
        np.add.at(hits, place[repeated], 1)
        np.add.at(hits, place[repeated] + WINDOW, -1)
    gone = np.cumsum(hits[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    seg = np.searchsorted(at, begin, "right") - 1
    if len(seg):
        yield _span_batch(ids[seg], keys[seg], starts[seg] + begin - at[seg], starts[seg] + end - at[seg])


def routed(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(shard, segments) rows, and the number of shards."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // shard_bytes), spark.sparkContext.defaultParallelism)
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    frequent = spark.sparkContext.broadcast(frequent_grams(rows.select("text"), size, shards))
    return rows.mapInArrow(_router(shards, frequent), "shard int, segments binary"), shards


def repeated_spans(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text_key, start, stop): words [start, stop) lie in windows that start in a document with a smaller id."""
    segments, shards = routed(documents, shard_bytes)
    return segments.repartitionById(shards, "shard").mapInArrow(_search_shards, SPANS)


def _with_spans(documents: DataFrame, *columns: str) -> DataFrame:
    spans = (
        repeated_spans(documents)
        .groupBy(F.col("doc_id").alias("_quercus_id"), F.col("text_key").alias("_quercus_key"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("_quercus_spans"))
    )
    keyed = documents.withColumn("_quercus_row_key", text_key())
    return keyed.join(
        spans, (F.col("doc_id").cast("long") == F.col("_quercus_id")) & (F.col("_quercus_row_key") == F.col("_quercus_key")), "left"
    ).select(*columns, "_quercus_spans")


def _mask(n: int, spans) -> np.ndarray:
    begin = spans.values.field("start").to_numpy()
    end = spans.values.field("stop").to_numpy()
    return covered(n, begin, end)


def _digest(batches):
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("_quercus_spans")
        has = spans.is_valid().to_numpy(zero_copy_only=False)
        many, gone, sha = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            words = (text or "").encode().split()
            many.append(len(words))
            if has[i]:
                mask = _mask(len(words), spans[i])
                words = [w for w, m in zip(words, mask, strict=True) if not m]
            gone.append(many[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digest(documents: DataFrame) -> DataFrame:
    """Per row: words, removed words, and a hash of the words that stay."""
    joined_ = _with_spans(documents, "doc_id", "text")
    return joined_.mapInArrow(_digest, f"doc_id {dict(documents.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def _cutter(names):
    def apply(batches):
        for batch in batches:
            texts, spans = batch.column("text"), batch.column("_quercus_spans")
            out, keep = texts.to_pylist(), np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                n = len(out[i].encode().split())
                mask = _mask(n, spans[i])
                keep[i] = not mask.all()
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                out[i] = cut(out[i], edge.tolist(), BLANKS)
            done = [pa.array(out, texts.type) if n == "text" else batch.column(n) for n in names]
            yield pa.record_batch(done, names=names).filter(pa.array(keep))

    return apply


BLANKS = re.compile(rb"[^\x20\x09-\x0D]+")


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` without the repeated words; what stays keeps its spacing. A document that loses every word goes."""
    joined_ = _with_spans(documents, *documents.columns)
    kept = joined_.mapInArrow(_cutter(documents.columns), documents.schema)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else kept
