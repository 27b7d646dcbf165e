"""Packing by minimum bin slack: fixed-length training sequences without padding.

A task packs what it holds (a chunk of documents) on its own, so nothing is shuffled. A
document's full windows are sequences by themselves; its remainder joins a multiset of
remaining lengths. For each window, a subset-sum dynamic programme over the bits of an
integer (bit s: some of the remaining lengths sum to s) starts from the largest remainder and
takes length by length, counts split in powers of two, until the capacity can be
reached; the sums are then walked back to the counts of each length that fill the window
closest to capacity. What slack stays is closed by cutting the smallest remainder that is
longer than it. The chunk's last tokens, less than a window, are cut to lengths that are
powers of two, which need no padding.

Defined cases: a null or empty text is the end token alone; repeated rows and ids are
packed like any other; other columns are ignored. Sequence ids are unique over the job, not
consecutive. A piece's ids are little-endian unsigned 32-bit integers.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.tokens import default_vocabulary, encoded
from quercus.llm.words import column

CAPACITY = 4096
END = 2
#: Sequences that a task may number.
PER_TASK = 1 << 40


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill ``capacity`` most closely, without going over."""
    mask = (1 << (capacity + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, batch = min(counts[length], capacity // length), 1
        while left and not reach >> capacity:
            take = min(batch, left)
            stages.append((reach, length, take))
            reach = (reach | reach << (length * take)) & mask
            left, batch = left - take, batch * 2
        if reach >> capacity:
            break
    target, out = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(stages):
        if not before >> target & 1:
            out[length] += take
            target -= length * take
    return dict(out)


def pack(sizes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of ``sizes`` tokens."""
    pieces, sequence = [], 0
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> [(document, start)]
    for doc, size in enumerate(sizes):
        full = int(size) // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if size - full * capacity:
            rest[int(size) - full * capacity].append((doc, full * capacity))
    left = sum(length * len(docs) for length, docs in rest.items())

    def take(length):
        piece = rest[length].pop()
        if not rest[length]:
            del rest[length]
        return piece

    while left >= capacity:
        largest = max(rest)
        chosen = [(largest, *take(largest))]
        for length, times in best_fill({k: len(v) for k, v in rest.items()}, capacity - largest).items():
            chosen += [(length, *take(length)) for _ in range(times)]
        slack = capacity - sum(c[0] for c in chosen)
        while slack:  # cut what is longer than the slack, or take the longest there is
            longer = [x for x in rest if x > slack]
            length = min(longer) if longer else max(rest)
            doc, start = take(length)
            part = min(slack, length)
            chosen.append((part, doc, start))
            if length > part:
                rest[length - part].append((doc, start + part))
            slack -= part
        offset = 0
        for length, doc, start in chosen:
            pieces.append((doc, start, length, sequence, offset))
            offset += length
        left, sequence = left - capacity, sequence + 1
    tail = sorted(((doc, start, length) for length, docs in rest.items() for doc, start in docs))
    room, offset = 0, 0
    for doc, start, length in tail:
        while length:
            if not room:
                room, offset, sequence = 1 << (left.bit_length() - 1), 0, sequence + 1
            part = min(room, length)
            pieces.append((doc, start, part, sequence, offset))
            start, length, room, offset, left = start + part, length - part, room - part, offset + part, left - part
    return pieces


def _packer(vocabulary: str, capacity: int, end: int):
    def run(batches):
        base = TaskContext.get().partitionId() * PER_TASK
        for table, ids, offsets in encoded(batches, vocabulary, end):
            sizes = np.diff(offsets)
            doc, start, length, sequence, offset = np.array(pack(sizes.tolist(), capacity), np.int64).T
            order = np.lexsort((offset, sequence))
            doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
            data = ids.astype("<u4").tobytes()
            first = (offsets[doc] + start) * 4
            blobs = pa.array([data[a : a + n] for a, n in zip(first.tolist(), (length * 4).tolist(), strict=True)], pa.binary())
            yield pa.record_batch(
                [
                    column(table, "doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), blobs,
                    pa.array(sizes[doc].astype(np.int64)), pa.array(base + sequence), pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            base += int(sequence.max()) + 1

    return run


def packed(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece, with its ids."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        _packer(vocabulary or default_vocabulary(), capacity, end),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
