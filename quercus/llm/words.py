"""Whole batches of texts cut into words at C++ speed.

Both word definitions of this package are ASCII-only decisions on UTF-8 bytes (every byte
of a non-ASCII character is 0x80 or more), so a batch is cut on its byte buffer: a byte
table maps separators to blanks, Arrow splits on blanks and dictionary-encodes the words.
A null text has no words.
"""

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in pieces of about this many bytes, so a task's memory does not follow its input.
CHUNK_BYTES = 24 << 20


def _fold_table() -> np.ndarray:
    """A-Z to a-z; bytes outside 0-9, a-z and 0x80-0xFF to a blank."""
    table = np.full(256, 0x20, np.uint8)
    for keep in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
        table[list(keep)] = list(keep)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


FOLD = _fold_table()


@dataclass
class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are text i's words, as positions in ``vocab``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    def hashes(self) -> np.ndarray:
        """64-bit hash of every vocabulary entry."""
        return np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocab.to_pylist()], np.uint64)

    def owners(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def folded(texts: pa.Array) -> pa.Array:
    """Every byte through ``FOLD``; lengths stay, so byte positions are those of the text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    table = FOLD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(table), None, 0, texts.offset)


def split(texts: pa.Array, fold: bool = False) -> Words:
    """Words between ASCII white space; with ``fold``, lower-cased runs of 0-9, a-z and non-ASCII."""
    texts = folded(texts) if fold else texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    encoded = lists.values.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    blank = pc.index(encoded.dictionary, "").as_py()
    if blank >= 0:
        keep = codes != blank
        kept = np.concatenate(([0], np.cumsum(keep)))
        codes, offsets = codes[keep], kept[offsets]
    else:
        codes, offsets = codes[offsets[0] : offsets[-1]], offsets - offsets[0]
    return Words(codes, offsets, encoded.dictionary)


def chunks(batches, column: str = "text", most: int = CHUNK_BYTES):
    """Arrow batches regrouped to tables of about ``most`` bytes of ``column``; one longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + most - size, "right"))
            if stop == start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
                start = stop
            if start < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = None
    pa.default_memory_pool().release_unused()  # an idle worker keeps no buffers of its last task


def hand_back() -> None:
    """Give freed memory back to the system, where the C library can: an idle worker keeps none of its last task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a chunk as one array."""
    col = table.column(name).combine_chunks()
    return pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a then b."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0x632BE59BD9B4E019))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries, by doubling; the last n - 1 positions have none."""
    out, width, level, span = None, 0, hashes, 1
    while True:
        if n & span:
            out = level if out is None else joined(out[: max(0, len(hashes) - width - span + 1)], level[width:])
            width += span
        if span * 2 > n:
            return out[: max(0, len(hashes) - n + 1)]
        level = joined(level[:-span], level[span:]) if len(level) > span else level[:0]
        span *= 2


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
