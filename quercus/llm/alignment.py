"""Token ids of two tokenizers aligned on the bytes that they cover, with corpus-wide counts of linked ids.

Both tokenizers' cumulative byte ends become dictionaries from end to index. The ends that both hold, found by a set
intersection and sorted, slice both id lists into groups, and the ids of a group's two slices are linked pairwise.

Both tokenizers end a token before a blank or line break between two characters that are no white space, wherever it stands: the one by its
pattern, the other because no entry of its vocabulary goes on past such a place (looked up when the model is read; if
one did, texts would be taken whole). So texts are cut there, each distinct unit of a chunk is encoded and aligned once,
and a text's groups are those of its units in order. A text that holds a unit whose tokens do not give its bytes back
is encoded whole, and judged by that.

``write_units`` stores per chunk of documents which units each document holds, and each id pair with the
number of the chunk's documents that link it. Those numbers are added up per pair over the corpus, every chunk gets the
totals of its own pairs back, and a document's sums follow from its units'. Work per chunk is bounded by the chunk's bytes.

Defined cases: a null or empty text, or one whose tokens do not give its bytes back, has no tokens, zeros and an empty
digest; rows that repeat are documents of their own, also in counts; equal counts all count as highest; a very long text is a chunk
by itself and is never cut short; other columns are ignored; an empty table gives no rows. Null ids stay null.
"""

import hashlib
import os
import pickle
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.tokens import _byte_letters
from quercus.llm.words import chunks, column, ranges
from quercus.workspace import Workspace

CHUNK_BYTES = 5 << 20
#: Units that are handed to the tokenizers in one string, and such strings at a time.
JOINED = 50
STRINGS = 200
#: Units that are aligned at once.
UNITS = 2000
#: Links of a group that are listed one by one; the ids of longer groups are counted first.
LISTED = 4096
#: Chunks that a task may number.
PER_TASK = 1 << 32

STORED = "chunk long, state binary, pairs array<long>, documents array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) up to each byte offset where tokens of both end."""
    a = dict(zip(accumulate(a_sizes), range(1, len(a_sizes) + 1), strict=True))
    b = dict(zip(accumulate(b_sizes), range(1, len(b_sizes) + 1), strict=True))
    ends = sorted(a.keys() & b.keys())
    return list(zip(map(a.__getitem__, ends), map(b.__getitem__, ends), strict=True))


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space, or part of a white-space character beyond ASCII."""
    ascii_ = np.zeros(256, bool)
    ascii_[[*range(9, 14), *range(28, 33)]] = True
    out = ascii_[data]
    after = lambda at, n: data[np.minimum(at + n, len(data) - 1)]
    at = np.flatnonzero(data == 0xC2)
    at = at[np.isin(after(at, 1), [0x85, 0xA0])]
    out[at] = out[at + 1] = True
    at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    code = (data[at].astype(np.int32) << 16) | (after(at, 1).astype(np.int32) << 8) | after(at, 2)
    at = at[np.isin(code, WIDE_BLANKS)]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


#: UTF-8 of U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WIDE_BLANKS = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]


class Aligned:
    """Distinct units with their ids in both tokenizers, sliced into groups.

    ``a`` and ``b`` are the ids of all units in a row. Group g is ``a[a_at[g]:a_at[g + 1]]`` with ``b[b_at[g]:b_at[g + 1]]``,
    and unit u has the groups from ``first[u]`` to ``first[u + 1]``.
    """

    def __init__(self, a, b, a_sizes, b_sizes, unit_bytes):
        self.a, self.b = a, b
        ends, unit_ends = np.append(0, np.cumsum(a_sizes)), np.append(0, np.cumsum(unit_bytes))
        # some units at a time, for dictionaries that stay small
        edges = np.append(unit_ends[:-1:UNITS], unit_ends[-1])
        cuts = np.stack((np.searchsorted(ends, edges), np.searchsorted(np.append(0, np.cumsum(b_sizes)), edges)), 1)
        found = [np.zeros((1, 2), np.int64)]
        for (i, k), (j, m) in pairwise(cuts.tolist()):
            found.append(np.fromiter(chain.from_iterable(align(a_sizes[i:j].tolist(), b_sizes[k:m].tolist())), np.int64).reshape(-1, 2) + (i, k))
        self.a_at, self.b_at = np.concatenate(found).T
        self.first = np.searchsorted(ends[self.a_at], unit_ends)  # units end where groups do
        self.n_a, self.n_b = np.diff(self.a_at), np.diff(self.b_at)

    def sizes(self) -> list[np.ndarray]:
        """Tokens of both kinds, groups and links of every unit."""
        return [_sums(x, self.first) for x in (self.n_a, self.n_b, np.ones_like(self.n_a), self.n_a * self.n_b)]

    def texts(self, spelled: pa.Array) -> pa.Array:
        """Every unit's groups as text, each closed by a semicolon; ``spelled`` holds the ids with each mark."""
        most = len(spelled) // len(MARKS)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.a_at[1:] - 1] = last_b[self.b_at[1:] - 1] = 1
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.repeat(self.b_at[:-1], self.n_a)] = self.a + most * last_a
        code[np.arange(len(self.b)) + np.repeat(self.a_at[1:], self.n_b)] = self.b + most * 2 * last_b
        return _slices(spelled.take(pa.array(code)), (self.a_at + self.b_at)[self.first])

    def links(self):
        """(unit, pair, times) of the id pairs that units link."""
        size, owner = self.n_a * self.n_b, np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        short = np.flatnonzero(size <= LISTED)
        group, inside = np.repeat(short, size[short]), ranges(np.zeros(len(short), np.int64), size[short])
        x = self.a[self.a_at[group] + inside // self.n_b[group]]
        y = self.b[self.b_at[group] + inside % self.n_b[group]]
        found = [(owner[group], x << 32 | y, np.ones(len(group), np.int64))]
        for g in np.flatnonzero(size > LISTED).tolist():
            x, n = np.unique(self.a[self.a_at[g] : self.a_at[g + 1]], return_counts=True)
            y, m = np.unique(self.b[self.b_at[g] : self.b_at[g + 1]], return_counts=True)
            pair = (x[:, None] << 32 | y).ravel()
            found.append((np.full(len(pair), owner[g]), pair, (n[:, None] * m).ravel()))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


#: What may follow an id: another id of its slice, the group's other slice, the next group.
MARKS = ",|;"


def _slices(strings: pa.Array, edges: np.ndarray) -> pa.Array:
    """Neighbouring strings joined: from each edge to the next."""
    _, raw, data = strings.buffers()
    place = np.frombuffer(raw, np.int64)[edges] if len(strings) else np.zeros(len(edges), np.int64)
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(place), data)


class Aligner:
    """Cuts, encodes and aligns arrays of texts; one per task."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(vocabulary_a), SentencePieceProcessor(model_file=vocabulary_b)
        self.a.encode_special_tokens = True
        byte = {letter: i for i, letter in enumerate(_byte_letters())}
        known = self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(known.values()) + 1)
        for entry, i in known.items():
            entries[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spaced = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.entries = [pa.array(e, pa.large_binary()) for e in (entries, spaced)]
        self.cuts = not any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces)
        most = max(map(len, self.entries))
        self.spelled = pa.array([f"{i}{mark}" for mark in MARKS for i in range(most)], pa.large_string())

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of both tokenizers of texts that start with a blank or a line break."""
        own = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # the second tokenizer puts a blank in front by itself; before a line break it is a token of its own, and goes
        others = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return own, [b if t[0] == " " else b[1:] for t, b in zip(texts, others, strict=True)]

    def _flat(self, which: int, lists):
        """Ids in a row, the bytes of each, those bytes, and how many each list covers."""
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
        taken = self.entries[which].take(pa.array(ids))
        sizes = pc.binary_length(taken).to_numpy().astype(np.int64)
        data = taken.buffers()[2]
        return ids, sizes, data.to_pybytes()[: int(sizes.sum())] if data is not None else b"", _sums(sizes, np.append(0, np.cumsum(n)))

    def _gives_back(self, text: str, *lists) -> bool:
        return all(b"".join(e[i].as_py() for i in ids) == text.encode() for e, ids in zip(self.entries, lists, strict=True))

    def align_units(self, names: list[str]) -> tuple[Aligned, np.ndarray]:
        """The distinct units aligned, and which of them do not come back; these have no tokens."""
        runs, lone = [], True
        for name in names:  # units that start and end like words can stand side by side in one string
            inner = len(name) > 1 and not name[1].isspace() and not name[-1].isspace() and self.cuts
            if inner and not lone and len(runs[-1]) < JOINED:
                runs[-1].append(name)
            else:
                runs.append([name])
            lone = not inner
        bad, pieces, at = np.zeros(len(names), bool), [(np.zeros(0, np.int64),) * 4], 0
        for some in range(0, len(runs), STRINGS):
            block = runs[some : some + STRINGS]
            pieces.append(self._encoded_runs(block, bad, at))
            at += sum(map(len, block))
        unit_bytes = np.fromiter((len(n.encode()) for n in names), np.int64, len(names))
        unit_bytes[bad] = 0
        return Aligned(*map(np.concatenate, zip(*pieces, strict=True)), unit_bytes), bad

    def _encoded_runs(self, runs: list[list[str]], bad: np.ndarray, at: int):
        """Both tokenizers' ids of runs of units in a row, and the bytes of each; marks the units that do not come back, from number ``at`` on."""
        texts = list(map("".join, runs))
        lists = self.encode(texts)
        data, wanted = "".join(texts).encode(), np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        flat = [self._flat(k, x) for k, x in enumerate(lists)]
        if not all(joined == data and np.array_equal(sizes, wanted) for _, _, joined, sizes in flat):
            again = ([], [])
            for run, text, *ids in zip(runs, texts, *lists, strict=True):
                parts = [(text, *ids)] if self._gives_back(text, *ids) else list(zip(run, *self.encode(run), strict=True))
                for i, (part, *own) in enumerate(parts):
                    if len(parts) == len(run) and not self._gives_back(part, *own):
                        bad[at + i], own = True, ([], [])
                    for k in (0, 1):
                        again[k].append(own[k])
                at += len(run)
            flat = [self._flat(k, x) for k, x in enumerate(again)]
        return flat[0][0], flat[1][0], flat[0][1], flat[1][1]

    def cut(self, texts: pa.Array):
        """(code of every unit, first unit of each text, distinct units)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        wide = lambda x: pa.scalar(x, pa.large_string())
        texts = pc.if_else(pc.equal(texts, wide("")), wide(""), pc.binary_join_element_wise(wide(" "), texts, wide("")))
        _, raw, buffer = texts.buffers()
        offsets = np.frombuffer(raw, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), []
        starts = np.zeros(len(data) + 1, bool)
        if self.cuts:
            blank = white(data)
            starts[1:-2] = ((data == 32) | (data == 10))[1:-1] & ~blank[:-2] & ~blank[2:]
            starts[offsets[1:] - 1] = False  # a text's last byte opens no unit
        starts[offsets] = True
        edges = np.flatnonzero(starts)
        units = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data.tobytes()))
        encoded = units.dictionary_encode()
        return encoded.indices.to_numpy().astype(np.int64), np.searchsorted(edges, offsets), encoded.dictionary.to_pylist()

    def aligned(self, texts: pa.Array):
        """(code of every unit, first unit of each text, the units aligned); texts that do not come back have no units."""
        # the second tokenizer reads this mark as a blank, so no text that holds it comes back
        texts = pc.if_else(pc.fill_null(pc.match_substring(texts, "▁"), True), pa.scalar(None, texts.type), texts)
        codes, firsts, names = self.cut(texts)
        units, bad = self.align_units(names)
        if bad.any():
            owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
            odd = np.unique(owner[bad[codes]])  # a text with a unit that does not come back is judged as a whole
            units, _ = self.align_units(names + [" " + texts[i].as_py() for i in odd.tolist()])
            stay = ~np.isin(owner, odd)
            owner, codes = np.append(owner[stay], odd), np.append(codes[stay], len(names) + np.arange(len(odd)))
            order = np.argsort(owner, kind="stable")
            codes, firsts = codes[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
        return codes, firsts, units


def _sums(values, firsts: np.ndarray) -> np.ndarray:
    """Sum of the values from each first to the next."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[firsts[1:]] - total[firsts[:-1]]


def _digests(texts: pa.Array, codes: np.ndarray, firsts: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups, without the last semicolon."""
    joined = _slices(texts.take(pa.array(codes)), firsts)
    _, raw, data = joined.buffers()
    place, view = np.frombuffer(raw, np.int64).tolist(), memoryview(data) if data is not None else b""
    return [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(place[:-1], place[1:], strict=True)]


def _writer(vocabulary_a: str, vocabulary_b: str):
    def run(batches):
        aligner, n = None, 0
        for table in chunks(batches, most=CHUNK_BYTES):
            aligner = aligner or Aligner(vocabulary_a, vocabulary_b)
            codes, firsts, units = aligner.aligned(column(table, "text"))
            # each document's distinct units with their times
            wide = max(1, len(units.first) - 1)
            key, times = np.unique(np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)) * wide + codes, return_counts=True)
            owner, held = key // wide, key % wide
            unit, pair, weight = units.links()
            order = np.argsort(unit, kind="stable")
            pairs, place = np.unique(pair[order], return_inverse=True)
            links = np.bincount(unit, minlength=wide)
            start = np.cumsum(links) - links
            many = max(1, len(pairs))
            linked = np.unique(np.repeat(owner, links[held]) * many + place[ranges(start[held], links[held])])
            state = {
                "doc_id": column(table, "doc_id").to_pylist(), "digest": _digests(units.texts(aligner.spelled), codes, firsts),
                "sizes": [_sums(s[codes], firsts) for s in units.sizes()], "first": np.searchsorted(owner, np.arange(len(firsts))),
                "held": held.astype(np.int32), "times": times.astype(np.int32), "links": links.astype(np.int32),
                "place": place.astype(np.int32), "weight": weight[order].astype(np.int32),
            }
            documents = np.bincount(linked % many, minlength=len(pairs)).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array([TaskContext.get().partitionId() * PER_TASK + n], pa.int64()),
                    pa.array([zstandard.compress(pickle.dumps(state, 5), 1)], pa.binary()),
                    pa.array([pairs], pa.list_(pa.int64())), pa.array([documents], pa.list_(pa.int32())),
                ],
                names=["chunk", "state", "pairs", "documents"],
            )
            n += 1

    return run


def write_units(documents: DataFrame, ws: Workspace, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Chunks of aligned documents, with the id pairs that each links and in how many of its documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ws.table(rows.mapInArrow(_writer(*(vocabularies or default_vocabularies())), STORED), "aligned")


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, count, best) of every id pair: documents that link it, and whether none of its A id's pairs has more.

    A pair is the A id times 2**32 plus the B id; the rows of an A id are bounded by the other vocabulary.
    """
    counted = (
        stored.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum(F.col("x.documents").cast("long")).alias("count"))
    )
    own = Window.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", F.col("count") == F.max("count").over(own))


def _finish(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links."""
    state = pickle.loads(zstandard.decompress(chunk.column("state")[0].as_py()))
    count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts.column("position").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
    place, weight, links = state["place"], state["weight"], state["links"].astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(links)))
    held, times = state["held"], state["times"]
    per_unit = [_sums(weight * values[place], firsts) for values in (best, count)]
    n_best, count_sum = (_sums(u[held] * times, state["first"]) for u in per_unit)
    return pa.table(
        [pa.array(state["doc_id"], pa.int64()), *map(pa.array, state["sizes"]), pa.array(n_best), pa.array(count_sum), pa.array(state["digest"], pa.string())],
        names=[f.split()[0] for f in RESULT.split(", ")],
    )


def digest(documents: DataFrame, ws: Workspace, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Per document its tokens, groups and links, and what its links count over the corpus."""
    stored = write_units(documents, ws, vocabularies)
    of_chunk = stored.select("chunk", F.posexplode("pairs").alias("position", "pair")).join(pair_counts(stored), "pair")
    back = of_chunk.select(F.col("chunk").alias("of_chunk"), "position", "count", "best")
    return stored.select("chunk", "state").groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(_finish, RESULT)


def groups(documents: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, groups): each document's groups as pairs of id lists."""
    paths = vocabularies or default_vocabularies()
    of_group = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches):
        aligner = None
        for table in chunks(batches, most=CHUNK_BYTES // 8):
            aligner = aligner or Aligner(*paths)
            codes, firsts, units = aligner.aligned(column(table, "text"))
            a, b = units.a.tolist(), units.b.tolist()
            stops = list(zip(units.a_at.tolist(), units.b_at.tolist(), strict=True))
            sliced = [{"a": a[s:e], "b": b[t:f]} for (s, t), (e, f) in pairwise(stops)]
            of_unit = list(pairwise(units.first.tolist()))
            rows = [[g for c in codes[x:y].tolist() for g in sliced[slice(*of_unit[c])]] for x, y in pairwise(firsts.tolist())]
            yield pa.record_batch([column(table, "doc_id"), pa.array(rows, pa.list_(of_group))], names=["doc_id", "groups"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")
