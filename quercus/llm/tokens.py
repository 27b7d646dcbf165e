"""Token ids of whole texts, by a public tokenizer, at the cost of their distinct words.

The tokenizer cuts a text at white space before anything else (its pattern never matches
white space, its normaliser neither joins nor splits across it, and its added tokens hold
none), so a text's ids are those of its blank-separated pieces in order, and each distinct
piece of a chunk is encoded once. A piece that is a Latin word and a tail of marks is two runs
to the tokenizer's pattern: the word goes to its model directly, spelled in the byte alphabet,
and both are kept for the next piece. Every other piece takes the tokenizer's whole path.
This holds for the BPE vocabularies with a byte-level pre-tokenizer, white-space-free pattern
and lower-casing normaliser; for any other file every piece, or text, takes the whole path.

``vocabulary`` is the path of a tokenizers JSON file; every task reads it once.
"""

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quercus.llm.words import chunks, column, ranges

#: Words that a task keeps between chunks.
KEPT_WORDS = 250_000
CHUNK_BYTES = 8 << 20
#: Marks that are neither letters, digits, white space, apostrophes nor part of an added token's name.
MARKS = ".,!?;:%$&*#"
#: Anything but ASCII and the composed Latin letters up to U+01FF, on which lower-casing is one to one (U+0130 is not).
BEYOND_LATIN = "[^\\x00-\\x{12F}\\x{131}-\\x{1FF}]"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def _described(part) -> str:
    """The JSON of a tokenizer's component."""
    return json.dumps(json.loads(part.__getstate__())) if part is not None else ""


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Encodes arrays of texts; one per task."""

    def __init__(self, vocabulary: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        steps, norm = (_described(x) for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        self.by_piece = '"invert": true' in steps and "\\\\s" in steps and '"ByteLevel"' in steps
        self.by_word = self.by_piece and '"Lowercase"' in norm
        self.spelling = dict(enumerate(_byte_letters()))
        self.words, self.tails = {}, {}

    def _whole(self, texts: list[str]) -> list:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin letters; bytes beyond ASCII stand under their letters."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
        return _packed([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _known(self, kept: dict, names: list[str], ids_of) -> list:
        if len(kept) > KEPT_WORDS:
            kept.clear()
        fresh = [n for n in names if n not in kept]
        kept.update(zip(fresh, ids_of(fresh), strict=True))
        return [kept[n] for n in names]

    def _pieces(self, pieces: pa.Array):
        """Flat ids and lengths of each piece."""
        n = len(pieces)
        if not self.by_word:
            units, first, second = self._whole(pieces.to_pylist()), np.arange(n), np.full(n, -1)
        else:
            low = pc.utf8_lower(pieces)
            word = pc.utf8_rtrim(low, MARKS)
            plain = pc.and_(pc.utf8_is_alpha(word), pc.invert(pc.match_substring_regex(pieces, BEYOND_LATIN)))
            is_plain = plain.to_numpy(zero_copy_only=False)
            found = word.filter(plain).dictionary_encode()
            units = self._known(self.words, found.dictionary.to_pylist(), lambda new: [self._word(w) for w in new])
            first, second = np.zeros(n, np.int64), np.full(n, -1)
            first[is_plain] = found.indices.to_numpy(zero_copy_only=False)
            tail = np.where(is_plain, pc.subtract(pc.utf8_length(low), pc.utf8_length(word)).to_numpy(zero_copy_only=False), 0)
            for size in np.unique(tail[tail > 0]).tolist():
                has = np.flatnonzero(tail == size)
                found = pc.utf8_slice_codeunits(low.take(pa.array(has)), -size).dictionary_encode()
                second[has] = len(units) + found.indices.to_numpy(zero_copy_only=False)
                units = units + self._known(self.tails, found.dictionary.to_pylist(), self._whole)
            rest = np.flatnonzero(~is_plain)
            first[rest] = len(units) + np.arange(len(rest))
            units = units + self._whole(pieces.take(pa.array(rest)).to_pylist())
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        flat = np.frombuffer(b"".join(units), np.uint32)
        starts, sizes = np.append(np.cumsum(sizes) - sizes, 0), np.append(sizes, 0)  # unit -1 is empty
        pair = np.stack((first, second), 1).ravel()
        return flat[ranges(starts[pair], sizes[pair])], sizes[first] + sizes[second]

    def encode(self, texts: pa.Array, end: int):
        """(flat ids, offsets) of the texts, each closed by ``end``. A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.by_piece:
            lists = pc.ascii_split_whitespace(texts)
            values, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
        else:
            values, offsets = texts, np.arange(len(texts) + 1)
        encoded = values.dictionary_encode()
        flat, sizes = self._pieces(encoded.dictionary)
        starts = np.cumsum(sizes) - sizes
        codes = encoded.indices.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        lengths = sizes[codes]
        total = np.concatenate(([0], np.cumsum(lengths)))[offsets - offsets[0]]
        out = np.full(int(total[-1]) + len(texts), end, np.uint32)
        place = np.ones(len(out), bool)
        bounds = total + np.arange(len(total))
        place[bounds[1:] - 1] = False
        out[place] = flat[ranges(starts[codes], lengths)]
        return out, bounds


def encoded(batches, vocabulary: str, end: int, plain_specials: bool = False, most: int = CHUNK_BYTES):
    """Chunks of Arrow batches with their ids: (table, flat ids, offsets)."""
    encoder = None
    for table in chunks(batches, most=most):
        encoder = encoder or Encoder(vocabulary, plain_specials)
        ids, offsets = encoder.encode(column(table, "text"), end)
        yield table, ids, offsets
