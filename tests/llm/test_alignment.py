"""Cross-tokenizer alignment against a plain version, and its counts by brute force."""

import hashlib
import random
from collections import Counter

import pytest

from quercus.llm import alignment
from quercus.llm.alignment import Aligner, default_vocabularies


@pytest.fixture(scope="module")
def plain():
    """Groups of a text by both tokenizers on the whole text and the ends they share."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = default_vocabularies()
    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printed)}

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        own = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes_b(i)) for i in b.encode(text)]
        data = (" " + text).encode()
        if b"".join(x for _, x in own) != data or b"".join(x for _, x in other) != data:
            return []
        ends = [set(), set()]
        for k, side in enumerate((own, other)):
            at = 0
            for _, x in side:
                at += len(x)
                ends[k].add(at)
        out = []
        for end in sorted(ends[0] & ends[1]):
            sides = []
            for side in (own, other):
                ids = []
                while side and sum(len(x) for _, x in ids) + len(side[0][1]) <= end - (out[-1][2] if out else 0):
                    ids.append(side.pop(0))
                sides.append([i for i, _ in ids])
            out.append((*sides, end))
        return [(x, y) for x, y, _ in out]

    return groups


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(plain, rows):
    """Digest rows of (doc_id, text) pairs."""
    docs = [(i, plain(t)) for i, t in rows]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in docs]
    count = Counter(pair for links in linked for pair in links)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    for (i, groups), links in zip(docs, linked, strict=True):
        yield (
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else "",
        )


ODD = [
    "▁", "a▁b c", " x", "x ", "\n", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "  a  b  ", "a  b", "a  b", "a　\nb", "\t tab", "a\x85b \x1cc d",
    "<|endoftext|> </s> <0x41> <unk>", "日本語 テキスト", "😀‍😀 é́ x́", "\x00 \x00a", "x" * 5000, "it's 's ''re 're", "１２３ ﬁ İ", "1 23 456 7890123",
]


def test_digest_is_brute_force(spark, ws, make, odd_rows, plain):
    rng = random.Random(5)
    alphabet = ["a", "é", "the", "'s", " ", " ", " ", "\n", "\n", "\t", " ", " ", "▁", "日", "1", ".", "!!", "</s>", "İ", "́"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = odd_rows + [(1000 + i, t) for i, t in enumerate(ODD + mixed)]
    got = alignment.digest(make(rows).repartition(5), ws).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(plain, rows)))


def test_groups_and_small_chunks(spark, make, odd_rows, plain, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(alignment, "LISTED", 1)
    got = alignment.groups(make(odd_rows)).collect()
    assert sorted((str(r.doc_id), text_of([(g.a, g.b) for g in r.groups])) for r in got) == sorted((str(i), text_of(plain(t))) for i, t in odd_rows)


def test_texts_are_taken_whole_where_the_vocabulary_asks_for_it(plain):
    import pyarrow as pa

    aligner = Aligner(*default_vocabularies())
    assert aligner.cuts
    aligner.cuts = False
    codes, firsts, units = aligner.aligned(pa.array(ODD))
    texts = units.texts(aligner.spelled)
    found = ["".join(texts[c].as_py() for c in codes[a:b])[:-1] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    assert found == [text_of(plain(t)) for t in ODD]


def test_a_unit_that_does_not_come_back(plain):
    """A vocabulary entry that gives other bytes: only the texts that use it lose their tokens."""
    import pyarrow as pa

    aligner = Aligner(*default_vocabularies())
    wrong = aligner.b.encode("hello")[0]
    entries = aligner.entries[1].to_pylist()
    entries[wrong] = b"?"
    aligner.entries[1] = pa.array(entries, pa.large_binary())
    texts = ["one two three", "one hello three", "three two", None]
    codes, firsts, units = aligner.aligned(pa.array(texts))
    spelled = units.texts(aligner.spelled)
    found = ["".join(spelled[c].as_py() for c in codes[a:b])[:-1] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    assert found == [text_of(plain(texts[0])), "", text_of(plain(texts[2])), ""]


def test_empty_table(spark, ws, make):
    assert alignment.digest(make([]), ws).collect() == []
    assert alignment.groups(make([])).collect() == []
