"""Token output, packing, separator scan and WARC: round trips."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quercus.llm import packing, token_counts, token_orc, warc
from quercus.llm.tokens import Encoder, default_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name, odd_rows):
    import public_tokenizers

    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = [t for _, t in odd_rows] + [
        "a\x1cb \x85c", "İ ẞ Σ ΑΣ ς", "can't. 's 'S ''s 1a. a1 ½x", "Straße. ÉCOLE!! ʼn Dž. ǰ. İ. K Å. ſ ﬀ. ́. á.", "　全角 ﬁ x́. <..",
        "a.<|endoftext|>b", "<|startoftext|>", "x" * 3000, "ẹ́́. é.",
    ]
    ids, offsets = Encoder(path).encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [2], t


def test_orc_round_trip(spark, ws, make, odd_rows, tokenizer):
    path = ws.path("orc")
    token_orc.write(make(odd_rows), path)
    got = token_orc.digest(spark, path, ws).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(x), crc(x)) for i, t in odd_rows for x in [ids_of(tokenizer, t)]
    )
    at = 0  # the documents lie behind each other, in order of ids
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)


def test_orc_prunes(spark, ws, make, odd_rows):
    path = ws.path("orc")
    token_orc.write(make(odd_rows), path)
    assert token_orc.between(spark, path, 10, 19).count() == 10
    found = token_orc.lookup(spark, path, [64, 12345])
    assert found.count() == 1
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_orc_empty(spark, ws, make):
    path = ws.path("orc")
    token_orc.write(make([]), path)
    assert token_orc.digest(spark, path, ws).count() == 0


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_packing(make, odd_rows, tokenizer, capacity):
    rows = [r for r in odd_rows if r[0] != 72]
    whole = {}
    for i, t in rows:
        whole[i, crc(ids_of(tokenizer, t))] = ids_of(tokenizer, t)
    pieces = packing.packed(make(rows), capacity=capacity).collect()
    by_sequence, tokens = defaultdict(list), Counter()
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
        mine = [x for (i, _), x in whole.items() if i == p.doc_id and len(x) == p.doc_tokens]
        assert any(np.array(x[p.start : p.start + p.length], "<u4").tobytes() == p.ids for x in mine)
        tokens[p.doc_id] += p.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)  # no padding
    expected = Counter()
    for i, t in rows:
        expected[i] += len(ids_of(tokenizer, t))
    assert tokens == expected


def test_packing_empty(make):
    assert packing.packed(make([])).count() == 0


def test_best_fill_is_best():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 5)}
        capacity = int(rng.integers(1, 60))
        got = packing.best_fill(counts, capacity)
        assert all(got[k] <= counts[k] for k in got)
        sums = {sum(k * n for k, n in zip(counts, c, strict=True)) for c in product(*(range(v + 1) for v in counts.values()))}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= capacity)


@pytest.mark.parametrize("block", [2, 6, 100, 1 << 20])
def test_separator_scan(ws, make, odd_rows, tokenizer, block):
    rows = odd_rows if block > 6 else [r for r in odd_rows if r[0] in (1, 2, 4, 8, 65, None)][:8]
    plain = Tokenizer.from_file(default_vocabulary())
    plain.encode_special_tokens = True
    got = token_counts.document_counts(make(rows), ws, block=block).collect()
    expected = [(str(i), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(expected)


def test_separator_scan_empty(ws, make):
    assert token_counts.document_counts(make([]), ws).count() == 0


@pytest.mark.parametrize("block", [3000, 1 << 20])
@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, ws, block, least):
    nested = warc.member(1, "u", b"inner", "AAAA", None)
    rows = [(i, f"http://x/{i}", "<p>" + "page " * (i % 7) * 40) for i in range(40)]
    rows += [(50, None, None), (51, "a b\nc", ""), (52, "", "dup"), (53, "", "dup"), (53, "", "dup"), (54, "", "x" * 100_000), (None, "n", "dup")]
    rows += [(55, "gz", "".join(chr(b) for b in nested))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS payload", "'d' AS digest")
    archives = warc.write(pages, ws, least=least)
    got = warc.read(archives, ws, block=block)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        keeper = last.get(h or "") if len(data) >= least else i
        again = i is not None and keeper != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, len(data), digest, "revisit" if again else "response", keeper if again else None, None if again else data))
    found = [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
        for r in got.collect()
    ]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_warc_skips_what_is_no_record():
    class Bytes:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    one = warc.member(1, "u", b"hello", "AAAA", None)
    data = b"junk\x1f\x8b\x08junk" + one + zlib.compress(b"no", wbits=31) + one + one[: len(one) // 2]
    window = warc.Window(Bytes(data), 0, len(data), len(data))
    assert [o for o, _ in warc.members(window, len(data))] == [11, data.index(one, 20)]


def test_warc_empty(spark, ws):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, ws).count() == 0


def test_encoder_on_every_latin_letter():
    encoder = Encoder(default_vocabulary())
    texts = [t for c in range(0x21, 0x250) for t in (chr(c), "a" + chr(c), chr(c) + "b", "x" + chr(c) + "y.", chr(c) + "!", "a.́" + chr(c))]
    ids, offsets = encoder.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2], t
