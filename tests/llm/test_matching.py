"""Decontamination, substring dedup, Jaccard join, BM25 against brute force."""

import hashlib
import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from .llm_helpers import blank_words, folded_words

from quercus.llm import bm25, decontamination, jaccard_join, substring_dedup
from quercus.llm.components import components
from quercus.llm.fm_index import FMIndex


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n, sigma", [(200, 4), (3000, 5), (5000, 60)])
def test_fm_index(n, sigma):
    rng = np.random.default_rng(n)
    text = rng.integers(0, sigma, n)
    text[0] = text[-1] = 0
    text[n // 2 : n // 2 + n // 4] = text[5 : 5 + n // 4]
    index = FMIndex.of(FMIndex(text, sigma, 8).compact().state())
    plain = text.tolist()
    for length in (1, 2, 5, 10):
        patterns = np.zeros((40, 10), np.int64)
        for row in patterns:
            at = rng.integers(0, n - length)
            row[10 - length :] = text[at : at + length]
        low, high = index.search(patterns, np.full(40, length))
        for row, a, b in zip(patterns, low, high, strict=True):
            want = row[10 - length :].tolist()
            expected = [] if 0 in want else [i for i in range(n - length + 1) if plain[i : i + length] == want]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


def items_of(rows):
    words = folded_words(dict((i, t) for i, t in rows if i is not None)[64])
    return [
        (1, " ".join(words[100:130])), (2, " ".join(words[120:125])), (3, None), (4, "..."), (5, "never occurs here at all"), (6, "One, TWO three!"),
        (7, " ".join(words[300:310]).upper()), (7, " ".join(words[300:310])), (None, " ".join(words[900:915])), (10, " ".join(words[125:140])),
    ]


def expected_hits(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = folded_words(text)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[k : k + width])].add(item)
    out = []
    for i, t in rows:
        w, hit, found = folded_words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= {str(x) for x in got if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def test_contamination(spark, ws, make, odd_rows):
    items = items_of(odd_rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(make(odd_rows), benchmark, ws).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected_hits(odd_rows, items), key=str)
    assert any(r.contaminated for r in got)


def test_benchmark_in_blocks(spark, ws, make, odd_rows):
    items = items_of(odd_rows)
    index = decontamination.build_index(make(odd_rows), ws)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    spans = lambda size: sorted(
        {tuple(r) for r in decontamination.hit_spans(index, benchmark, block_bytes=size).collect()}, key=str
    )
    assert spans(1 << 20) == spans(60)


def test_contamination_of_nothing(spark, ws, make, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contamination(make(odd_rows[:5]), none, ws).collect())
    assert decontamination.contamination(make([]), none, ws).count() == 0


def test_decontaminated(spark, ws, make, odd_rows):
    items = items_of(odd_rows)
    docs = make(odd_rows)
    out = decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"), ws)
    assert out.columns == docs.columns
    expected = []
    for (i, t), (_, n, hit, *_) in zip(odd_rows, expected_hits(odd_rows, items), strict=True):
        if not hit:
            expected.append((i, t))
        elif hit < n:
            expected.append((i, n - hit))
    got = [(r.doc_id, len(folded_words(r.text)) if r.doc_id == 64 else r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def kept_words(rows, n=13):
    first = {}
    for i, t in rows:
        w = blank_words(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), i), i)
    for i, t in rows:
        w = blank_words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        yield i, t, w, [x for k, x in enumerate(w) if k not in gone]


def test_substring_dedup(make, odd_rows):
    got = substring_dedup.digest(make(odd_rows)).collect()
    expected = [(i, len(w), len(w) - len(kept), sha(" ".join(kept))) for i, _, w, kept in kept_words(odd_rows)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_substring_dedup_random_repeats(make):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(30)]
    pool = [[rng.choice(vocab) for _ in range(rng.randrange(10, 40))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            words += part[a:] if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words)))
    got = substring_dedup.digest(make(rows).repartition(5)).collect()
    expected = [(i, len(w), len(w) - len(kept), sha(" ".join(kept))) for i, _, w, kept in kept_words(rows)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert sum(r.n_removed for r in got) > 500


def test_deduplicated_text(make, odd_rows):
    docs = make(odd_rows)
    out = substring_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    expected = []
    for i, t, w, kept in kept_words(odd_rows):
        if len(kept) == len(w):
            expected.append((i, t))
        elif kept:
            expected.append((i, " ".join(kept)))
    got = [(r.doc_id, r.text if (r.doc_id, r.text) in expected else " ".join(blank_words(r.text))) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def words_of_shards(documents):
    """Words of each shard, from its segments."""
    found = Counter()
    for row in substring_dedup.routed(documents)[0].collect():
        x = pickle.loads(zstandard.decompress(row.segments))
        found[row.shard] += int(x["count"].sum()) + len(x["count"]) * (substring_dedup.WINDOW - 1)
    return found


def test_frequent_pair_fills_no_shard(make):
    """One pair has the smallest hash and stands in every window."""
    hashes = lambda w: np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
    pair = min((("the", f"e{i}") for i in range(20000)), key=lambda p: substring_dedup.grams(hashes(p), 2)[0])
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(40) for w in (*pair, *(f"r{rng.randrange(10**6)}" for _ in range(8))))) for i in range(300)]
    found = words_of_shards(make(rows))
    assert max(found.values()) < 2 * sum(found.values()) / len(found)


def test_windows_of_frequent_pairs(make):
    """Few words, so that pairs, and in one passage longer grams, are all frequent: equal windows still meet, in several shards."""
    rng = random.Random(5)
    passage = " ".join(rng.choice("abcd") for _ in range(40))
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(200)))) for i in range(150)]
    rows += [(i, f"{passage} u{i} " * 3) for i in range(150, 400)]
    docs = make(rows).repartition(5)
    frequent = substring_dedup.frequent_grams(docs.select("text"), sum(len(t) for _, t in rows), 8)
    assert all(len(frequent[w]) for w in substring_dedup.ANCHORS)
    got = substring_dedup.digest(docs).collect()
    expected = [(i, len(w), len(w) - len(kept), sha(" ".join(kept))) for i, _, w, kept in kept_words(rows)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert len(words_of_shards(docs)) > 1


def test_substring_dedup_empty(make):
    assert substring_dedup.digest(make([])).count() == 0


def shingles(text):
    w = blank_words(text)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 5, 0) + 1)} if w else set()


def expected_links(rows, threshold=0.8):
    docs = [(i, shingles(t)) for i, t in rows if i is not None]
    links, parent = Counter(), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(docs[a][1] & docs[b][1])
            if common and common >= threshold * len(docs[a][1] | docs[b][1]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    name = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        name[find(k)].append(i)
    out = [(i, min(name[find(k)]) if s else i, links[k]) for k, (i, s) in enumerate(docs)]
    return out + [(None, None, 0) for i, _ in rows if i is None]


def near_copies(n):
    """Chains and stars of near copies: every text differs from its neighbour in one word."""
    rng = random.Random(n)
    rows = []
    for g in range(3):
        words = [f"g{g}w{rng.randrange(200)}" for _ in range(90)]
        for k in range(n):
            if k % 3 == 0:
                words = list(words)
                words[rng.randrange(90)] = f"e{g}x{k}"
            copy = list(words)
            copy[rng.randrange(90)] = f"c{g}x{k}"
            rows.append((1000 * g + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [4, 384])
def test_links(ws, make, odd_rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = odd_rows + near_copies(14)
    got = jaccard_join.classes_and_links(make(rows), ws).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected_links(rows), key=str)
    assert max(r.n_links for r in got) > 5


def test_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    got = jaccard_join.intersections(sets)
    for a in range(70):
        for b in range(a):
            assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.9995, 96)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995
    with pytest.raises(ValueError):
        jaccard_join.choose_bands(0.1, 0.9999, 4)


def test_one_of_each(ws, make, odd_rows):
    docs = make(odd_rows)
    out = jaccard_join.one_of_each(docs, ws)
    assert out.columns == docs.columns
    rows = [(i, t) for i, t in odd_rows if i is not None]
    kept = {r for r, (i, c, _) in zip(rows, expected_links(odd_rows), strict=False) if i == c}  # repeated rows once
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([*kept, *(r for r in odd_rows if r[0] is None)], key=str)


def test_links_empty(ws, make):
    assert jaccard_join.classes_and_links(make([]), ws).count() == 0


def test_bm25(ws, make, odd_rows, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 4000)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    docs = make(odd_rows)
    index = bm25.build_index(docs, ws)
    got = defaultdict(list)
    for r in bm25.search(index, docs.where("doc_id % 4 = 0"), ws, k=7, block_bytes=3000).collect():
        got[r.query_id].append((r["rank"], r.doc_id, round(r.score, 6)))
    counts = [(i, Counter(folded_words(t))) for i, t in odd_rows]
    n, average = len(counts), sum(sum(c.values()) for _, c in counts) / len(counts)
    df = Counter(t for _, c in counts for t in c)
    asked = [(i, t) for i, t in odd_rows if i is not None and t is not None and i % 4 == 0]
    for query, text in asked:
        if query == 72:
            continue  # two texts ask under one id
        scored = []
        for i, c in counts:
            dl, total = sum(c.values()), 0.0
            for t, k in Counter(folded_words(text)).items():
                f = c[t]
                if f:
                    total += k * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / average))
            if total > 0:
                scored.append((-round(total, 9), -(1 << 63) if i is None else i, i))
        best = [(k + 1, i, round(-s, 6)) for k, (s, _, i) in enumerate(sorted(scored)[:7])]
        assert [(k, i) for k, i, _ in sorted(got[query])] == [(k, i) for k, i, _ in best]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got[query]), best, strict=True))


def test_bm25_texts_of_one_id_ask_each(ws, make, odd_rows):
    """Two texts under one id get the rows that each would get alone."""
    index = bm25.build_index(make(odd_rows), ws)
    texts = [t for i, t in odd_rows if i in (64, 200)]
    apart = [tuple(r) for t in texts for r in bm25.search(index, make([(72, t)]), ws).collect()]
    got = bm25.search(index, make([(72, t) for t in texts]), ws).collect()
    assert len(apart) == 20 and sorted(map(tuple, got), key=str) == sorted(apart, key=str)


def test_bm25_empty(ws, make):
    docs = make([])
    assert bm25.search(bm25.build_index(docs, ws), docs, ws).count() == 0


def test_components(spark, ws):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40) if i % 13] + [(100, 100 + k) for k in range(1, 200)] + [(500, 150)]
    edges += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long"), ws).collect()
    assert {r.u: r.v for r in got} == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long"), ws).count() == 0


def test_a_hot_passage_is_few_spans(spark, make):
    """A passage of 60 words in many documents, at the start, the end or inside: a few rows for each copy, not one for each window."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(900):
        own = [f"u{i}x{k}" for k in range(80)]
        at = rng.choice([0, len(own), rng.randrange(len(own))])
        rows.append((i, " ".join([*own[:at], *([passage] if i % 2 else []), *own[at:]])))
    copies = sum(i % 2 for i, _ in rows)
    spans = substring_dedup.repeated_spans(make(rows).repartition(3)).collect()
    assert len(spans) <= 10 * copies
    assert {r.doc_id for r in spans} == {i for i, _ in rows if i % 2} - {1}
    gone = {r.doc_id: r.n_removed for r in substring_dedup.digest(make(rows).repartition(3)).collect()}
    assert all(gone[i] == (60 if i % 2 and i > 1 else 0) for i, _ in rows)
