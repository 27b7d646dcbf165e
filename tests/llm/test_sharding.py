"""Differencing against the best partitions, and shards read back whole."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np

from quercus.llm import sharding


def spread(sizes, shard, shards):
    sums = np.bincount(shard, weights=sizes, minlength=shards)
    return int(sums.max() - sums.min())


def test_differencing():
    assert sharding.difference([], 3).tolist() == [] and sharding.difference([5], 3).tolist() == [0]
    assert spread([8, 7, 6, 5, 4], sharding.difference([8, 7, 6, 5, 4], 2), 2) == 2  # the textbook case
    rng = random.Random(1)
    for _ in range(30):  # near the best of all partitions of few items
        sizes = [rng.randrange(1, 60) for _ in range(8)]
        best = min(spread(sizes, np.array(p), 3) for p in itertools.product(range(3), repeat=8))
        assert spread(sizes, sharding.difference(sizes, 3), 3) <= best + max(sizes) // 2
    sizes = [rng.randrange(1, 5000) for _ in range(20_000)]
    assert spread(sizes, sharding.difference(sizes, 40), 40) <= 5
    assert spread([10**6, *sizes[:50]], sharding.difference([10**6, *sizes[:50]], 4), 4) > 0


def read_back(spark, ws, documents, **how):
    path = ws.path("shards")
    sharding.write(documents, path, ws, **how)
    return path, sharding.digest(spark, path, sharding.document_type(documents)).collect()


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), crc(t)) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of_text[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in of_text.values())


def test_shards(spark, ws, make, odd_rows):
    rng = random.Random(4)
    rows = odd_rows + [(500 + i, "".join(rng.choice("abcdefg é") for _ in range(rng.randrange(200)))) for i in range(600)]
    for how in ({"shards": 7}, {"shards": 7, "grains": 3}, {"shards": 1}, {}):
        path, got = read_back(spark, ws, make(rows).repartition(6), **how)
        check(rows, got, how.get("shards", 40))
    totals = defaultdict(int)
    _, got = read_back(spark, ws, make(rows), shards=5)
    for r in got:
        totals[r.shard] += r.size
    # the long text of the odd rows stands alone; the others are even
    assert len(totals) == 5 and sorted(totals.values())[3] - min(totals.values()) <= 200


def test_documents_come_back_with_all_columns(spark, ws, make, odd_rows):
    documents = make(odd_rows).withColumnRenamed("score", "shard").withColumnRenamed("edges", "document")
    path = ws.path("shards")
    sharding.write(documents, path, ws, shards=3)
    back = sharding.read(spark, path, sharding.document_type(documents)).select("document.*")
    assert back.columns == documents.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, documents.collect()))


def test_one_text_in_a_third_of_the_rows(spark, ws, make):
    rows = [(i, "the same text") for i in range(1000)] + [(i, f"text {i} " * (i % 9 + 1)) for i in range(1000, 3000)] + [(5, None)] * 300
    path, got = read_back(spark, ws, make(rows).repartition(8), shards=10)
    check(rows, got, 10)


def test_empty_table(spark, ws, make):
    assert read_back(spark, ws, make([]))[1] == []
