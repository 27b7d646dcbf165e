"""Classifiers: exact neighbours, folds, defined cases, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from .llm_helpers import SF_ACCURACY

from quercus.llm import quality, toxicity
from quercus.llm.labelled import Isotonic, held_out, sample


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    n, terms = 300, 40
    dense = np.where(rng.random((n, terms)) < 0.15, rng.random((n, terms)), 0)
    dense[200:210] = dense[0]  # ties
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    example, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.of(example, term, dense[example, term], n, terms)
    for q in range(0, n, 7):
        t = np.flatnonzero(dense[q])
        sim, near = index.nearest(t, dense[q, t], 9)
        full = dense @ dense[q]
        want = np.lexsort((np.arange(n), -np.round(full, 12)))[:9]
        want = want[full[want] > 0]
        assert near.tolist() == want.tolist()
        assert np.allclose(sim, full[want])


def test_blocked_votes_are_exact():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (rng.random(900) < 0.4).astype(int)
    model = quality.Model([], np.zeros(0), np.zeros((0, 8), np.float32))
    model.learn(x, y, np.where(y == 1, 2.0, 1.0))
    for q in range(0, 900, 100):
        sim = x @ x[q]
        near = np.argsort(-sim)[: quality.NEIGHBOURS]
        pull = np.maximum(sim[near], 0).astype(float) ** quality.SHARPNESS * np.where(y[near] == 1, 2.0, 1.0)
        assert model.votes(x[q : q + 1])[0] == pytest.approx((pull * y[near]).sum() / pull.sum(), rel=1e-4)


def test_isotonic():
    rng = np.random.default_rng(1)
    votes = rng.random(400)
    y = (rng.random(400) < votes).astype(int)
    fit = Isotonic(votes, y, np.ones(400))
    got = fit(np.linspace(0, 1, 50))
    assert (np.diff(got) >= -1e-12).all() and 0 <= got.min() and got.max() <= 1
    assert fit(np.array([0.9]))[0] > fit(np.array([0.1]))[0]
    assert Isotonic(np.zeros(0), np.zeros(0), np.zeros(0))(np.array([0.3])).tolist() == [0.0]


def test_folds(spark, make):
    rows = make([(i, "") for i in range(200)] + [(None, "x")])
    for r in rows.select("doc_id", held_out(5, 0).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_sample_is_bounded_and_blind(spark, ws, make):
    docs = make([(i, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, None) for i in range(300)] + [(1, 1, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    table, totals = sample(docs, labels, "toxic", held_out(5, 0), 20, ws)
    got = table.collect()
    assert len(got) == 40 and sum(r.label for r in got) == 20
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    assert sum(totals.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))


def test_forms():
    assert [quality.form(w) for w in ("The", "THE!!", "x%%%", "a1b22", "É!!", "...", "|")] == ["Aa", "A!", "a%", "a0a0", "A!", ".", "|"]
    doc, term, count, names = quality.form_terms(pa.array(["Ing Ing Ing", None, "", "a b"]))
    found = {(int(d), names[t]): int(c) for d, t, c in zip(doc, term, count, strict=True)}
    assert found == {(0, "Aa"): 3, (0, "Aa Aa"): 2, (0, "="): 2, (3, "a"): 2, (3, "a a"): 1}


@pytest.mark.parametrize("digest", [toxicity.digest, quality.digest])
def test_defined_cases(spark, ws, make, odd_rows, digest):
    docs = make(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = digest(docs, none, ws).collect()
    assert len(got) == len(odd_rows) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert digest(make([]), none, ws).count() == 0
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in odd_rows if i], "doc_id long, quality int, toxic int")
    got = digest(docs, labels, ws).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    base = {t: set() for _, t in odd_rows}
    for r, (_, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(odd_rows, key=lambda r: str(r[0])), strict=True):
        if r.doc_id != 72 and r.doc_id is not None:
            base[t].add(r.score)
    assert all(len(s) <= 1 for s in base.values())  # a score depends on the text alone


@pytest.mark.parametrize("digest, label, least", [(toxicity.digest, "toxic", 0.8), (quality.digest, "quality", 0.97)])
def test_held_out_accuracy(spark, ws, digest, label, least):
    docs, labels = (spark.read.parquet(f"{SF_ACCURACY}/{t}.parquet") for t in ("documents", "labels"))
    got = digest(docs, labels, ws).join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    hit = {v: [r.predicted == v for r in got if r[label] == v] for v in (0, 1)}
    assert sum(map(sum, hit.values())) / 2 and np.mean([np.mean(h) for h in hit.values()]) >= least


def test_evidence_names_labelled_neighbours(spark, ws):
    docs, labels = (spark.read.parquet(f"{SF_ACCURACY}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(docs, labels, ws).where("predicted = 1").select("evidence").collect()
    known = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert got and all(r.evidence and set(r.evidence) <= known for r in got)
