"""The pipeline's stages on the small tables, each against a plain reading of its contract."""

import pytest
from .llm_helpers import SF_SMALL as SF
from .llm_helpers import blank_words, folded_words

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from quercus.llm.registry import QUERIES


@pytest.fixture(scope="module")
def steps(spark):
    from quercus.workspace import Workspace

    ws, docs = Workspace(spark), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(ws.table(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    for s in steps[1:-1]:
        assert s.where("n_chars <> length(text)").count() == 0


def test_toxic_documents_go(spark, steps):
    verdicts = {r.doc_id: r.predicted for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert rows(steps[1]) == {i: t for i, t in rows(steps[0]).items() if not verdicts[i]}


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    assert set(after.items()) <= set(before.items())

    def grams(t):
        w = blank_words(t)
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 5, 0) + 1)} if w else set()

    kept = [(i, grams(t)) for i, t in after.items()]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) > 0
    assert not any(alike(a, b) for k, (_, a) in enumerate(kept) for _, b in kept[:k])
    everything = {i: grams(t) for i, t in before.items()}
    for i in set(before) - set(after):  # what went has a partner
        assert any(alike(everything[i], everything[j]) for j in before if j != i)


def test_repeats_are_cut(steps):
    before, after = rows(steps[2]), rows(steps[3])
    first = {}
    for i in sorted(before):
        w = blank_words(before[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in before.items():
        w, gone = blank_words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        left = [x for k, x in enumerate(w) if k not in gone]
        if not gone:
            assert after[i] == t
        elif left:
            assert blank_words(after[i]) == left
        else:
            assert i not in after


def test_benchmark_is_cut(spark, steps):
    before, after = rows(steps[3]), rows(steps[4])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = folded_words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 10, 0) + 1) if w}
    for i, t in before.items():
        w, gone = folded_words(t), set()
        for k in range(len(w)):
            if tuple(w[k : k + 10]) in windows:
                gone |= set(range(k, k + 10))
        left = [x for k, x in enumerate(w) if k not in gone]
        assert (after[i] == t) if not gone else (folded_words(after[i]) == left if left else i not in after)


def test_packing_takes_everything(steps):
    pieces = steps[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == set(rows(steps[4]))
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in QUERIES) != 1] == []
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql()
