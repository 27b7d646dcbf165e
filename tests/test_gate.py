from threading import Event

import fixtures as X
import pytest
from conftest import UP
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.operators import repair as R
from quercus.operators.counts import counts
from quercus.operators.gate import (
    Competency, competency_findings, delta_findings, GateInputs, novel_subsumptions, stage_a, stage_b,
)
from quercus.operators.lint import straddle_lint
from quercus.operators.rules import (
    coherence, derivations, entailed_assertions, entailed_types, inconsistent_individuals, inferred_equivalences,
    inferred_subsumptions, rule_edges, unsatisfiable_classes,
)
from quercus.operators.walks import EDGE, closure
from quercus.plans.gate import check
from quercus.sources.kernel import KERNEL_NS, Kernel, builtin_kernel, kernel_from_triples
from quercus.workspace import Workspace


@pytest.fixture(scope="module")
def corpus(graph):
    return graph(X.ALL).cache()


@pytest.fixture(scope="module")
def run(corpus):
    return check(corpus, all_stages=True)


def codes(run, artifact, stage):
    rows = run.failures().where((F.col("artifact_id") == artifact) & (F.col("stage") == stage)).collect()
    return {r["code"]: r["n"] for r in rows}


def test_counts(corpus):
    got = {r["artifact_id"]: tuple(r[c] for c in S.COUNT_COLUMNS) for r in counts(corpus).collect()}
    assert got == X.COUNTS


def test_bad_artifact(run):
    assert codes(run, "bad", "A") == {
        "E_NO_AXIOMS": 1, "E_FLAT": 2, "E_NO_BFO": 1, "E_BLOATED": 1, "E_ANTIPATTERN": 3,
    }
    assert codes(run, "bad", "B") == {"E_ORPHAN": 203}
    assert codes(run, "bad", "C") == {"E_TRIVIAL": 1}
    kinds = run.findings.where("artifact_id = 'bad' AND code = 'E_ANTIPATTERN' AND stage = 'A'")
    assert kinds.where("message LIKE '%privation%'").count() == 3


def test_good_artifact_passes(run):
    assert run.failures().where("artifact_id = 'good'").count() == 0
    verdicts = dict(run.verdicts().collect())
    assert verdicts == {"good": "pass", "bad": "fail", "bare": "fail", "coherent": "fail", "straddle": "fail"}
    assert run.exit_status() == 1


def test_other_artifacts(run):
    assert codes(run, "straddle", "A") == {"E_FLAT": 1, "E_NO_BFO": 1}
    assert codes(run, "straddle", "B") == {"E_DISJOINT": 1}
    assert codes(run, "straddle", "C") == {"E_INCONSISTENT": 1}
    assert codes(run, "coherent", "A") == {"E_FLAT": 1, "E_NO_BFO": 1}
    assert codes(run, "coherent", "B") == {} and codes(run, "coherent", "C") == {}
    assert codes(run, "bare", "B") == {"E_ORPHAN": 3}
    missing = run.findings.where("code = 'E_NO_BFO' AND artifact_id = 'coherent'").first()["message"]
    assert "Occurrent, RealizableEntity, Role, GenericallyDependentContinuant." in missing


def test_halting(corpus):
    run = check(corpus)
    skipped = {(r["artifact_id"], r["stage"]): r["skipped"] for r in run.stages.collect()}
    assert skipped["bad", "B"] == "halted at A" and skipped["good", "D"] == ""
    assert "no baseline" in skipped["good", "E"]
    assert run.findings.where("artifact_id = 'bad' AND stage <> 'A'").count() == 0


def test_novel_subsumptions(graph, upper, ws):
    t = graph({"good": X.GOOD})
    g = GateInputs(t, counts(t), builtin_kernel(), upper, ws)
    entailed = closure(rule_edges(t, ws, g.edges).select(*EDGE), ws)
    n = novel_subsumptions(entailed, g.edges, g.classes, upper, ws).groupBy("cls").count().collect()
    got = {r["cls"].rsplit("#")[-1]: r["count"] for r in n}
    assert got == {
        "PaymentNorm": 2, "SignContractObligation": 2, "ContractValidity": 2, "DriverRole": 4,
        "PersonAgent": 3, "SigningEvent": 1, "ContractDispute": 2,
    }


def test_delta_invariant(graph, spark):
    base = counts(graph({"a": X.GOOD, "b": X.GOOD}))
    after = counts(graph({"a": X.BARE, "b": [t for t in X.GOOD if t[1] != S.SUBCLASS]}))
    log = spark.createDataFrame([("b", 7, 0)], "artifact_id string, n_logged bigint, n_property bigint")
    found = {(r["artifact_id"], r["code"]) for r in delta_findings(after, base, log.limit(0)).collect()}
    assert found == {("a", "E_TRIVIALIZED"), ("b", "E_OVER_RELAXED")}
    found = {(r["artifact_id"], r["code"]) for r in delta_findings(after, base, log).collect()}
    assert found == {("a", "E_TRIVIALIZED")}


def test_competency_sql_and_broken_check(graph, upper, ws):
    t = graph({"good": X.GOOD})
    g = GateInputs(t, counts(t), builtin_kernel(), upper, ws)
    checks = [
        Competency("labels", "E_COMPETENCY", "no labels", f"SELECT artifact_id, s AS offender FROM {{triples}} WHERE p = '{S.LABEL}'"),
        Competency("broken", "E_COMPETENCY", "broken", "SELECT nothing FROM nowhere"),
        Competency("late", "E_COMPETENCY", "late", "SELECT artifact_id, raise_error('no') AS offender FROM {triples}"),
        Competency("under", "E_FLAT", "under", f"SELECT DISTINCT artifact_id, child AS offender FROM {{subclass_star}} WHERE ancestor = '{S.UPPER_PREFIX}0000040'"),
        Competency("kernel", "E_BLOATED", "whole", f"SELECT DISTINCT artifact_id FROM {{triples}} WHERE s = '{KERNEL_NS}Norm'"),
    ]
    found, errors = competency_findings(g, checks)
    n = {r["code"]: r["count"] for r in found.groupBy("code").count().collect()}
    assert n["E_COMPETENCY"] == 8 and n["E_FLAT"] >= 2 and n["E_BLOATED"] == 1
    assert sorted(errors) == ["broken", "late"]


def test_every_orphan_is_a_finding(graph, upper, ws):
    t = graph({"a": [(f"{X.EX}C{i}", S.TYPE, S.CLASS) for i in range(70)]})
    g = GateInputs(t, counts(t), builtin_kernel(), upper, ws)
    assert stage_b(g).where("code = 'E_ORPHAN'").count() == 70


def test_lint_and_coherence(graph, upper, ws):
    t = graph({"straddle": X.STRADDLE, "coherent": X.COHERENT})
    found = straddle_lint(t, upper, ws).collect()
    assert [(r["class_name"], {r["category_a"], r["category_b"]}) for r in found] == [("Force", {"quality", "disposition"})]
    unsat = unsatisfiable_classes(t, upper, ws)
    status = coherence(t.select("artifact_id").distinct(), unsat, inconsistent_individuals(t, upper, ws))
    assert {r["artifact_id"]: r["coherence_status"] for r in status.collect()} == {
        "straddle": "incoherent", "coherent": "coherent",
    }


def test_unsatisfiable_by_filler_and_groups(graph, upper, ws):
    ex, some = X.EX, S.owl("someValuesFrom")
    t = graph({"a": [
        (ex + "A", S.DISJOINT, ex + "B"), (ex + "C", S.SUBCLASS, ex + "A"), (ex + "C", S.SUBCLASS, ex + "B"),
        (ex + "D", S.SUBCLASS, "_:r"), ("_:r", S.TYPE, S.RESTRICTION), ("_:r", some, ex + "C"),
        (ex + "E", S.SUBCLASS, ex + "D"), (ex + "F", S.SUBCLASS, ex + "A"),
    ]})
    rows = {r["cls"][-1]: r["reason"] for r in unsatisfiable_classes(t, upper, ws).collect()}
    assert rows == {"C": "asserted", "D": "inherited", "E": "inherited"}


def test_unsatisfiable_by_nested_fillers(graph, upper, ws):
    ex, some = X.EX, S.owl("someValuesFrom")
    t = graph({"a": [
        (ex + "A", S.DISJOINT, ex + "B"), (ex + "X", S.SUBCLASS, ex + "A"), (ex + "X", S.SUBCLASS, ex + "B"),
        (ex + "Y", S.EQUIVALENT, "_:i"), ("_:i", S.owl("intersectionOf"), "_:l0"), ("_:l0", S.FIRST, ex + "C"), ("_:l0", S.REST, "_:l1"),
        ("_:l1", S.FIRST, "_:r"), ("_:l1", S.REST, S.NIL), ("_:r", some, ex + "X"),
        (ex + "Z", S.SUBCLASS, "_:o"), ("_:o", some, "_:r"), (ex + "W", S.SUBCLASS, ex + "C"),
    ]})
    rows = {r["cls"][-1]: r["reason"] for r in unsatisfiable_classes(t, upper, ws).collect()}
    assert rows == {"X": "asserted", "Y": "inherited", "Z": "inherited"}


def test_restrictions_reach_a_fixpoint(graph, ws):
    ex = X.EX
    t = graph({"a": [
        (ex + "p", S.TYPE, S.OBJECT_PROPERTY), (ex + "G0", S.SUBCLASS, ex + "G"), (ex + "i", ex + "p", ex + "j"), (ex + "h", ex + "p", ex + "i"),
        (ex + "F", S.EQUIVALENT, "_:f"), ("_:f", S.owl("onProperty"), ex + "p"), ("_:f", S.owl("someValuesFrom"), ex + "G"),
        (ex + "E", S.EQUIVALENT, "_:e"), ("_:e", S.owl("onProperty"), ex + "p"), ("_:e", S.owl("someValuesFrom"), ex + "F"),
        (ex + "j", S.TYPE, ex + "G0"),
    ]})
    types = {(r["ind"].rsplit("/")[-1].rsplit("#")[-1], r["cls"].rsplit("/")[-1].rsplit("#")[-1]) for r in entailed_types(t, ws).collect()}
    assert types == {("j", "G0"), ("j", "G"), ("i", "F"), ("h", "E")}


def test_transitive_and_characteristic_rules(graph, upper, ws):
    ex = X.EX
    t = graph({"a": [
        (ex + "p", S.TYPE, S.OBJECT_PROPERTY), (ex + "p", S.TYPE, S.owl("TransitiveProperty")),
        (ex + "p", S.SUBPROPERTY, ex + "q"), (ex + "q", S.TYPE, S.OBJECT_PROPERTY),
        (ex + "q", S.TYPE, S.owl("IrreflexiveProperty")),
        (ex + "i", ex + "p", ex + "j"), (ex + "j", ex + "p", ex + "k"), (ex + "k", ex + "p", ex + "i"),
    ]})
    bad = {(r["ind"][-1], r["rule"]) for r in inconsistent_individuals(t, upper, ws).collect()}
    assert bad == {(x, "prp-irp") for x in "ijk"}


def test_class_expression_rules(graph, ws):
    ex = X.EX

    def listing(name, *members):
        cells = [f"_:{name}{i}" for i in range(len(members))] + [S.NIL]
        return [t for c, n, m in zip(cells, cells[1:], members) for t in ((c, S.FIRST, m), (c, S.REST, n))]

    t = graph({"a": [
        (ex + "C", S.EQUIVALENT, "_:i"), ("_:i", S.owl("intersectionOf"), "_:x0"), *listing("x", ex + "A", ex + "B"),
        (ex + "U", S.EQUIVALENT, "_:u"), ("_:u", S.owl("unionOf"), "_:y0"), *listing("y", ex + "A", ex + "D"),
        (ex + "V", S.SUBCLASS, "_:v"), ("_:v", S.owl("unionOf"), "_:z0"), *listing("z", ex + "A", ex + "D"),
        (ex + "P", S.EQUIVALENT, ex + "Q"),
    ]})
    rows = {(r["child"][-1], r["parent"][-1], r["rule"]) for r in rule_edges(t, ws).collect()}
    assert rows == {
        ("C", "A", "scm-int"), ("C", "B", "scm-int"), ("A", "U", "scm-uni"), ("D", "U", "scm-uni"),
        ("P", "Q", "scm-eqc"), ("Q", "P", "scm-eqc"),
    }


def test_derivations_tell_their_last_step(graph, ws):
    ex = X.EX
    t = graph({"a": [
        (ex + "A", S.SUBCLASS, ex + "B"), (ex + "B", S.SUBCLASS, ex + "C"), (ex + "P", S.EQUIVALENT, ex + "Q"), (ex + "Q", S.EQUIVALENT, ex + "R"),
    ]})
    ruled = ws.table(rule_edges(t, ws), "ruled")
    up = closure(ruled.select("artifact_id", "child", "parent"), ws).where("child <> ancestor")
    rows = derivations(inferred_subsumptions(t, ws, up), inferred_equivalences(t, up), ruled, up).collect()
    facts = {(r["axiom_type"], r["description"]): (r["rule"], r["supporting_facts"]) for r in rows}
    assert facts["SubClassOf", "A ⊑ C"] == ("scm-sco", "A ⊑ B; B ⊑ C")
    assert facts["SubClassOf", "P ⊑ Q"] == ("scm-eqc", "P ⊑ Q")
    assert facts["SubClassOf", "P ⊑ R"] == ("scm-eqc", "P ⊑ Q; Q ⊑ R")
    assert [k[1] for k in facts if k[0] == "EquivalentClass"] == ["P ≡ R"]


def test_individual_rules(graph, ws):
    ex = X.EX
    prop = lambda *names: [(ex + n, S.TYPE, S.OBJECT_PROPERTY) for n in names]
    t = graph({"a": prop("p", "q", "r", "s") + [
        (ex + "p", S.owl("inverseOf"), ex + "q"), (ex + "q", S.SUBPROPERTY, ex + "r"),
        (ex + "s", S.TYPE, S.owl("SymmetricProperty")), (ex + "r", S.DOMAIN, ex + "D"), (ex + "D", S.SUBCLASS, ex + "E"),
        (ex + "F", S.EQUIVALENT, "_:f"), ("_:f", S.owl("onProperty"), ex + "p"), ("_:f", S.owl("someValuesFrom"), ex + "G"),
        (ex + "H", S.EQUIVALENT, "_:h"), ("_:h", S.owl("onProperty"), ex + "s"), ("_:h", S.owl("hasValue"), ex + "j"),
        (ex + "i", ex + "p", ex + "j"), (ex + "i", ex + "s", ex + "k"), (ex + "k", ex + "s", ex + "j"), (ex + "j", S.TYPE, ex + "G"),
    ]})
    facts = {(r["s"][-1], r["p"][-1], r["o"][-1]) for r in entailed_assertions(t, ws).collect()}
    assert facts == {
        ("i", "p", "j"), ("j", "q", "i"), ("j", "r", "i"), ("i", "s", "k"), ("k", "s", "i"), ("k", "s", "j"), ("j", "s", "k"),
    }
    types = {(r["ind"][-1], r["cls"][-1], r["rule"]) for r in entailed_types(t, ws).collect()}
    assert types == {
        ("j", "G", "asserted"), ("j", "D", "prp-dom"), ("j", "E", "cax-sco"), ("i", "F", "cls-svf1"), ("k", "H", "cls-hv2"),
    }


def test_kernel_from_triples(spark, graph):
    kernel = builtin_kernel()
    assert kernel.size == 10 and len(kernel.categories) == 7 and len(kernel.contradiction_types) == 3
    rows = [(c, S.TYPE, S.CLASS) for c in kernel.labels] + [(c, S.LABEL, n) for c, n in kernel.labels.items()]
    rows += [(c, S.SUBCLASS, p) for c, p in kernel.edges] + [("urn:k", S.owl("versionInfo"), "kernel/0.1")]
    again = kernel_from_triples(spark, graph({"k": rows}))
    assert again.size == 10 and again.version == "kernel/0.1"
    assert {tuple(r) for r in again.category_table(spark).collect()} == {tuple(r) for r in kernel.category_table(spark).collect()}
    assert {tuple(r) for r in again.upward_table(spark).collect()} == {tuple(r) for r in kernel.upward_table(spark).collect()}
    assert {r["iri"] for r in again.contradictions.collect()} == kernel.contradiction_types
    assert again.totals().first().asDict() == {"version": "kernel/0.1", "classes": 10, "categories": 7, "contradiction_types": 3}


def test_fix_and_requests(graph, spark, upper, ws):
    t = graph({"straddle": X.STRADDLE, "coherent": X.COHERENT})
    found = straddle_lint(t, upper, ws)
    fixed, removed = R.fix_all(t, found)
    assert [tuple(r)[1:3] for r in removed.collect()] == [(X.EX + "Force", UP + "0000019")]
    assert straddle_lint(fixed, upper, Workspace(spark)).count() == 0
    asked = spark.createDataFrame(
        [("straddle", X.EX + "Force", UP + "0000016"), ("straddle", X.EX + "Force", "http://ex/x"),
         ("coherent", X.EX + "Wing", UP + "0000019")], "artifact_id string, cls string, drop_iri string")
    out = {(r["artifact_id"], r["drop_iri"]): r["reason"] for r in R.judge_requests(asked, t).collect()}
    assert out == {("straddle", UP + "0000016"): "", ("straddle", "http://ex/x"): R.NOT_UPPER,
                   ("coherent", UP + "0000019"): R.NOT_THERE}


def test_drop_choice(upper):
    quality, disposition = UP + "0000019", UP + "0000016"
    assert upper.drop_of(quality, disposition) == upper.drop_of(disposition, quality) == quality
    assert upper.drop_of(UP + "0000002", UP + "0000003") == UP + "0000003"


def test_repair_end_to_end(graph, spark, upper, ws):
    # GOOD plus one straddling class passes A, fails B, and is repaired within its budget.
    broken = X.GOOD + X.cls(X.EX + "Force", UP + "0000019", UP + "0000016")
    hopeless = broken + X.cls(X.EX + "Torque", UP + "0000019", UP + "0000016")
    t = graph({"good": X.GOOD, "broken": broken, "hopeless": hopeless, "straddle": X.STRADDLE})
    run = R.repair(t, upper, ws)
    status = {r["artifact_id"]: (r["status"], r["error"]) for r in run.status.collect()}
    # "straddle" fails stage A already, and such artifacts are left alone.
    assert status["good"][0] == status["straddle"][0] == "unchanged"
    assert status["broken"] == ("repaired", None)
    assert status["hopeless"] == ("failed", "E_OVER_RELAXED")
    assert {r["artifact_id"] for r in run.triples.select("artifact_id").distinct().collect()} == {"broken"}
    log = run.quarantine.where("artifact_id = 'broken'").first()
    assert log["axiom"] == "SubClassOf(Force BFO_0000019)" and log["core"] == [UP + "0000016", UP + "0000019"]


def test_empty_kernel(graph, upper, ws):
    t = graph({"coherent": X.COHERENT})
    g = GateInputs(t, counts(t), Kernel({}, frozenset()), upper, ws)
    assert stage_b(g).count() == 0


def test_stream_checks_artifacts_whole(spark, graph, tmp_path):
    """Files of one artifact that come in different batches, or in a later run, count as one artifact."""
    from quercus.sources.ntriples import line_text
    from quercus.streaming.gate_stream import current, gate_stream

    drop, out, state = (str(tmp_path / n) for n in ("drop", "out", "state"))
    triples = graph({"a#1": X.COHERENT, "b": X.STRADDLE, "c": X.BARE})
    lines = triples.select("artifact_id", line_text().alias("value"))
    run = check(triples)

    def rows(reports, findings):
        return (
            sorted((r["artifact_id"], r["verdict"], r["counts"]["classes"], r["counts"]["axioms"]) for r in reports.collect()),
            sorted(map(str, findings.select("artifact_id", "code").collect())),
        )

    classes = lines.value.contains("Class>")
    lines.where(classes).coalesce(1).write.partitionBy("artifact_id").text(drop)
    lines.where(~classes).repartition(3).write.mode("append").partitionBy("artifact_id").text(drop)
    gate_stream(spark, drop, out, state, files_per_batch=5).awaitTermination()
    assert spark.read.parquet(out + "/artifacts").select("batch").distinct().count() > 1
    expected = rows(run.reports(), run.findings)
    assert rows(current(spark, out, "reports"), current(spark, out, "findings")) == expected
    more = spark.createDataFrame([("b", "<http://x/Late> <" + S.TYPE + "> <" + S.CLASS + "> ."), ("b", "broken")], "artifact_id string, value string")
    more.coalesce(1).write.mode("append").partitionBy("artifact_id").text(drop)
    gate_stream(spark, drop, out, state, files_per_batch=5).awaitTermination()
    found = {r["artifact_id"]: r["counts"]["classes"] for r in current(spark, out, "reports").collect()}
    assert found == {"a#1": 4, "b": 4, "c": 3} and current(spark, out, "errors").count() == 1


def test_trivial_artifacts_with_and_without_entry_points(graph, upper, ws):
    """Entry points decide most artifacts; one that says its categories' ancestors itself, and one without any, need the closure."""
    from quercus.operators.gate import plainly_novel, stage_c

    own = X.cls(X.EX + "A", UP + "0000001")
    spelled = X.cls(X.EX + "A", UP + "0000002") + [(UP + "0000002", S.SUBCLASS, UP + "0000001")]
    rising = X.cls(X.EX + "A", UP + "0000004") + [(UP + "0000019", S.SUBCLASS, UP + "0000020")]
    flat = X.cls(X.EX + "A", X.EX + "B") + X.cls(X.EX + "B")
    equal = X.cls(X.EX + "A") + X.cls(X.EX + "B") + [(X.EX + "A", S.EQUIVALENT, X.EX + "B")]
    t = graph({"root": own, "spelled": spelled, "rising": rising, "flat": flat, "equal": equal, "coherent": X.COHERENT})
    g = GateInputs(t, counts(t), builtin_kernel(), upper, ws)
    assert {r["artifact_id"] for r in plainly_novel(g).collect()} == {"coherent"}
    found = {r["artifact_id"] for r in stage_c(g).where("code = 'E_TRIVIAL'").collect()}
    assert found == {"root", "spelled", "flat"}


def test_fixes_are_published_as_versions(graph, upper, ws):
    from quercus.plans.analysis import publish_fixes

    t = graph({"straddle": X.STRADDLE, "coherent": X.COHERENT})
    out = publish_fixes(t, straddle_lint(t, upper, ws), upper, ws)
    assert [(r["parent_id"], r["artifact_id"], r["removed"], r["refused"]) for r in out.lineage.collect()] == [("straddle", "straddle.autofixed", 1, None)]
    row = out.analysis.rows.first()
    assert row["artifact_id"] == "straddle.autofixed" and row["lint_findings"] == 0 and row["coherence_status"] == "coherent"
    assert out.triples.count() == t.where("artifact_id = 'straddle'").count() - 1


def test_gate_inputs_are_written_when_asked_for(graph, upper, ws, monkeypatch):
    names, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, partition_by=None: names.append(name) or write(self, df, name, partition_by))
    g = GateInputs.of(graph({"good": X.GOOD}), builtin_kernel(), upper, ws)
    assert sorted(names) == ["classes", "counts", "edges"]
    assert stage_a(g).count() == 0 and "entries" in names and "reach" not in names


def test_expressions_are_read_beside_the_edges(graph, upper, ws, monkeypatch):
    """The edges wait for the property paths here: reasoning begins without them, and all who need them take the same table."""
    names, read, in_time, write = [], Event(), [], Workspace.write

    def noted(self, df, name, partition_by=None):
        names.append(name)
        if name == "edges":
            in_time.append(read.wait(60))
        out = write(self, df, name, partition_by)
        if name == "paths":
            read.set()
        return out

    monkeypatch.setattr(Workspace, "write", noted)
    g = GateInputs.of(graph({"good": X.GOOD, "bad": X.STRADDLE}), builtin_kernel(), upper, ws, "unsat", "entries", "reach")
    assert in_time == [True]
    assert all(names.count(n) == 1 for n in ("classes", "counts", "edges", "entries", "reach", "unsat"))
    assert {r["artifact_id"] for r in g.unsat.collect()} == {"bad"}
