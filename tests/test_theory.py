import fixtures as X
import pytest
from conftest import UP
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.operators import theory as T


@pytest.fixture(scope="module")
def theory(spark, graph, upper):
    from quercus.workspace import Workspace

    return T.build_theory(graph({"straddle": X.STRADDLE}), upper, Workspace(spark))


def test_classes_and_disjointness(theory):
    force = theory.classes.where("label = 'Force'").first()
    assert force["kind"] == "continuant" and force["sym"] == "force"
    assert {r["sup"][-2:] for r in theory.subsumptions.collect()} == {"19", "16"}
    assert [(r["origin"]) for r in theory.disjoints.collect()] == ["bfo"]
    assert T.stats(theory).first()["disjoint_axioms"] == 1


@pytest.mark.parametrize("syntax, align", [(s, a) for s in ("prover9", "clif") for a in (False, True)])
def test_rendering(theory, syntax, align):
    rows = T.render(theory, syntax, align).orderBy("section", "sort_key").collect()
    text = "\n".join(r["line"] for r in rows)
    assert "instance_of" in text and text.count("(") == text.count(")")
    assert rows[-1]["line"] == ("end_of_list." if syntax == "prover9" else ")")
    if align:
        assert "instance_of_at" not in text


def test_verdicts_and_cross_check(spark, theory, upper, ws):
    verdicts = T.empty_classes(theory, upper, ws)
    assert [(r["label"], r["verdict"]) for r in verdicts.collect()] == [("Force", "unsatisfiable")]
    reasoner = spark.createDataFrame([("straddle", "Force")], "artifact_id string, name string")
    row = T.cross_check(verdicts, reasoner).first()
    assert row["agree"] is True and row["tested"] == 1
    assert T.cross_check(verdicts, reasoner, limit=0).first()["agree"] is None


def test_facts_do_not_cross_predicates(graph, upper, ws):
    # B is occurrent through a binary axiom, A is of unknown kind: the two do not mix.
    ex = X.EX
    t = graph({"a": [
        (ex + "A", S.SUBCLASS, UP + "0000015"), (ex + "A", S.SUBCLASS, UP + "0000019"),
        (ex + "B", S.SUBCLASS, UP + "0000015"), (ex + "B", S.SUBCLASS, UP + "0000011"),
    ]})
    verdicts = T.empty_classes(T.build_theory(t, upper, ws), upper, ws)
    assert {r["label"]: r["verdict"] for r in verdicts.collect()} == {"A": "unsatisfiable", "B": "unsatisfiable"}


def test_symbol_collisions(spark, ws):
    named = spark.createDataFrame(
        [("a", "http://x/1", "Red Car", False), ("a", "http://x/2", "red_car", False), ("a", "http://x/3", "red_car_2", False),
         ("a", "http://x/4", "Red-Car", True), ("b", "http://x/1", "Red Car", False)],
        "artifact_id string, iri string, label string, is_property boolean")
    rows = T.symbols(named, ws).where("artifact_id = 'a'").collect()
    assert len({r["sym"] for r in rows}) == 4
    assert {r["iri"]: r["sym"] for r in rows}["http://x/4"] == "red_car_3"


def test_lint_names(theory):
    assert theory.properties.count() == 0
    assert theory.classes.where(F.col("iri").startswith(UP)).count() == 2


def test_no_two_symbols_are_alike(spark, ws):
    labels = ["Red Car", "red_car", "red_car_2", "Red Car 2", "red_car_2_2", "RED-CAR", "red car 2"]
    rows = [(a, f"http://x/{i}", n, False) for a in "ab" for i, n in enumerate(labels)] + [("a", "http://x/p", "red car", True)]
    named = spark.createDataFrame(rows, "artifact_id string, iri string, label string, is_property boolean")
    got = T.symbols(named, ws).collect()
    assert len(got) == len(rows) == len({(r["artifact_id"], r["sym"]) for r in got})
    first = {r["iri"]: r["sym"] for r in got if r["artifact_id"] == "a"}
    assert first["http://x/0"] == "red_car" and first["http://x/2"] == "red_car_2"


def long_list(n, occurrents=0):
    """A disjoint list of n classes, the first ones occurrents."""
    ex = X.EX
    rows = [("_:d", S.TYPE, S.owl("AllDisjointClasses")), ("_:d", S.owl("members"), "_:c0")]
    for i in range(n):
        rows += [(f"_:c{i}", S.FIRST, f"{ex}C{i}"), (f"_:c{i}", S.REST, f"_:c{i + 1}" if i + 1 < n else S.NIL)]
    for i in range(occurrents):
        rows.append((f"{ex}C{i}", S.SUBCLASS, UP + "0000015"))
    return rows


def implied(lines, arity):
    """What the chain lines of a theory make of each class: (classes it clashes with)."""
    import re

    name = "one_of_at" if arity == 2 else "one_of"
    holder = "instance_of_at" if arity == 2 else "instance_of"
    into, off, onward = {}, {}, {}
    for line in lines:
        if f"{holder}(" not in line or f" {name}(" not in line and f"({name}(" not in line and f"-{name}(" not in line:
            continue
        cls = re.search(holder + r"\(X,([^,)]+)", line)[1]
        places = re.findall(r"(-?)" + name + r"\(X,([^,)]+)", line)
        into[cls] = places[-1][1]
        off[cls] = {p for sign, p in places if sign}
        before = [p for sign, p in places if p != into[cls]]
        if before:
            onward[before[0]] = into[cls]
    clash = set()
    for a in into:
        reached, at = set(), into[a]
        while at and at not in reached:
            reached.add(at)
            at = onward.get(at)
        clash |= {frozenset((a, b)) for b in into if b != a and off[b] & reached}
    return clash


def test_long_lists_are_chains_that_say_the_same(graph, upper, ws):
    for n, occurrents in ((20, 0), (20, 7), (20, 1), (20, 20)):
        theory = T.build_theory(graph({"a": long_list(n, occurrents)}), upper, ws)
        lines = [r["line"] for r in T.render(theory).where("section = 4").collect()]
        assert len(lines) <= 2 * n and theory.disjoints.where("origin = 'asserted'").isEmpty()
        kinds = {f"c{i}": i < occurrents for i in range(n)}
        pairs = {frozenset((a, b)) for a in kinds for b in kinds if a < b}
        both = {p for p in pairs if all(kinds[c] for c in p)}
        assert implied(lines, 2) == both and implied(lines, 3) == pairs - both
        aligned = [r["line"] for r in T.render(theory, align_bfo=True).where("section = 4").collect()]
        assert len(aligned) == n and implied(aligned, 3) == pairs
        clif = [r["line"] for r in T.render(theory, "clif").where("section = 4").collect()]
        assert len(clif) == len(lines) and all(c.count("(") == c.count(")") for c in clif)


def test_a_list_of_thousands(graph, upper, ws):
    n = 5000
    rows = long_list(n) + [(X.EX + "E", S.SUBCLASS, X.EX + "C1"), (X.EX + "E", S.SUBCLASS, X.EX + "C4000")]
    theory = T.build_theory(graph({"a": rows}), upper, ws)
    assert T.render(theory).where("section = 4").count() == n
    assert T.stats(theory).first()["disjoint_axioms"] == n * (n - 1) // 2
    assert [r["label"] for r in T.empty_classes(theory, upper, ws).where("verdict = 'unsatisfiable'").collect()] == ["E"]


def test_pair_counts_take_overlaps_out(spark):
    import itertools
    import random

    from quercus.operators.disjointness import asserted_pairs, pair_counts

    rng = random.Random(6)
    rows = []
    for a in range(20):
        for g in range(rng.randrange(1, 7)):
            members = rng.sample(range(9), rng.choice([2, 2, 3, 4, 6]))
            rows += [(f"a{a}", f"g{g}", f"m{m}") for m in members]
    rows += [("same", g, f"m{m}") for g in "xyz" for m in range(5)]
    groups = spark.createDataFrame(rows, "artifact_id string, group_id string, member string")
    want = {}
    for (a, _), members in itertools.groupby(sorted(rows), lambda r: r[:2]):
        want.setdefault(a, set()).update(itertools.combinations([m[2] for m in members], 2))
    assert {r["artifact_id"]: r["n"] for r in pair_counts(groups).collect()} == {a: len(p) for a, p in want.items()}
    assert asserted_pairs(groups).count() == sum(map(len, want.values()))
