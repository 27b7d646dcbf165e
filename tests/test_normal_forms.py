"""Class expressions: saturation against a plain fixpoint, and the forms that no edge between names can say."""

import itertools
import random

import pytest
from fixtures import EX

from quercus import schema as S
from quercus.operators.normal_forms import expression_hierarchy
from quercus.operators.premises import axiom_premises, cardinality_errors, cardinality_premises
from quercus.operators.rules import entailed_assertions, entailed_types, inconsistent_individuals, unsatisfiable_classes
from quercus.workspace import Workspace

O = S.owl  # noqa: E741


def listed(node, p, members):
    """Triples of an RDF list under (node, p)."""
    cells = [f"_:{node.strip('_:').rsplit('/')[-1].rsplit('#')[-1]}-{i}" for i in range(len(members))]
    out = [(node, p, cells[0])]
    for i, (c, m) in enumerate(zip(cells, members, strict=True)):
        out += [(c, S.FIRST, m), (c, S.REST, cells[i + 1] if i + 1 < len(cells) else S.NIL)]
    return out


def some(node, p, filler):
    return [(node, O("onProperty"), EX + p), (node, O("someValuesFrom"), filler)]


def short(x):
    return x.rsplit("/")[-1].rsplit("#")[-1]


# -- a random ontology and its plain fixpoint ---------------------------------------


def ontology(seed):
    rng = random.Random(seed)
    names, props = [EX + c for c in "ABCDEF"], ["p", "q", "t"]
    nodes, triples, shape = list(names), [], {}
    for k in range(rng.randrange(3, 8)):
        node, kind = f"_:x{seed}{k}", rng.choice(["some", "some", "and", "or", "not"])
        if kind == "some":
            shape[node] = ("some", rng.choice(props), rng.choice([*nodes, S.THING]))
            triples += some(node, *shape[node][1:])
        elif kind == "not":
            shape[node] = ("not", rng.choice(names))
            triples.append((node, O("complementOf"), shape[node][1]))
        else:
            members = rng.sample(nodes, rng.randrange(2, 4))
            shape[node] = (kind, members)
            triples += listed(node, O("intersectionOf" if kind == "and" else "unionOf"), members)
        nodes.append(node)
    told = []
    for _ in range(rng.randrange(5, 12)):
        a, b = rng.sample(nodes, 2)
        told.append((a, b))
        triples.append((a, S.SUBCLASS, b))
        if rng.random() < 0.2:
            told.append((b, a))
            triples[-1] = (a, S.EQUIVALENT, b)
    apart = [tuple(rng.sample(names, 2)) for _ in range(2)]
    triples += [(a, S.DISJOINT, b) for a, b in apart]
    bottom = [rng.choice(names)] if rng.random() < 0.3 else []
    triples += [(a, S.SUBCLASS, S.NOTHING) for a in bottom]
    roles = {(p, p) for p in props}
    if rng.random() < 0.7:
        triples.append((EX + "p", S.SUBPROPERTY, EX + "q"))
        roles.add(("p", "q"))
    if rng.random() < 0.5:
        triples.append((EX + "t", S.SUBPROPERTY, EX + "q"))
        roles.add(("t", "q"))
    triples.append((EX + "t", S.TYPE, O("TransitiveProperty")))
    domain = {(rng.choice(props), rng.choice(names))} if rng.random() < 0.6 else set()
    range_ = {(rng.choice(props), rng.choice(names))} if rng.random() < 0.6 else set()
    triples += [(EX + p, S.DOMAIN, c) for p, c in domain] + [(EX + p, S.RANGE, c) for p, c in range_]
    return triples, (names, nodes, shape, told, apart, bottom, roles, domain, range_)


def fixpoint(names, nodes, shape, told, apart, bottom, roles, domain, range_):
    """(strict subsumptions between names, empty names)."""
    links = {n: s for n, s in shape.items() if s[0] == "some"}
    under = {(n, n) for n in nodes} | set(told) | {(a, S.NOTHING) for a in bottom}
    for n, s in shape.items():
        if s[0] == "and":
            under |= {(n, m) for m in s[1]}
        if s[0] == "or":
            under |= {(m, n) for m in s[1]}
        if s[0] == "some":
            target = s[1:]
            under |= {(target, target), (target, s[2])}
            under |= {(n, c) for q, c in domain if (s[1], q) in roles} | {(target, c) for q, c in range_ if (s[1], q) in roles}
    while True:
        new = {(a, d) for a, b in under for c, d in under if b == c}
        for n, s in shape.items():
            if s[0] == "and":
                new |= {(x, n) for x, _ in under if all((x, m) in under for m in s[1])}
        for (x, (_, p, f)), (y, (_, q, g)) in itertools.product(links.items(), repeat=2):
            if (p, q) in roles and ((p, f), g) in under | {((p, f), S.THING)}:
                new.add((x, y))
            # x leads to y, both by t: x has a t-link to where y leads
            if (p, "t") in roles and (q, "t") in roles and ((p, f), y) in under:
                new |= {(x, z) for z, (_, r, h) in links.items() if ("t", r) in roles and ((q, g), h) in under}
        if new <= under:
            break
        under |= new
    empty = {x for x, y in under if y == S.NOTHING}
    empty |= {x for x, _ in under for a, b in apart if (x, a) in under and (x, b) in under}
    empty |= {x for x, _ in under for n, s in shape.items() if s[0] == "not" and (x, n) in under and (x, s[1]) in under}
    while True:
        more = {x for x, y in under if y in empty} | {n for n, s in links.items() if s[1:] in empty}
        more |= {n for n, s in shape.items() if s[0] == "or" and all(m in empty for m in s[1])}
        if more <= empty:
            break
        empty |= more
    return {(a, b) for a, b in under if a in names and b in names and a != b}, {e for e in empty if e in names}


def test_saturation_of_random_ontologies(graph, upper, ws):
    made = {f"o{i}": ontology(i) for i in range(40)}
    t = graph({a: triples for a, (triples, _) in made.items()})
    hierarchy = expression_hierarchy(t, ws)[2].collect()
    empty = unsatisfiable_classes(t, upper, ws).collect()
    some_empty = 0
    for a, (_, model) in made.items():
        subsumed, gone = fixpoint(*model)
        names = model[0]
        found = {(r["child"], r["ancestor"]) for r in hierarchy if r["artifact_id"] == a}
        assert {(c, p) for c, p in found if c in names and p in names and c != p} == subsumed, a
        assert {r["cls"] for r in empty if r["artifact_id"] == a} == gone, a
        some_empty += len(gone)
    assert some_empty > 20


# -- unsatisfiable classes ----------------------------------------------------------


def test_empty_by_nothing_complement_and_clashing_filler(graph, upper, ws):
    t = graph({"a": [
        (EX + "N", S.SUBCLASS, S.NOTHING), (EX + "M", S.SUBCLASS, EX + "N"),
        (EX + "X", S.SUBCLASS, EX + "A"), (EX + "X", S.SUBCLASS, "_:c"), ("_:c", O("complementOf"), EX + "A"),
        (EX + "A", S.DISJOINT, EX + "B"), (EX + "Y", S.SUBCLASS, "_:r"), *some("_:r", "p", "_:i"), *listed("_:i", O("intersectionOf"), [EX + "A", EX + "B"]),
        (EX + "Z", S.SUBCLASS, "_:s"), *some("_:s", "p", EX + "A"),
    ]})
    rows = {short(r["cls"]): r["reason"] for r in unsatisfiable_classes(t, upper, ws).collect()}
    assert rows == {"N": "asserted", "M": "asserted", "X": "asserted", "Y": "inherited"}


def test_empty_by_cardinality_and_disjoint_union(graph, upper, ws):
    t = graph({"a": [
        (EX + "N", S.SUBCLASS, S.NOTHING), (EX + "C", S.SUBCLASS, "_:m"), ("_:m", O("onProperty"), EX + "p"),
        ("_:m", O("qualifiedCardinality"), "2"), ("_:m", O("onClass"), EX + "N"),
        (EX + "D", S.SUBCLASS, "_:n"), ("_:n", O("onProperty"), EX + "p"), ("_:n", O("minQualifiedCardinality"), "0"), ("_:n", O("onClass"), EX + "N"),
        *listed(EX + "U", O("disjointUnionOf"), [EX + "V", EX + "W"]), (EX + "E", S.SUBCLASS, EX + "V"), (EX + "E", S.SUBCLASS, EX + "W"),
    ]})
    rows = {short(r["cls"]): r["reason"] for r in unsatisfiable_classes(t, upper, ws).collect()}
    assert rows == {"N": "asserted", "C": "inherited", "E": "asserted"}


# -- individuals --------------------------------------------------------------------


def types(t, ws):
    return {(short(r["ind"]), short(r["cls"])) for r in entailed_types(t, ws).collect()}


@pytest.mark.parametrize("axiom", [S.SUBCLASS, S.EQUIVALENT])
def test_expression_as_subject(graph, ws, axiom):
    t = graph({"a": [
        (EX + "p", S.TYPE, S.OBJECT_PROPERTY), ("_:r", axiom, EX + "F"), *some("_:r", "p", EX + "G"),
        (EX + "i", EX + "p", EX + "j"), (EX + "j", S.TYPE, EX + "G"),
    ]})
    assert types(t, ws) == {("j", "G"), ("i", "F")}


def test_members_of_an_intersection(graph, ws):
    t = graph({"a": [
        ("_:i", S.SUBCLASS, EX + "C"), *listed("_:i", O("intersectionOf"), [EX + "A", "_:r"]), *some("_:r", "p", S.THING),
        (EX + "p", S.TYPE, S.OBJECT_PROPERTY), (EX + "x", S.TYPE, EX + "A"), (EX + "x", EX + "p", EX + "y"), (EX + "z", S.TYPE, EX + "A"),
        (EX + "w", S.TYPE, "_:i"),
    ]})
    assert types(t, ws) == {("x", "A"), ("x", "C"), ("z", "A"), ("w", "A"), ("w", "C")}


def test_clashes_of_individuals(graph, upper, ws):
    t = graph({"a": [
        (EX + "x", S.TYPE, EX + "A"), (EX + "x", S.TYPE, "_:c"), ("_:c", O("complementOf"), EX + "A"), (EX + "N", S.SUBCLASS, S.NOTHING),
        (EX + "y", S.TYPE, EX + "N"), (EX + "z", S.TYPE, EX + "A"),
    ]})
    assert {(short(r["ind"]), r["rule"]) for r in inconsistent_individuals(t, upper, ws).collect()} == {("x", "cls-com"), ("y", "cls-nothing2")}


def test_property_chains(graph, ws):
    t = graph({"a": [
        *[(EX + p, S.TYPE, S.OBJECT_PROPERTY) for p in "pqrs"], *listed(EX + "s", O("propertyChainAxiom"), [EX + "p", EX + "q", EX + "p"]),
        *listed(EX + "q", O("propertyChainAxiom"), [EX + "s", EX + "r"]),
        (EX + "1", EX + "p", EX + "2"), (EX + "2", EX + "q", EX + "3"), (EX + "3", EX + "p", EX + "4"), (EX + "4", EX + "r", EX + "5"),
        (EX + "0", EX + "p", EX + "1"), (EX + "5", EX + "p", EX + "6"),
    ]})
    found = {(short(r["s"]), short(r["p"]), short(r["o"])) for r in entailed_assertions(t, ws).where("rule = 'prp-spo2'").collect()}
    assert found == {("1", "s", "4"), ("1", "q", "5"), ("0", "s", "6")}
    rows = [r["fol"] for r in axiom_premises(t, ws).where("premise_type = 'PropertyChain'").collect()]
    assert "∀x0,x1,x2,x3: (p(x0,x1) ∧ q(x1,x2) ∧ p(x2,x3)) → s(x0,x3)" in rows and len(rows) == 2


# -- cardinality premises -----------------------------------------------------------


def test_cardinalities_of_any_kind(graph):
    rows = []
    for i, (kind, n) in enumerate([("minCardinality", "2"), ("maxCardinality", "3000000"), ("cardinality", "two"), ("maxCardinality", "-1"), ("cardinality", "9"), ("maxCardinality", "0")]):
        rows += [(f"{EX}C{i}", S.SUBCLASS, f"_:r{i}"), (f"_:r{i}", O("onProperty"), EX + "p"), (f"_:r{i}", O(kind), n)]
    t = graph({"a": rows})
    fol = {r["description"].split()[0]: r["fol"] for r in cardinality_premises(t).collect()}
    assert fol == {
        "C0": "∀x: C0(x) → ∃y1,y2: p(x,y1) ∧ p(x,y2) ∧ y1 ≠ y2", "C1": "∀x: C1(x) → ∃≤3000000 y: p(x,y)",
        "C4": "∀x: C4(x) → ∃=9 y: p(x,y)", "C5": "∀x: C5(x) → ¬∃y: p(x,y)",
    }
    assert {(r["node"].rsplit(":")[-1], r["value"]) for r in cardinality_errors(t).collect()} == {("r2", "two"), ("r3", "-1")}


def test_restrictions_that_say_the_same_are_not_related_pair_by_pair(graph, ws):
    """200 restrictions of one property and filler: none of them is listed above the others."""
    n = 200
    triples = [(EX + "A", S.TYPE, S.CLASS), (EX + "D", S.TYPE, S.CLASS), (EX + "p", S.DOMAIN, EX + "D")]
    for i in range(n):
        triples += [(f"{EX}c{i}", S.SUBCLASS, f"_:r{i}"), (f"_:r{i}", S.owl("onProperty"), EX + "p"), (f"_:r{i}", S.owl("someValuesFrom"), EX + "A")]
    hierarchy = expression_hierarchy(graph({"a": triples}), ws)[2]
    assert hierarchy.where(f"ancestor = '{EX}D' AND child LIKE '{EX}c%'").count() == n
    assert hierarchy.count() <= 6 * n


def test_restrictions_of_like_meaning_are_a_star_from_the_start(graph, ws):
    """A walk writes its equals once: no round of joins has to find their smallest."""
    triples, names, write = [(EX + "A", S.TYPE, S.CLASS)], [], ws.write
    for i in range(5):
        triples += [(f"{EX}c{i}", S.SUBCLASS, f"_:r{i}"), (f"_:r{i}", S.owl("onProperty"), EX + "p"), (f"_:r{i}", S.owl("someValuesFrom"), EX + "A")]

    def named(df, name, *args, **kw):
        names.append(name)
        return write(df, name, *args, **kw)

    ws.write = named
    expression_hierarchy(graph({"a": triples}), ws)[2].count()
    assert names.count("alike") <= names.count("links")


def test_intersections_of_the_same_members_are_one(graph, ws):
    """80 fillers that are the intersection of A and B: no edges between each two of them."""
    n = 80
    triples = [(EX + "A", S.TYPE, S.CLASS), (EX + "N", S.EQUIVALENT, "_:n")]
    for i, owner in enumerate(["_:n", *[f"_:y{i}" for i in range(n)]]):
        triples += [(owner, S.owl("intersectionOf"), f"_:h{i}"), (f"_:h{i}", S.FIRST, EX + "A"), (f"_:h{i}", S.REST, f"_:t{i}"),
                    (f"_:t{i}", S.FIRST, EX + "B"), (f"_:t{i}", S.REST, S.NIL)]
    for i in range(n):
        triples += [(f"{EX}c{i}", S.SUBCLASS, f"_:r{i}"), (f"_:r{i}", S.owl("onProperty"), EX + "p"), (f"_:r{i}", S.owl("someValuesFrom"), f"_:y{i}")]
    triples += [(EX + "M", S.SUBCLASS, EX + "A"), (EX + "M", S.SUBCLASS, EX + "B"), (EX + "Q", S.EQUIVALENT, "_:q"), ("_:q", S.owl("onProperty"), EX + "p"),
                ("_:q", S.owl("someValuesFrom"), EX + "N")]
    _, edges, hierarchy = expression_hierarchy(graph({"a": triples}), ws)
    assert hierarchy.where(f"ancestor = '{EX}Q' AND child LIKE '{EX}c%'").count() == n
    assert hierarchy.where(f"ancestor = '{EX}N' AND child = '{EX}M'").count() == 1
    assert edges.count() < 20 * n  # every two of them would be 6,400


def names_written(monkeypatch):
    names, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, partition_by=None: names.append(name) or write(self, df, name, partition_by))
    return names


def test_emptiness_is_not_walked_over_the_classes(graph, upper, ws, monkeypatch):
    x, y, z, u = "_:x", "_:y", "_:z", "_:u"
    t = [(EX + "E", S.SUBCLASS, S.NOTHING), (EX + "A", S.SUBCLASS, x), *some(x, "p", EX + "E"), (EX + "B", S.SUBCLASS, EX + "A"), (EX + "F", S.SUBCLASS, EX + "G")]
    names = names_written(monkeypatch)
    plain = {(short(r["cls"]), r["reason"]) for r in unsatisfiable_classes(graph({"a": t}), upper, ws).collect()}
    assert plain == {("E", "asserted"), ("A", "inherited"), ("B", "inherited")}
    assert names.count("links") == 2, "one walk over the properties, one over the classes"
    # a link to what links to something empty, a union of both, and a link to the union
    t += [(EX + "C", S.SUBCLASS, y), *some(y, "p", EX + "B"), (u, S.EQUIVALENT, EX + "U"), *listed(u, O("unionOf"), [EX + "C", EX + "E"])]
    t += [(EX + "D", S.SUBCLASS, z), *some(z, "q", EX + "U"), (EX + "H", S.SUBCLASS, EX + "D")]
    found = {short(r["cls"]) for r in unsatisfiable_classes(graph({"a": t}), upper, ws).collect()}
    assert found == set("EABCUDH")


def test_only_telling_properties_are_asserted(graph, upper, ws, monkeypatch):
    t = [(EX + p, S.TYPE, S.OBJECT_PROPERTY) for p in ("p", "q")] + [(EX + "p", S.DOMAIN, S.NOTHING), (EX + "q", S.SUBPROPERTY, EX + "p"), (EX + "i", EX + "q", EX + "j")]
    kept, table = {}, Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: kept.setdefault(name, table(self, df, name)))
    assert [short(r["ind"]) for r in inconsistent_individuals(graph({"a": t}), upper, ws).collect()] == ["i"]
    assert {short(r["p"]) for r in kept["entailed-assertions"].collect()} == {"p"}


def test_links_do_not_meet_every_filler_of_their_property(graph, ws, monkeypatch):
    """60 links and 60 restrictions of one property, each to a class of its own: links times restrictions are never rows."""
    n, t = 60, [(EX + "p", S.TYPE, S.OBJECT_PROPERTY), (EX + "q", S.TYPE, S.OBJECT_PROPERTY), (EX + "q", S.SUBPROPERTY, EX + "p")]
    for i in range(n):
        t += [(f"_:r{i}", S.SUBCLASS, f"{EX}F{i}"), *some(f"_:r{i}", "p", f"{EX}G{i}"), (f"{EX}i{i}", EX + ("q" if i % 2 else "p"), f"{EX}j{i}"), (f"{EX}j{i}", S.TYPE, f"{EX}G{i}")]
    t += [("_:s", S.SUBCLASS, EX + "E"), *some("_:s", "p", EX + "F0"), (EX + "k", EX + "p", EX + "i0")]
    written, table = [], Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: written.append((name, made := table(self, df, name))) or made)
    assert types(graph({"a": t}), ws) == {*((f"j{i}", f"G{i}") for i in range(n)), *((f"i{i}", f"F{i}") for i in range(n)), ("k", "E")}
    assert max(df.count() for name, df in written if name in ("restricted", "types")) < 4 * n


def test_classes_are_not_listed_under_every_union(graph, upper, ws, monkeypatch):
    """40 unions over a class with 40 subclasses: unions times subclasses are never rows, and emptiness still goes through unions and links."""
    n, t = 40, [(EX + "E", S.SUBCLASS, S.NOTHING), (EX + "H", S.SUBCLASS, EX + "T")]
    for i in range(n):
        t += [(f"{EX}c{i}", S.SUBCLASS, EX + "H"), (f"{EX}d{i}", S.SUBCLASS, f"_:u{i}"), *listed(f"_:u{i}", O("unionOf"), [EX + "H", EX + "E"])]
    t += [(EX + "U", S.EQUIVALENT, "_:w"), *listed("_:w", O("unionOf"), [EX + "A", EX + "E"]), (EX + "A", S.SUBCLASS, "_:x"), *some("_:x", "p", EX + "B"), (EX + "B", S.SUBCLASS, EX + "E"),
          (EX + "V", S.SUBCLASS, "_:y"), *some("_:y", "p", EX + "W"), (EX + "W", S.EQUIVALENT, "_:z"), *listed("_:z", O("unionOf"), [EX + "U", EX + "B"])]
    written, table = [], Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: written.append((name, made := table(self, df, name))) or made)
    rows = {short(r["cls"]): r["reason"] for r in unsatisfiable_classes(graph({"a": t}), upper, ws).collect()}
    assert rows == {"E": "asserted", "B": "asserted", "A": "inherited", "U": "inherited", "W": "inherited", "V": "inherited"}
    assert max(df.count() for name, df in written if name == "under") < 10 * n


def test_types_make_no_assertions_that_tell_nothing(graph, ws, monkeypatch):
    """Domains and ranges are read off the links as they stand, rewritten to the telling properties only, and no table of all assertions is made."""
    t = [(EX + p, S.TYPE, S.OBJECT_PROPERTY) for p in ("p", "q", "r")]
    t += [(EX + "p", S.DOMAIN, EX + "D"), (EX + "p", S.RANGE, EX + "R"), (EX + "q", S.SUBPROPERTY, EX + "p"), (EX + "r", O("inverseOf"), EX + "p"), (EX + "D", S.SUBCLASS, EX + "C")]
    t += [(EX + "i", EX + "q", EX + "j"), (EX + "i", EX + "p", EX + "j"), (EX + "k", EX + "r", EX + "l"), (EX + "i", S.TYPE, EX + "D"), (EX + "i", EX + "q", EX + "j")]
    want = {("i", "D", "asserted"), ("i", "C", "cax-sco"), ("j", "R", "prp-rng"), ("l", "D", "prp-dom"), ("l", "C", "cax-sco"), ("k", "R", "prp-rng")}

    def found(triples):
        rows = [(short(r["ind"]), short(r["cls"]), r["rule"]) for r in entailed_types(graph({"a": triples}), ws).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    with monkeypatch.context() as m:
        m.setattr("quercus.operators.rules.entailed_assertions", lambda *_: pytest.fail("all assertions were made"))
        assert found(t) == want
    # links of a transitive property are found by all of them
    t += [(EX + "t", S.TYPE, S.OBJECT_PROPERTY), (EX + "t", S.TYPE, O("TransitiveProperty")), (EX + "t", S.SUBPROPERTY, EX + "p"), (EX + "m", EX + "t", EX + "n")]
    assert found(t) == want | {("m", "D", "prp-dom"), ("m", "C", "cax-sco"), ("n", "R", "prp-rng")}


def test_individuals_clash_without_every_filler_of_their_property(graph, upper, ws, monkeypatch):
    """30 links and 30 restrictions of one property, each to a class of its own, that make their subjects clash."""
    n, t = 30, [(EX + "p", S.TYPE, S.OBJECT_PROPERTY), (EX + "F", S.DISJOINT, EX + "H")]
    for i in range(n):
        t += [(f"_:r{i}", S.SUBCLASS, EX + "F"), *some(f"_:r{i}", "p", f"{EX}G{i}"), (f"{EX}i{i}", EX + "p", f"{EX}j{i}"), (f"{EX}j{i}", S.TYPE, f"{EX}G{i}"), (f"{EX}i{i}", S.TYPE, EX + "H")]
    written, table = [], Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: written.append((name, made := table(self, df, name))) or made)
    assert {(short(r["ind"]), r["rule"]) for r in inconsistent_individuals(graph({"a": t}), upper, ws).collect()} == {(f"i{i}", "cax-dw") for i in range(n)}
    assert max(df.count() for name, df in written if name in ("restricted", "types")) < 6 * n
