import random
from collections import Counter

import pytest
from conftest import UP
from pyspark.sql import Window
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.operators import walks as W
from quercus.operators.disjointness import asserted_pairs, disjoint_groups, list_members
from quercus.operators.gate import GateInputs, first_novel, novelty
from quercus.operators.ranking import grouped_rank
from quercus.operators.rules import first_inferred, rule_edges
from quercus.operators.walks import ancestors_once, closure
from quercus.sources.kernel import builtin_kernel
from quercus.sources.upper import builtin_upper, upper_from_triples
from quercus.workspace import Workspace


def edges_of(spark, pairs):
    return spark.createDataFrame(
        [("a", f"n{c}", f"n{p}") for c, p in pairs], "artifact_id string, child string, parent string")


def brute_closure(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    out = set()
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += up.get(n, ())
        out |= {(f"n{start}", f"n{n}") for n in seen}
    return out


def got(df):
    return {(r["child"], r["ancestor"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_graphs(spark, ws, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    assert got(W.closure(edges_of(spark, pairs), ws)) == brute_closure(pairs)


def test_closure_of_cycle_and_long_chain(spark, ws):
    pairs = {(0, 1), (1, 2), (2, 0), (3, 0)}
    assert got(W.closure(edges_of(spark, pairs), ws)) == brute_closure(pairs)
    chain = {(i, i + 1) for i in range(25)}
    assert got(W.closure(edges_of(spark, chain), ws)) == brute_closure(chain)


def test_long_chain_takes_few_rounds(spark, ws):
    """A chain of 5,000 classes, one fact at its top and one half way down."""
    n = 5000
    links = spark.range(n).selectExpr(
        "'a' AS artifact_id", "concat('n', id + 1) AS child", "concat('n', id) AS parent",
        f"CASE WHEN id = 0 THEN 'top' WHEN id = {n // 2} THEN 'middle' END AS value",
    )
    before = ws._n
    found = W.propagate(links, ws).groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in found} == {"top": n, "middle": n // 2}
    assert ws._n - before <= 1 + 14  # the links, and a table of facts and shortcuts each round


@pytest.mark.parametrize("seed", range(2))
def test_closure_of_equivalences_in_chains_and_hubs(spark, ws, seed):
    rng = random.Random(seed)
    alike = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(50 + i, 51 + i) for i in range(9)] + [(70, 60 + i) for i in range(8)]
    pairs = {(a, b) for a, b in alike} | {(b, a) for a, b in alike} | {(rng.randrange(75), rng.randrange(75)) for _ in range(30)}
    found = W.closure(edges_of(spark, pairs), ws).collect()
    assert {(r["child"], r["ancestor"]) for r in found} == brute_closure(pairs) and len(found) == len(brute_closure(pairs))


def test_an_ended_list_takes_no_further_round(graph, ws):
    cells = [t for i in range(4) for t in ((f"_:l{i}", S.FIRST, f"urn:m{i}"), (f"_:l{i}", S.REST, f"_:l{i + 1}" if i < 3 else S.NIL))]
    t = graph({"a": cells})
    before = ws._n
    found = list_members(t, t.where(f"s = '_:l0' AND p = '{S.FIRST}'").selectExpr("artifact_id", "'x' AS owner", "s AS head"), ws)
    assert {(r["member"], r["position"]) for r in found.collect()} == {(f"urn:m{i}", i) for i in range(4)}
    assert ws._n - before <= 6  # cells and jumps of three rounds


def test_many_classes_equivalent_to_one_write_no_squares(spark, ws):
    """A hub and 600 classes that are its equals, one fact above the hub."""
    n, sizes, write = 600, [], ws.write
    hub = spark.range(n).selectExpr("concat('n', id) AS node").selectExpr(
        "'a' AS artifact_id", "inline(array(named_struct('child', node, 'parent', 'hub'), named_struct('child', 'hub', 'parent', node)))", "CAST(NULL AS STRING) AS value")
    links = hub.union(spark.sql("SELECT 'a', 'hub', CAST(NULL AS STRING), 'x'"))

    def counted(*args, **kw):
        out = write(*args, **kw)
        sizes.append(out[1])
        return out

    ws.write = counted
    assert W.propagate(links, ws).where("value = 'x'").select("node").distinct().count() == n + 1
    assert max(sizes) <= 4 * n  # the square would be 360,000


def test_reaches_is_reflexive(spark, ws):
    found = W.reaches(edges_of(spark, {(1, 2), (2, 3), (4, 4), (5, 6)}), ["n3", "n4", "n5", "n9"], ws)
    assert {(r["cls"], r["target"]) for r in found.collect()} == {("n1", "n3"), ("n2", "n3"), ("n3", "n3"), ("n4", "n4"), ("n5", "n5")}


def test_flat_and_empty_hierarchies(spark, ws):
    flat = {(i, 100) for i in range(5)}
    assert got(W.closure(edges_of(spark, flat), ws)) == brute_closure(flat)
    assert W.closure(edges_of(spark, []), ws).count() == 0


def test_walk_stops_at_the_upper_ontology(spark, ws):
    rows = [("a", "x", UP + "0000019"), ("a", UP + "0000019", "y"), ("a", "y", UP + "0000015"), ("a", "z", "x")]
    found = W.entry_points(spark.createDataFrame(rows, "artifact_id string, child string, parent string"), ws)
    pairs = {(r["cls"], r["upper_iri"][-2:]) for r in found.collect()}
    assert pairs == {("x", "19"), ("z", "19"), ("y", "15"), (UP + "0000019", "15")}


def test_upper_sizes(spark, upper):
    assert len(upper.labels) == 36 and sum(map(len, upper.parents.values())) == 35
    assert upper.ancestor_table(spark).count() == 157
    assert len(upper.disjoint) == 26 and upper.clash_table(spark).count() == 506
    assert (UP + "0000016", UP + "0000019") in upper.clashes


def upper_rows(u):
    rows = [(i, S.TYPE, S.CLASS) for i in u.labels] + [(i, S.LABEL, n) for i, n in u.labels.items()]
    rows += [(c, S.SUBCLASS, p) for c, ps in u.parents.items() for p in ps]
    return rows + [(a, S.DISJOINT, b) for a, b in u.disjoint]


def test_upper_from_triples(spark, graph, ws):
    u = builtin_upper()
    again = upper_from_triples(spark, graph({"bfo": upper_rows(u)}), ws)
    assert {r["iri"]: r["label"] for r in again.labels.collect()} == u.labels
    assert again.ancestors.count() == 157 and again.edges.count() == 35
    pairs = spark.createDataFrame([(a, b, 1) for a in u.labels for b in u.labels if a < b], "a string, b string, n int")
    key = lambda df: sorted(map(str, df.select("a", "b", "n", "label_a", "label_b", "clash_case", "drop_iri").collect()))
    assert key(again.clashing(pairs)) == key(u.clashing(pairs)) and again.clashing(pairs).count() == 506
    among = sorted(u.labels)[:12]
    sides = {tuple(r) for r in again.clash_sides(spark, among).collect()}
    assert sides == {tuple(r) for r in u.clash_sides(spark).collect() if r[0] in among and r[1] in among}


def test_a_large_upper_ontology(spark, ws):
    """20,000 categories in a tree, with disjoint siblings: read as tables, and the lint runs on it."""
    from quercus.operators.lint import straddle_lint

    n = 20_000
    name = f"concat('{UP}', lpad(id, 7, '0'))"
    rows = spark.range(1, n).selectExpr(
        "'u' AS artifact_id", f"{name} AS s", "'iri' AS s_kind",
        f"inline(array(struct('{S.TYPE}' AS p, '{S.CLASS}' AS o), struct('{S.SUBCLASS}' AS p, concat('{UP}', lpad(id div 4, 7, '0')) AS o)))",
        "'iri' AS o_kind", "CAST(NULL AS STRING) AS o_datatype", "CAST(NULL AS STRING) AS o_lang",
    )
    apart = spark.range(1, n // 4).where("id % 3 = 0").selectExpr(
        "'u' AS artifact_id", f"concat('{UP}', lpad(id * 4, 7, '0')) AS s", "'iri' AS s_kind", f"'{S.DISJOINT}' AS p",
        f"concat('{UP}', lpad(id * 4 + 1, 7, '0')) AS o", "'iri' AS o_kind", "CAST(NULL AS STRING) AS o_datatype", "CAST(NULL AS STRING) AS o_lang",
    )
    big = upper_from_triples(spark, rows.union(apart), ws)
    assert big.labels.count() == n - 1

    def up(i):
        out = {i}
        while i:
            i //= 4
            out.add(i)
        return out - {0}

    def clash(a, b):
        return any(x // 4 == y // 4 and (x // 4) % 3 == 0 and x // 4 and {x % 4, y % 4} == {0, 1} and x // 4 < n // 4 for x in up(a) for y in up(b))

    rng = random.Random(1)
    triples, want = [], set()
    for i in range(400):
        g = rng.randrange(3, n // 64, 3)
        a, b = rng.choice([(16 * g + rng.randrange(4), 16 * g + 4 + rng.randrange(4)), (rng.randrange(1, n), rng.randrange(1, n))])
        triples += [(f"http://ex/c{i}", f"{UP}{a:07d}"), (f"http://ex/c{i}", f"{UP}{b:07d}")]
        if clash(a, b):
            want.add(f"http://ex/c{i}")
    t = spark.createDataFrame([("a", s, "iri", S.SUBCLASS, o, "iri", None, None) for s, o in triples], S.TRIPLES)
    assert len(want) > 50 and {r["class_iri"] for r in straddle_lint(t, big, ws).collect()} == want


def test_disjoint_lists(graph, ws):
    def listing(name, members):
        out = [(f"_:{name}", S.TYPE, S.owl("AllDisjointClasses")), (f"_:{name}", S.owl("members"), f"_:{name}0")]
        for i, m in enumerate(members):
            rest = f"_:{name}{i + 1}" if i + 1 < len(members) else S.NIL
            out += [(f"_:{name}{i}", S.FIRST, m), (f"_:{name}{i}", S.REST, rest)]
        return out

    n = 90
    t = graph({"a": listing("s", [f"http://ex/{c}" for c in "abc"]) + listing("l", [f"http://ex/{i:03d}" for i in range(n)])})
    groups = disjoint_groups(t, ws)
    assert groups.count() == 3 + n
    pairs = {(r["a"], r["b"]) for r in asserted_pairs(groups).collect()}
    assert {(a[-1], b[-1]) for a, b in pairs if len(a) < 12} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert len(pairs) == 3 + n * (n - 1) // 2


def test_long_list_in_few_rounds(spark, ws):
    n = 5000
    cells = spark.range(n).selectExpr(
        "'a' AS artifact_id", "concat('_:c', id) AS s", "'bnode' AS s_kind",
        f"inline(array(struct('{S.FIRST}' AS p, concat('http://ex/', id) AS o, 'iri' AS o_kind), "
        f"struct('{S.REST}' AS p, IF(id = {n - 1}, '{S.NIL}', concat('_:c', id + 1)) AS o, 'bnode' AS o_kind)))",
    ).selectExpr("*", "CAST(NULL AS STRING) AS o_datatype", "CAST(NULL AS STRING) AS o_lang")
    heads = spark.createDataFrame([("a", "x", "_:c0"), ("a", "tail", "_:c4990")], "artifact_id string, owner string, head string")
    before = ws._n
    found = list_members(cells, heads, ws).groupBy("owner").count().collect()
    assert {r["owner"]: r["count"] for r in found} == {"x": n, "tail": 10}
    assert ws._n - before <= 2 * 15


def test_circular_list(spark, ws, graph):
    t = graph({"a": [("_:0", S.FIRST, "http://x/0"), ("_:0", S.REST, "_:1"), ("_:1", S.FIRST, "http://x/1"), ("_:1", S.REST, "_:0")]})
    heads = spark.createDataFrame([("a", "x", "_:1")], "artifact_id string, owner string, head string")
    assert sorted(r["member"][-1] for r in list_members(t, heads, ws).collect()) == ["0", "1"]


def test_grouped_rank_equals_window(spark, ws):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", rng.randrange(10**6), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    ranked = grouped_rank(df, ["g"], ["x", "i"], ws)
    w = Window.partitionBy("g").orderBy("x", "i")
    expected = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    assert ranked.select("g", "x", "i", "rank").exceptAll(expected).count() == 0
    assert ranked.count() == 4000


def test_a_workspace_goes_when_told(spark):
    ws = W.Workspace(spark)
    table = ws.table(spark.range(3), "x")
    assert table.count() == 3
    ws.remove()
    path = spark._jvm.org.apache.hadoop.fs.Path(ws.root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_a_closure_that_is_not_spelled_out(spark, ws):
    rng = random.Random(7)
    for n, m in ((6, 9), (9, 20), (5, 4)):
        pairs = {(f"c{rng.randrange(n)}", f"c{rng.randrange(n)}") for _ in range(m)} | {("c0", "c1"), ("c1", "c0")}
        edges = spark.createDataFrame([("a", c, p) for c, p in pairs], "artifact_id string, child string, parent string")
        full = {(r["child"], r["ancestor"]) for r in closure(edges, ws).collect() if r["child"] != r["ancestor"]}
        once = ancestors_once(edges, ws)
        assert {(r["child"], r["ancestor"]) for r in once.rows().collect()} == full
        some = spark.createDataFrame([("a", "c0"), ("a", "c3")], "artifact_id string, child string")
        assert {(r["child"], r["ancestor"]) for r in once.rows(some).collect()} == {x for x in full if x[0] in ("c0", "c3")}
        assert {r["child"]: r["n"] for r in once.counts().where("n > 0").collect()} == Counter(c for c, _ in full)


def test_equals_are_counted_not_paired(spark, graph, upper, ws, monkeypatch):
    n, rows, write = 60, [], Workspace.write
    t = graph({"a": [(f"urn:c{i:03d}", S.EQUIVALENT, "urn:hub") for i in range(n)] + [(f"urn:c{i:03d}", S.TYPE, S.CLASS) for i in range(n)]})

    def counted(self, df, name, partition_by=None):
        path, k = write(self, df, name, partition_by)
        rows.append(k)
        return path, k

    monkeypatch.setattr(Workspace, "write", counted)
    got = first_inferred(t, 100, ws).collect()
    assert len(got) == 100 and {r["total"] for r in got} == {n * (n + 1)}
    assert [(r["child"], r["ancestor"]) for r in sorted(got)][:2] == [("urn:c000", "urn:c001"), ("urn:c000", "urn:c002")]
    g = GateInputs.of(t, builtin_kernel(), upper, ws)
    news = novelty(rule_edges(t, ws, g.edges), g)
    assert {r["n"] for r in news.counts().collect()} == {n} and first_novel(news, ws).count() == 5 * n
    assert max(rows) <= 6 * n, "no table holds every pair of equals"
