"""Plain SQL twins of the corpus mapping and of the walks, for checking results.

Each named fragment is one common table expression; ``sql`` strings together the
ones a query needs.  Walks are recursive CTEs here, the upper ontology is
closed in SQL, and nothing is shared with the Spark operators but the fixed
values.
"""

from quercus import schema as S
from quercus.plans.starmap import (
    CONTAINED_IN, CONTAINS, EX, INVOLVES, NOTE, PLACED_BY, PRICE, SIZES, UP,
)
from quercus.sources.kernel import KERNEL_CLASSES, KERNEL_NS
from quercus.sources.upper import CLASSES, DISJOINT_GROUPS

OWL = S.OWL


def q(text):
    return "'" + text.replace("'", "''") + "'"


def _rows(source, artifact, *triples):
    """UNION ALL branches: (s, p, o[, kinds[, condition]]) with kinds such as 'iri>literal'."""
    out = []
    for s, p, o, *rest in triples:
        kinds = (rest[0] if rest else "iri>iri").split(">")
        where = f" WHERE {rest[1]}" if len(rest) > 1 else ""
        out.append(
            f"SELECT {artifact} AS artifact_id, {s} AS s, '{kinds[0]}' AS s_kind, {q(p)} AS p, "
            f"{o} AS o, '{kinds[1]}' AS o_kind FROM {source}{where}"
        )
    return out


def _ex(kind, col, mark=""):
    return f"({q(EX + kind + '/' + mark)} || {col})"


def _tbox():
    cls, kind, size = _ex("part", "p_partkey", "P"), _ex("type", "p_type"), _ex("size", "p_size", "S")
    node, big, promo = "('_:r' || p_partkey)", "p_size > 25", "p_type = 'PROMO'"
    t = lambda n: q(EX + "type/" + n)
    prop = lambda n: q(EX + "prop#" + n)
    out = _rows(
        "part", "p_brand",
        (cls, S.TYPE, q(S.CLASS)),
        (cls, S.LABEL, "p_name", "iri>literal"),
        (cls, S.SUBCLASS, kind),
        (cls, S.SUBCLASS, size, "iri>iri", big),
        (cls, S.SUBCLASS, t("SMALL"), "iri>iri", "p_type = 'MEDIUM' AND p_size >= 40"),
        (cls, S.SUBCLASS, t("PROMO"), "iri>iri", "p_type = 'STANDARD' AND p_size >= 40"),
        (cls, S.COMMENT, "p_name || ' economy'", "iri>literal", "p_type = 'ECONOMY'"),
        (cls, S.EQUIVALENT, _ex("name", "replace(p_name, ' ', '_')"), "iri>iri", f"p_type = 'SMALL' AND {big}"),
        (cls, S.SUBCLASS, node, "iri>bnode", promo),
        (node, S.TYPE, q(S.RESTRICTION), "bnode>iri", promo),
        (node, OWL + "onProperty", q(CONTAINS), "bnode>iri", promo),
        (node, OWL + "someValuesFrom", t("STANDARD"), "bnode>iri", promo),
    )
    types = "(SELECT DISTINCT p_brand, p_type FROM part)"
    out += _rows(
        types, "p_brand",
        (kind, S.TYPE, q(S.CLASS)),
        (kind, S.SUBCLASS, q(UP + "0000040"), "iri>iri", "p_type = 'ECONOMY'"),
        (kind, S.SUBCLASS, q(UP + "0000016"), "iri>iri", "p_type = 'SMALL'"),
        (kind, S.SUBCLASS, q(UP + "0000019"), "iri>iri", "p_type = 'MEDIUM'"),
        (kind, S.SUBCLASS, q(KERNEL_NS + "Agent"), "iri>iri", "p_type = 'STANDARD'"),
        (kind, S.SUBCLASS, q(KERNEL_NS + "LegalEvent"), "iri>iri", "p_type = 'PROMO'"),
    )
    brands = "(SELECT DISTINCT p_brand FROM part)"
    sizes = f"{brands}, range(1, {SIZES + 1}) AS r(n)"
    s_n = _ex("size", "n", "S")
    out += _rows(
        sizes, "p_brand",
        (s_n, S.TYPE, q(S.CLASS)),
        (s_n, S.SUBCLASS, _ex("size", "(n // 2)", "S"), "iri>iri", "n > 1"),
        (s_n, S.SUBCLASS, q(UP + "0000029"), "iri>iri", "n = 1"),
        (s_n, S.SUBCLASS, q(UP + "0000015"), "iri>iri", "n = 48"),
    )
    d, onto = "('_:d' || p_brand)", _ex("onto", "replace(p_brand, '#', '-')")
    cell = [f"('_:l{i}' || p_brand)" for i in range(3)]
    out += _rows(
        brands, "p_brand",
        (onto, S.TYPE, q(OWL + "Ontology")),
        (onto, OWL + "imports", q(EX + "onto/shared")),
        (q(CONTAINS), S.TYPE, q(S.OBJECT_PROPERTY)),
        (q(CONTAINS), S.TYPE, q(OWL + "TransitiveProperty")),
        (q(CONTAINS), S.DOMAIN, t("STANDARD")),
        (q(CONTAINS), S.RANGE, t("SMALL")),
        (q(PLACED_BY), S.TYPE, q(S.OBJECT_PROPERTY)),
        (q(PLACED_BY), OWL + "inverseOf", q(CONTAINS)),
        (q(NOTE), S.TYPE, q(S.ANNOTATION_PROPERTY)),
        (q(PRICE), S.TYPE, q(S.DATA_PROPERTY)),
        (q(PRICE), S.TYPE, q(OWL + "FunctionalProperty")),
        (q(PRICE), S.DOMAIN, t("ECONOMY")),
        (t("SMALL"), S.DISJOINT, t("MEDIUM")),
        (t("NonStandard"), S.TYPE, q(S.CLASS)),
        (t("NonStandard"), S.SUBCLASS, t("STANDARD")),
        (t("BundleOfSmallAndMediumParts"), S.TYPE, q(S.CLASS)),
        (t("BundleOfSmallAndMediumParts"), S.SUBCLASS, t("SMALL")),
        (t("QualityProcess"), S.TYPE, q(S.CLASS)),
        (t("VoidSpace"), S.TYPE, q(S.CLASS)),
        (prop("realizedQuality"), S.TYPE, q(S.OBJECT_PROPERTY)),
        (prop("realizedQuality"), S.DOMAIN, t("QualityProcess")),
        (prop("realizedQuality"), S.RANGE, t("VoidSpace")),
        (d, S.TYPE, q(OWL + "AllDisjointClasses"), "bnode>iri"),
        (d, OWL + "members", cell[0], "bnode>bnode"),
        (cell[0], S.FIRST, t("ECONOMY"), "bnode>iri"),
        (cell[0], S.REST, cell[1], "bnode>bnode"),
        (cell[1], S.FIRST, t("PROMO"), "bnode>iri"),
        (cell[1], S.REST, cell[2], "bnode>bnode"),
        (cell[2], S.FIRST, t("STANDARD"), "bnode>iri"),
        (cell[2], S.REST, q(S.NIL), "bnode>iri"),
    )
    return " UNION ALL ".join(out)


def _abox():
    nation = "('nation-' || c_nationkey)"
    cust, order = _ex("customer", "c_custkey", "C"), _ex("order", "o_orderkey", "O")
    item, seg = _ex("item", "l_partkey", "I"), _ex("segment", "c_mktsegment")
    placed = "orders JOIN customer ON o_custkey = c_custkey"
    held = (
        "(SELECT DISTINCT c_nationkey, o_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey)"
    )
    out = _rows("customer", nation, (cust, S.TYPE, seg), (cust, S.TYPE, q(S.NAMED_INDIVIDUAL)))
    out += _rows(
        placed, nation,
        (order, S.TYPE, _ex("status", "o_orderstatus")), (order, PLACED_BY, cust),
    )
    out += _rows(held, nation, (order, CONTAINS, item))
    out += _rows(
        f"(SELECT DISTINCT c_nationkey, l_partkey FROM {held}) JOIN part ON l_partkey = p_partkey", nation,
        (item, S.TYPE, _ex("type", "p_type")),
    )
    fixed = [
        (PLACED_BY, S.TYPE, S.OBJECT_PROPERTY), (PLACED_BY, S.RANGE, UP + "0000040"),
        (PLACED_BY, S.SUBPROPERTY, INVOLVES), (INVOLVES, S.TYPE, S.OBJECT_PROPERTY),
        (CONTAINS, S.TYPE, S.OBJECT_PROPERTY), (CONTAINS, S.DOMAIN, UP + "0000015"),
        (CONTAINS, S.RANGE, UP + "0000040"), (CONTAINED_IN, OWL + "inverseOf", CONTAINS),
        (CONTAINED_IN, S.TYPE, S.OBJECT_PROPERTY),
    ]
    for kind, n in (("ECONOMY", "40"), ("SMALL", "16"), ("MEDIUM", "23"), ("STANDARD", "40"), ("PROMO", "15"), ("LARGE", "")):
        fixed.append((EX + "type/" + kind, S.TYPE, S.CLASS))
        if n:
            fixed.append((EX + "type/" + kind, S.SUBCLASS, UP + "00000" + n))
    for status in "FOP":
        fixed.append((EX + "status/" + status, S.TYPE, S.CLASS))
        fixed.append((EX + "status/" + status, S.SUBCLASS, UP + "0000015"))
    out += _rows("(SELECT DISTINCT c_nationkey FROM customer)", nation, *[(q(s), p, q(o)) for s, p, o in fixed])
    out += _rows(
        "(SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)", nation,
        (seg, S.TYPE, q(S.CLASS)),
        (seg, S.SUBCLASS, q(KERNEL_NS + "Norm"), "iri>iri", "c_mktsegment = 'BUILDING'"),
        (seg, S.SUBCLASS, q(UP + "0000040"), "iri>iri", "c_mktsegment <> 'BUILDING'"),
    )
    return " UNION ALL ".join(out)


def _values(rows, columns):
    cells = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {cells}) AS v({columns})"


NAMED_EDGE = f"p = {q(S.SUBCLASS)} AND s_kind = 'iri' AND o_kind = 'iri'"
DECLARES = f"p = {q(S.TYPE)} AND o IN ({q(S.CLASS)}, {q(S.RDFS_CLASS)}) AND s_kind = 'iri'"
IS_UP = "starts_with({}, " + q(UP) + ")"


def local(c):
    """Profile variant of the local name."""
    return (
        f"CASE WHEN contains({c}, '#') THEN regexp_replace({c}, '^.*#', '') "
        f"WHEN regexp_replace({c}, '^.*/', '') <> '' THEN regexp_replace({c}, '^.*/', '') ELSE {c} END"
    )


def short(c):
    return f"regexp_replace(regexp_replace({c}, '^.*#', ''), '^.*/', '')"


def path(c):
    return f"CASE WHEN contains({c}, '#') THEN regexp_replace({c}, '^.*#', '') ELSE regexp_replace({c}, '^.*/', '') END"


def _walk(name, edges):
    up = IS_UP.format("w.node")
    return (
        f"{name}(artifact_id, cls, node) AS (SELECT artifact_id, child, parent FROM {edges} UNION "
        f"SELECT w.artifact_id, w.cls, e.parent FROM {name} w JOIN {edges} e "
        f"ON w.artifact_id = e.artifact_id AND w.node = e.child WHERE NOT {up})"
    )


def _closure(name, edges):
    return (
        f"{name}(artifact_id, child, ancestor) AS (SELECT artifact_id, child, parent FROM {edges} UNION "
        f"SELECT w.artifact_id, w.child, e.parent FROM {name} w JOIN {edges} e "
        f"ON w.artifact_id = e.artifact_id AND w.ancestor = e.child)"
    )


def _entry(name, walk):
    return f"{name} AS (SELECT artifact_id, cls, node AS upper_iri FROM {walk} WHERE {IS_UP.format('node')})"


def _k(p):
    return (UP if p.isdigit() else KERNEL_NS) + p


FRAGMENTS = {
    "tbox": ("tbox AS MATERIALIZED (" + _tbox() + ")", []),
    "abox": ("abox AS MATERIALIZED (" + _abox() + ")", []),
    "triples": ("triples AS (SELECT * FROM tbox UNION ALL SELECT * FROM abox)", ["tbox", "abox"]),
    "up_class": ("up_class AS (" + _values([(UP + i, n) for i, n, _ in CLASSES], "iri, label") + ")", []),
    "up_edge": ("up_edge AS (" + _values([(UP + i, UP + p) for i, _, p in CLASSES if p], "child, parent") + ")", []),
    "up_anc": (
        "up_anc(iri, ancestor) AS (SELECT iri, iri FROM up_class UNION "
        "SELECT a.iri, e.parent FROM up_anc a JOIN up_edge e ON a.ancestor = e.child)",
        ["up_class", "up_edge"],
    ),
    "up_dis": (
        "up_dis AS ("
        + _values([(UP + a, UP + b) for g in DISJOINT_GROUPS for a in g for b in g if a < b], "x, y")
        + ")",
        [],
    ),
    "up_clash": (
        "up_clash AS (SELECT DISTINCT least(l.iri, r.iri) AS a, greatest(l.iri, r.iri) AS b FROM up_dis "
        "JOIN up_anc l ON l.ancestor = x JOIN up_anc r ON r.ancestor = y WHERE l.iri <> r.iri)",
        ["up_anc", "up_dis"],
    ),
    "up_depth": ("up_depth AS (SELECT iri, count(*) AS n FROM up_anc GROUP BY iri)", ["up_anc"]),
    "kernel_edge": (
        "kernel_edge AS (" + _values([(KERNEL_NS + c, _k(p)) for c, _, p in KERNEL_CLASSES], "child, parent") + ")",
        [],
    ),
    "kernel_class": (
        "kernel_class AS (" + _values([(KERNEL_NS + c, n) for c, n, _ in KERNEL_CLASSES], "iri, label") + ")", []
    ),
    "edges": (f"edges AS (SELECT DISTINCT artifact_id, s AS child, o AS parent FROM tbox WHERE {NAMED_EDGE})", ["tbox"]),
    "declared": (f"declared AS (SELECT DISTINCT artifact_id, s AS cls FROM tbox WHERE {DECLARES})", ["tbox"]),
    "domain": (f"domain AS (SELECT * FROM declared WHERE NOT {IS_UP.format('cls')})", ["declared"]),
    "kreach": (
        "kreach(artifact_id, node) AS (SELECT artifact_id, n FROM (SELECT artifact_id, child AS n FROM edges UNION "
        "SELECT artifact_id, parent FROM edges UNION SELECT artifact_id, cls FROM declared) WHERE n IN "
        "(SELECT child FROM kernel_edge) UNION SELECT r.artifact_id, k.parent FROM kreach r JOIN kernel_edge k ON r.node = k.child)",
        ["edges", "declared", "kernel_edge"],
    ),
    "edges_k": (
        "edges_k AS (SELECT * FROM edges UNION SELECT r.artifact_id, k.child, k.parent FROM kreach r JOIN kernel_edge k ON r.node = k.child)",
        ["kreach"],
    ),
    "walk": (_walk("walk", "edges"), ["edges"]),
    "walk_k": (_walk("walk_k", "edges_k"), ["edges_k"]),
    "entry": (_entry("entry", "walk"), ["walk"]),
    "entry_k": (_entry("entry_k", "walk_k"), ["walk_k"]),
    "clo": (_closure("clo", "edges"), ["edges"]),
    "clo_k": (_closure("clo_k", "edges_k"), ["edges_k"]),
    "pairs": (
        "pairs AS (SELECT l.artifact_id, l.cls, c.a, c.b FROM entry l JOIN entry r ON l.artifact_id = r.artifact_id "
        "AND l.cls = r.cls JOIN up_clash c ON l.upper_iri = c.a AND r.upper_iri = c.b)",
        ["entry", "up_clash"],
    ),
    "pairs_k": (
        "pairs_k AS (SELECT l.artifact_id, l.cls, c.a, c.b FROM entry_k l JOIN entry_k r ON l.artifact_id = r.artifact_id "
        "AND l.cls = r.cls JOIN up_clash c ON l.upper_iri = c.a AND r.upper_iri = c.b)",
        ["entry_k", "up_clash"],
    ),
    "lint": (
        "lint AS (SELECT p.artifact_id, p.cls AS class_iri, " + short("p.cls") + " AS class_name, la.label AS category_a, "
        "lb.label AS category_b, p.a AS category_a_iri, p.b AS category_b_iri, "
        "CASE WHEN da.n > db.n THEN p.b WHEN da.n < db.n THEN p.a ELSE greatest(p.a, p.b) END AS drop_iri "
        f"FROM pairs p JOIN up_class la ON p.a = la.iri JOIN up_class lb ON p.b = lb.iri "
        f"JOIN up_depth da ON da.iri = p.a JOIN up_depth db ON db.iri = p.b WHERE NOT {IS_UP.format('p.cls')})",
        ["pairs", "up_class", "up_depth"],
    ),
    # artifact disjointness: the mapping has one pair and one three-member list per brand
    "dis_group": (
        "dis_group AS (SELECT artifact_id, least(s, o) || ' ' || greatest(s, o) AS group_id, unnest([s, o]) AS member FROM tbox WHERE p = "
        + q(S.DISJOINT) + " UNION ALL SELECT d.artifact_id, d.s, f.o FROM tbox d JOIN tbox f ON d.artifact_id = f.artifact_id "
        f"WHERE d.p = {q(OWL + 'members')} AND f.p = {q(S.FIRST)})",
        ["tbox"],
    ),
    "dis_pair": (
        "dis_pair AS (SELECT DISTINCT l.artifact_id, l.member AS a, r.member AS b FROM dis_group l JOIN dis_group r "
        "ON l.artifact_id = r.artifact_id AND l.group_id = r.group_id AND l.member < r.member)",
        ["dis_group"],
    ),
    # class rules: asserted edges plus both directions of equivalence
    "ruled": (
        "ruled AS (SELECT artifact_id, child, parent FROM edges UNION SELECT artifact_id, s, o FROM tbox WHERE p = "
        f"{q(S.EQUIVALENT)} AND o_kind = 'iri' UNION SELECT artifact_id, o, s FROM tbox WHERE p = {q(S.EQUIVALENT)} AND o_kind = 'iri')",
        ["edges"],
    ),
    "ruled_clo": (_closure("ruled_clo", "ruled"), ["ruled"]),
    "ruled_k": ("ruled_k AS (SELECT * FROM ruled UNION SELECT * FROM edges_k)", ["ruled", "edges_k"]),
    "ruled_k_clo": (_closure("ruled_k_clo", "ruled_k"), ["ruled_k"]),
    # restrictions that parts lie under, and the class of what their links lead to
    "linked": (
        "linked AS (SELECT DISTINCT u.artifact_id, u.s AS cls, n.o AS prop, f.o AS filler, '_:to ' || n.o || ' ' || f.o AS target "
        "FROM tbox u JOIN tbox n ON u.artifact_id = n.artifact_id AND u.o = n.s JOIN tbox f ON u.artifact_id = f.artifact_id AND u.o = f.s "
        f"WHERE u.p = {q(S.SUBCLASS)} AND u.o_kind = 'bnode' AND n.p = {q(OWL + 'onProperty')} AND f.p = {q(OWL + 'someValuesFrom')})",
        ["tbox"],
    ),
    "filler": ("filler AS (SELECT artifact_id, cls AS child, target AS parent FROM linked)", ["linked"]),
    "scoped": (
        "scoped AS (SELECT l.artifact_id, CASE WHEN d.p = " + q(S.DOMAIN) + " THEN l.cls ELSE l.target END AS child, d.o AS parent FROM linked l "
        f"JOIN tbox d ON l.artifact_id = d.artifact_id AND l.prop = d.s WHERE d.p IN ({q(S.DOMAIN)}, {q(S.RANGE)}) "
        "UNION SELECT artifact_id, target, filler FROM linked)",
        ["linked"],
    ),
    "sat": ("sat AS (SELECT * FROM ruled UNION SELECT * FROM scoped)", ["ruled", "scoped"]),
    "sat_clo": (_closure("sat_clo", "sat"), ["sat"]),
    "sat_k": ("sat_k AS (SELECT * FROM ruled_k UNION SELECT * FROM scoped)", ["ruled_k", "scoped"]),
    "sat_k_clo": (_closure("sat_k_clo", "sat_k"), ["sat_k"]),
}


def _empty(name, clo, edges):
    """Classes the rules find empty: (direct, spread) fragments over a hierarchy."""
    direct = (
        f"{name}_direct AS (SELECT DISTINCT l.artifact_id, l.child AS cls, 'upper' AS reason FROM {clo} l JOIN {clo} r "
        f"ON l.artifact_id = r.artifact_id AND l.child = r.child JOIN up_clash c ON l.ancestor = c.a AND r.ancestor = c.b "
        f"UNION SELECT artifact_id, cls, 'asserted' FROM (SELECT c.artifact_id, c.child AS cls, g.group_id, g.member FROM {clo} c "
        f"JOIN dis_group g ON c.artifact_id = g.artifact_id AND c.ancestor = g.member UNION SELECT artifact_id, member, group_id, member "
        f"FROM dis_group) GROUP BY artifact_id, cls, group_id HAVING count(*) > 1)"
    )
    spread = (
        f"{name}_spread(artifact_id, cls) AS (SELECT DISTINCT artifact_id, cls FROM {name}_direct UNION "
        f"SELECT e.artifact_id, e.child FROM {name}_spread s JOIN (SELECT artifact_id, child, parent FROM {edges} UNION SELECT * FROM filler) e "
        f"ON s.artifact_id = e.artifact_id AND s.cls = e.parent)"
    )
    final = (
        f"{name} AS (SELECT s.artifact_id, s.cls, coalesce(max(d.reason), 'inherited') AS reason FROM {name}_spread s LEFT JOIN "
        f"{name}_direct d ON s.artifact_id = d.artifact_id AND s.cls = d.cls WHERE NOT {IS_UP.format('s.cls')} AND NOT starts_with(s.cls, '_:') GROUP BY s.artifact_id, s.cls)"
    )
    return {
        f"{name}_direct": (direct, [clo, "up_clash", "dis_group"]),
        f"{name}_spread": (spread, [f"{name}_direct", edges, "filler"]),
        name: (final, [f"{name}_spread"]),
    }


# the hierarchy without the edges that a fix removes
FRAGMENTS |= {
    "gone": (
        "gone AS (SELECT DISTINCT l.artifact_id, l.class_iri AS cls, l.drop_iri FROM lint l JOIN edges e ON e.artifact_id = l.artifact_id "
        "AND e.child = l.class_iri AND e.parent = l.drop_iri)",
        ["lint", "edges"],
    ),
    "edges_f": (
        "edges_f AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.artifact_id = e.artifact_id AND g.cls = e.child AND g.drop_iri = e.parent))",
        ["edges", "gone"],
    ),
    "walk_f": (_walk("walk_f", "edges_f"), ["edges_f"]),
    "entry_f": (_entry("entry_f", "walk_f"), ["walk_f"]),
    "pairs_f": (
        "pairs_f AS (SELECT DISTINCT l.artifact_id, l.cls, c.a, c.b FROM entry_f l JOIN entry_f r ON l.artifact_id = r.artifact_id "
        f"AND l.cls = r.cls JOIN up_clash c ON l.upper_iri = c.a AND r.upper_iri = c.b WHERE NOT {IS_UP.format('l.cls')})",
        ["entry_f", "up_clash"],
    ),
    "sat_f": (
        "sat_f AS (SELECT * FROM edges_f UNION SELECT artifact_id, s, o FROM tbox WHERE p = "
        f"{q(S.EQUIVALENT)} AND o_kind = 'iri' UNION SELECT artifact_id, o, s FROM tbox WHERE p = {q(S.EQUIVALENT)} AND o_kind = 'iri' UNION SELECT * FROM scoped)",
        ["edges_f", "scoped"],
    ),
    "sat_f_clo": (_closure("sat_f_clo", "sat_f"), ["sat_f"]),
}
FRAGMENTS |= _empty("empty_f", "sat_f_clo", "sat_f")
FRAGMENTS |= _empty("empty", "sat_clo", "sat") | _empty("empty_k", "sat_k_clo", "sat_k")


def sql(body: str, *needs: str) -> str:
    """A WITH RECURSIVE statement of ``needs`` and what they rest on, then ``body``."""
    order = []

    def add(name):
        text, deps = FRAGMENTS[name]
        for d in deps:
            add(d)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    joint = ", " + body.removeprefix("WITH ") if body.startswith("WITH ") else " " + body
    return "WITH RECURSIVE " + ", ".join(FRAGMENTS[n][0] for n in order) + joint
