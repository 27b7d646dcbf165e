"""The star-schema tables seen as an RDF corpus.

Three kinds of artifact come out of them: one class-level artifact per part brand
(``tbox``), one individual-level artifact per customer nation (``abox``), and one with class
expressions of every form per brand (``expr``), whose SQL says by key what has to follow.
Every source row takes part; each source table is scanned once and its triples
are laid out with ``inline``.  The SQL twin of these rules is in
``plans/oracles.py``.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.sources.kernel import KERNEL_NS
from quercus.workspace import Workspace, dealt, spread

EX = "http://example.org/"
UP = S.UPPER_PREFIX
CONTAINS, PLACED_BY, NOTE, PRICE = (EX + "prop#" + n for n in ("contains", "placedBy", "note", "price"))
CONTAINED_IN, INVOLVES = EX + "prop#containedIn", EX + "prop#involves"
SIZES = 50
#: How many triples a part gives in the class-level corpus, or in that of expressions, at most.
PART_ROWS, EXPRESSION_ROWS = 8, 12


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _t(s, p, o, o_kind="iri", s_kind="iri", when=None):
    """One triple as SQL text; ``s`` and ``o`` are SQL expressions."""
    row = f"named_struct('s', {s}, 's_kind', '{s_kind}', 'p', '{p}', 'o', {o}, 'o_kind', '{o_kind}')"
    return row if when is None else f"if({when}, {row}, NULL)"


def _iri(text):
    return f"'{text}'"


def _ex(kind, column, mark=""):
    return f"concat('{EX}{kind}/{mark}', {column})"


def _lay_out(df: DataFrame, artifact: str, rows) -> DataFrame:
    return df.selectExpr(
        f"{artifact} AS artifact_id", f"inline(filter(array({', '.join(rows)}), r -> r IS NOT NULL))"
    ).selectExpr(
        "artifact_id", "s", "s_kind", "p", "o", "o_kind",
        "CAST(NULL AS STRING) AS o_datatype", "CAST(NULL AS STRING) AS o_lang",
    )


def tbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-level artifacts, one per brand."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    laid = spread(part, PART_ROWS, "p_partkey")
    cls, kind, size = _ex("part", "p_partkey", "P"), _ex("type", "p_type"), _ex("size", "p_size", "S")
    node = "concat('_:r', p_partkey)"
    promo, big = "p_type = 'PROMO'", "p_size > 25"
    small, promoted = _iri(EX + "type/SMALL"), _iri(EX + "type/PROMO")
    named = _ex("name", "replace(p_name, ' ', '_')")
    parts = _lay_out(
        laid,
        "p_brand",
        [
            _t(cls, S.TYPE, _iri(S.CLASS)),
            _t(cls, S.LABEL, "p_name", "literal"),
            _t(cls, S.SUBCLASS, kind),
            _t(cls, S.SUBCLASS, size, when=big),
            _t(cls, S.SUBCLASS, small, when="p_type = 'MEDIUM' AND p_size >= 40"),
            _t(cls, S.SUBCLASS, promoted, when="p_type = 'STANDARD' AND p_size >= 40"),
            _t(cls, S.COMMENT, "concat(p_name, ' economy')", "literal", when="p_type = 'ECONOMY'"),
            _t(cls, S.EQUIVALENT, named, when=f"p_type = 'SMALL' AND {big}"),
            _t(cls, S.SUBCLASS, node, "bnode", when=promo),
            _t(node, S.TYPE, _iri(S.RESTRICTION), s_kind="bnode", when=promo),
            _t(node, S.owl("onProperty"), _iri(CONTAINS), s_kind="bnode", when=promo),
            _t(node, S.owl("someValuesFrom"), _iri(EX + "type/STANDARD"), s_kind="bnode", when=promo),
        ],
    )
    grounded = {
        "ECONOMY": UP + "0000040", "SMALL": UP + "0000016", "MEDIUM": UP + "0000019",
        "STANDARD": KERNEL_NS + "Agent", "PROMO": KERNEL_NS + "LegalEvent",
    }
    kinds = _lay_out(
        part.select("p_brand", "p_type").distinct(),
        "p_brand",
        [_t(kind, S.TYPE, _iri(S.CLASS))]
        + [_t(kind, S.SUBCLASS, _iri(up), when=f"p_type = '{k}'") for k, up in grounded.items()],
    )
    brands = part.select("p_brand").distinct()
    s_n = _ex("size", "n", "S")
    sizes = _lay_out(
        brands.selectExpr("p_brand", f"explode(sequence(1, {SIZES})) AS n"),
        "p_brand",
        [
            _t(s_n, S.TYPE, _iri(S.CLASS)),
            _t(s_n, S.SUBCLASS, _ex("size", "n div 2", "S"), when="n > 1"),
            _t(s_n, S.SUBCLASS, _iri(UP + "0000029"), when="n = 1"),
            _t(s_n, S.SUBCLASS, _iri(UP + "0000015"), when="n = 48"),
        ],
    )
    d, onto = "concat('_:d', p_brand)", _ex("onto", "replace(p_brand, '#', '-')")
    cell = [f"concat('_:l{i}', p_brand)" for i in range(3)]
    quality, void = _iri(EX + "type/QualityProcess"), _iri(EX + "type/VoidSpace")
    contains, placed, price = _iri(CONTAINS), _iri(PLACED_BY), _iri(PRICE)
    realized = _iri(EX + "prop#realizedQuality")
    non, bundle = _iri(EX + "type/NonStandard"), _iri(EX + "type/BundleOfSmallAndMediumParts")
    shared = _lay_out(
        brands,
        "p_brand",
        [
            _t(onto, S.TYPE, _iri(S.owl("Ontology"))),
            _t(onto, S.owl("imports"), _iri(EX + "onto/shared")),
            _t(contains, S.TYPE, _iri(S.OBJECT_PROPERTY)),
            _t(contains, S.TYPE, _iri(S.owl("TransitiveProperty"))),
            _t(contains, S.DOMAIN, _iri(EX + "type/STANDARD")),
            _t(contains, S.RANGE, small),
            _t(placed, S.TYPE, _iri(S.OBJECT_PROPERTY)),
            _t(placed, S.owl("inverseOf"), contains),
            _t(_iri(NOTE), S.TYPE, _iri(S.ANNOTATION_PROPERTY)),
            _t(price, S.TYPE, _iri(S.DATA_PROPERTY)),
            _t(price, S.TYPE, _iri(S.owl("FunctionalProperty"))),
            _t(price, S.DOMAIN, _iri(EX + "type/ECONOMY")),
            _t(small, S.DISJOINT, _iri(EX + "type/MEDIUM")),
            _t(non, S.TYPE, _iri(S.CLASS)),
            _t(non, S.SUBCLASS, _iri(EX + "type/STANDARD")),
            _t(bundle, S.TYPE, _iri(S.CLASS)),
            _t(bundle, S.SUBCLASS, small),
            _t(quality, S.TYPE, _iri(S.CLASS)),
            _t(void, S.TYPE, _iri(S.CLASS)),
            _t(realized, S.TYPE, _iri(S.OBJECT_PROPERTY)),
            _t(realized, S.DOMAIN, quality),
            _t(realized, S.RANGE, void),
            _t(d, S.TYPE, _iri(S.owl("AllDisjointClasses")), s_kind="bnode"),
            _t(d, S.owl("members"), cell[0], "bnode", "bnode"),
            _t(cell[0], S.FIRST, _iri(EX + "type/ECONOMY"), s_kind="bnode"),
            _t(cell[0], S.REST, cell[1], "bnode", "bnode"),
            _t(cell[1], S.FIRST, promoted, s_kind="bnode"),
            _t(cell[1], S.REST, cell[2], "bnode", "bnode"),
            _t(cell[2], S.FIRST, _iri(EX + "type/STANDARD"), s_kind="bnode"),
            _t(cell[2], S.REST, _iri(S.NIL), s_kind="bnode"),
        ],
    )
    return parts.union(kinds).union(sizes).union(shared)


def abox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual-level artifacts, one per customer nation."""
    nation = "concat('nation-', c_nationkey)"
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")

    cust, order = _ex("customer", "c_custkey", "C"), _ex("order", "o_orderkey", "O")
    item, segment = _ex("item", "l_partkey", "I"), _ex("segment", "c_mktsegment")
    customers = _lay_out(
        customer,
        nation,
        [_t(cust, S.TYPE, segment), _t(cust, S.TYPE, _iri(S.NAMED_INDIVIDUAL))],
    )
    lines = line.count()
    placed = dealt(orders, lines, "o_custkey").join(
        dealt(customer.select("c_custkey", "c_nationkey"), lines, "c_custkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    ordered = _lay_out(
        placed,
        nation,
        [_t(order, S.TYPE, _ex("status", "o_orderstatus")), _t(order, PLACED_BY, cust)],
    )
    held = (
        dealt(line, lines, "l_orderkey")
        .join(dealt(placed.select("o_orderkey", "c_nationkey"), lines, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("c_nationkey", "o_orderkey", "l_partkey")
        .distinct()
    )
    contents = _lay_out(held, nation, [_t(order, CONTAINS, item)])
    items = _lay_out(
        dealt(held.select("c_nationkey", "l_partkey"), lines, "l_partkey")
        .distinct()
        .join(dealt(part, lines, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")),
        nation,
        [_t(item, S.TYPE, _ex("type", "p_type"))],
    )
    schema_rows = [
        (PLACED_BY, S.TYPE, S.OBJECT_PROPERTY), (PLACED_BY, S.RANGE, UP + "0000040"),
        (PLACED_BY, S.SUBPROPERTY, INVOLVES), (INVOLVES, S.TYPE, S.OBJECT_PROPERTY),
        (CONTAINS, S.TYPE, S.OBJECT_PROPERTY), (CONTAINS, S.DOMAIN, UP + "0000015"),
        (CONTAINS, S.RANGE, UP + "0000040"), (CONTAINED_IN, S.owl("inverseOf"), CONTAINS),
        (CONTAINED_IN, S.TYPE, S.OBJECT_PROPERTY),
    ]
    grounded = {"ECONOMY": "40", "SMALL": "16", "MEDIUM": "23", "STANDARD": "40", "PROMO": "15"}
    for kind in (*grounded, "LARGE"):
        schema_rows.append((EX + f"type/{kind}", S.TYPE, S.CLASS))
    for kind, n in grounded.items():
        schema_rows.append((EX + f"type/{kind}", S.SUBCLASS, UP + f"00000{n}"))
    for status in ("F", "O", "P"):
        schema_rows.append((EX + f"status/{status}", S.TYPE, S.CLASS))
        schema_rows.append((EX + f"status/{status}", S.SUBCLASS, UP + "0000015"))
    declared = _lay_out(
        customer.select("c_nationkey").distinct(),
        nation,
        [_t(_iri(s), p, _iri(o)) for s, p, o in schema_rows],
    )
    building = "c_mktsegment = 'BUILDING'"
    segments = _lay_out(
        customer.select("c_nationkey", "c_mktsegment").distinct(),
        nation,
        [
            _t(segment, S.TYPE, _iri(S.CLASS)),
            _t(segment, S.SUBCLASS, _iri(KERNEL_NS + "Norm"), when=building),
            _t(segment, S.SUBCLASS, _iri(UP + "0000040"), when=f"NOT ({building})"),
        ],
    )
    return customers.union(ordered).union(contents).union(items).union(declared).union(segments)


EXPR = EX + "expr#"
#: What becomes of a part's class in ``expressions``: the last number of its key modulo this.
FORMS = 12


def _list(name, members, owner, p, owner_kind="bnode"):
    """Triples of an RDF list of nodes: (node text, kind) pairs under ``owner``."""
    cells = [f"concat('_:{name}{i}', key)" for i in range(len(members))] + [_iri(S.NIL)]
    rows = [(owner, p, cells[0], "bnode", owner_kind)]
    for i, (member, kind) in enumerate(members):
        rows.append((cells[i], S.FIRST, member, kind, "bnode"))
        rows.append((cells[i], S.REST, cells[i + 1], "iri" if i + 1 == len(members) else "bnode", "bnode"))
    return rows


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with class expressions of every form, one per brand; a part's key says what its class and thing are told.

    0 under owl:Nothing, 1 under a class and its complement, 2 some link to two disjoint classes at once,
    3 under the members of an intersection that is disjoint from a third class, 4 under what some link of a subproperty
    makes it and a class disjoint from that, 5 and 6 against a property's range and domain, 7 satisfiable,
    8 a union of empty classes, 9 against what a transitive property links to in two steps, 10 at least one link to
    an empty class, 11 under a union of others.
    """
    e = lambda n: _iri(EXPR + n)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("key"))
    part = spread(part, EXPRESSION_ROWS, "p_partkey").distinct()
    cls, thing, other = (f"concat('{EXPR}{mark}', key)" for mark in ("P", "I", "J"))
    extra = [f"concat('{EXPR}{mark}', key)" for mark in ("L", "M")]
    x, y = "concat('_:x', key)", "concat('_:y', key)"

    def restricted(node, prop, filler, kind="iri", how="someValuesFrom"):
        return [(node, S.owl("onProperty"), e(prop), "iri", "bnode"), (node, S.owl(how), filler, kind, "bnode")]

    def some(prop, filler, kind="iri"):
        return [(cls, S.SUBCLASS, x, "bnode", "iri"), *restricted(x, prop, filler, kind)]

    def sub(*names):
        return [(cls, S.SUBCLASS, e(n), "iri", "iri") for n in names]

    def typed(who, *names):
        return [(who, S.TYPE, e(n), "iri", "iri") for n in names]

    def link(a, prop, b):
        return [(a, EXPR + prop, b, "iri", "iri")]

    nothing = [(n, S.SUBCLASS, _iri(S.NOTHING), "iri", "iri") for n in extra]
    union = [(cls, S.EQUIVALENT, x, "bnode", "iri")]
    by_form = {
        0: [(cls, S.SUBCLASS, _iri(S.NOTHING), "iri", "iri"), *typed(thing, "Hot", "Wet"),
            *link(thing, "first", other), *link(other, "second", extra[0]), *link(extra[0], "third", extra[1])],
        1: [*sub("Wet"), (cls, S.SUBCLASS, x, "bnode", "iri"), (x, S.owl("complementOf"), e("Wet"), "iri", "bnode"), *typed(thing, "Hot", "Wet", "Allowed")],
        2: [*some("has", y, "bnode"), *_list("l", [(e("Hot"), "iri"), (e("Cold"), "iri")], y, S.owl("intersectionOf")), *link(thing, "has", other), *typed(other, "Wet")],
        3: [*sub("Hot", "Wet", "Allowed"), *link(thing, "part", other), *typed(other, "Hot")],
        4: [*sub("Still"), *some("part", e("Wet")), *link(thing, "inside", other), *link(other, "inside", extra[0]), *typed(extra[0], "Core")],
        5: [*some("touches", e("Loud")), *link(thing, "touches", other)],
        6: [*sub("Idle"), *some("touches", e("Wet")), *link(thing, "has", other), *typed(other, "Hot", "Wet")],
        7: [*sub("Hot"), *some("has", e("Wet")), *link(thing, "has", e("fixed"))],
        8: [*nothing, *union, *_list("l", [(n, "iri") for n in extra], x, S.owl("unionOf")), (thing, S.TYPE, y, "bnode", "iri"), *restricted(y, "has", e("Wet"))],
        9: [*sub("Loose"), *some("inside", extra[0]), (extra[0], S.SUBCLASS, y, "bnode", "iri"), *restricted(y, "inside", e("Core")), *link(thing, "beside", thing)],
        10: [*nothing[:1], (cls, S.SUBCLASS, x, "bnode", "iri"), *restricted(x, "has", "'1'", "literal", "minQualifiedCardinality"), (x, S.owl("onClass"), extra[0], "iri", "bnode"),
             *link(thing, "above", other), *link(other, "above", thing)],
        11: [(cls, S.SUBCLASS, x, "bnode", "iri"), *_list("l", [(e("Hot"), "iri"), (e("Wet"), "iri")], x, S.owl("unionOf")), *typed(thing, "Hot", "Cold")],
    }
    artifact = "concat('expr-', p_brand)"
    # literals and cells have their kinds beside them; every form is one filtered array
    rows = [
        _t(s_, p, o, kind, s_kind, when=f"p_partkey % {FORMS} = {form}") for form, told in by_form.items() for s_, p, o, kind, s_kind in told
    ]
    parts = _lay_out(part, artifact, [_t(cls, S.TYPE, _iri(S.CLASS)), *rows])
    fixed = [(e(n), S.TYPE, _iri(S.OBJECT_PROPERTY), "iri", "iri") for n in ("has", "part", "inside", "touches", "beside", "above", "first", "second", "third", "whole")]
    for a, p, b in (
        ("part", S.SUBPROPERTY, "has"), ("touches", S.DOMAIN, "Active"), ("touches", S.RANGE, "Passive"), ("Hot", S.DISJOINT, "Cold"),
        ("HotWet", S.DISJOINT, "Allowed"), ("Carrier", S.DISJOINT, "Still"), ("Passive", S.DISJOINT, "Loud"), ("Active", S.DISJOINT, "Idle"),
        ("Linked", S.DISJOINT, "Loose"), ("whole", S.RANGE, "End"),
    ):
        fixed.append((e(a), p, e(b), "iri", "iri"))
    for n, kind in (("inside", "TransitiveProperty"), ("beside", "IrreflexiveProperty"), ("above", "AsymmetricProperty")):
        fixed.append((e(n), S.TYPE, _iri(S.owl(kind)), "iri", "iri"))
    for mark, axiom, named, prop, filler, how in (
        ("a", S.SUBCLASS, "Carrier", "has", e("Wet"), "someValuesFrom"), ("b", S.EQUIVALENT, "Holder", "has", e("Hot"), "someValuesFrom"),
        ("d", S.SUBCLASS, "Deep", "has", e("HotWet"), "someValuesFrom"), ("f", S.EQUIVALENT, "Fixed", "has", e("fixed"), "hasValue"),
        ("g", S.EQUIVALENT, "Any", "has", _iri(S.THING), "someValuesFrom"),
    ):
        node = f"concat('_:{mark}', key)"
        fixed += [(node, axiom, e(named), "iri", "bnode"), *restricted(node, prop, filler, "iri", how)]
    node = "concat('_:c', key)"
    fixed += [(e("Linked"), S.EQUIVALENT, node, "bnode", "iri"), *restricted(node, "inside", e("Core"))]
    fixed += [(e("HotWet"), S.EQUIVALENT, y, "bnode", "iri"), *_list("h", [(e("Hot"), "iri"), (e("Wet"), "iri")], y, S.owl("intersectionOf"))]
    fixed += _list("w", [(e(n), "iri") for n in ("first", "second", "third")], e("whole"), S.owl("propertyChainAxiom"), "iri")
    # one long list of disjoint classes, a member per part
    every, cell = _iri("_:all"), "concat('_:q', key)"
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    listed = part.withColumn("next", F.lead("key").over(order)).withColumn("head", F.lag("key").over(order).isNull())
    member = f"concat('{EXPR}D', key)"
    long = _lay_out(
        listed, artifact,
        [
            _t(member, S.TYPE, _iri(S.CLASS)), _t(cell, S.FIRST, member, s_kind="bnode"),
            _t(cell, S.REST, "concat('_:q', next)", "bnode", "bnode", when="next IS NOT NULL"),
            _t(cell, S.REST, _iri(S.NIL), "iri", "bnode", when="next IS NULL"),
            _t(every, S.TYPE, _iri(S.owl("AllDisjointClasses")), "iri", "bnode", when="head"),
            _t(every, S.owl("members"), cell, "bnode", "bnode", when="head"),
        ],
    )
    brands = part.select("p_brand").distinct().withColumn("key", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-"))
    return parts.union(long).union(_lay_out(brands, artifact, [_t(s_, p, o, kind, s_kind) for s_, p, o, kind, s_kind in fixed]))


_LOADED = {}


def load(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """The ``tbox``, ``abox`` or ``expr`` triples as a written table, loaded once per session.

    A file holds what one of the source tables gives, so its predicates and objects are few or lie close together, and class-level
    operators skip the row groups of assertions. Nothing is sorted: a source file of few bytes can give very many triples to one task.
    """
    key = (spark.sparkContext.applicationId, sf_dir, family)
    if key not in _LOADED:
        rows = {"tbox": tbox, "abox": abox, "expr": expressions}[family](spark, sf_dir)
        _LOADED[key] = Workspace(spark).table(rows, family)
    return _LOADED[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "tbox").union(load(spark, sf_dir, "abox"))
