"""Every operator as a query over the given tables, next to its SQL twin.

Queries whose result no SQL states simply (parsers of other formats, streams,
sinks) carry no SQL.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions import formulas as X
from quercus.functions import names as N
from quercus.operators import counts as C
from quercus.operators import disjointness as D
from quercus.operators import expressions as E
from quercus.operators import gate as G
from quercus.operators import graph as GR
from quercus.operators import history as H
from quercus.operators import lint as L
from quercus.operators import premises as PR
from quercus.operators import profile as P
from quercus.operators import repair as R
from quercus.operators import rules as M
from quercus.operators import theory as TH
from quercus.operators import walks as W
from quercus.plans import gate as GP
from quercus.plans.oracles import IS_UP, NAMED_EDGE, OWL, local, path, q, short, sql
from quercus.plans.starmap import CONTAINS, EX, PLACED_BY, corpus, load, read
from quercus.sources import common_logic as CL
from quercus.sources import formats as FM
from quercus.sources import ntriples as NT
from quercus.sources import relational as RL
from quercus.sources.kernel import ANCHORS, KERNEL_NS, builtin_kernel
from quercus.sources.tables import constant_table
from quercus.sources.upper import builtin_upper, vocabulary_rows
from quercus.workspace import Workspace

QUERIES, ORACLES = {}, {}
UP = S.UPPER_PREFIX


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def tbox(spark, d):
    return load(spark, d, "tbox")


def abox(spark, d):
    return load(spark, d, "abox")


_SHARED = {}


def shared(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A table several queries start from, written once per session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def gate_inputs(spark, d, *names) -> G.GateInputs:
    """The inputs of the class-level corpus; the named tables are begun with the others."""
    def build():
        ws, t = Workspace(spark), tbox(spark, d)
        return G.GateInputs.of(t, builtin_kernel(), builtin_upper(), ws, *names)

    return shared(spark, d, "gate", build)


def entries(spark, d):
    def build():
        ws = Workspace(spark)
        return ws.table(W.entry_points(W.subclass_edges(tbox(spark, d)), ws), "entries")

    return shared(spark, d, "entries", build)


def theory(spark, d):
    return shared(spark, d, "theory", lambda: TH.build_theory(tbox(spark, d), builtin_upper(), Workspace(spark)))


def unsat(spark, d):
    def build():
        ws = Workspace(spark)
        return ws.table(M.unsatisfiable_classes(tbox(spark, d), builtin_upper(), ws), "unsat")

    return shared(spark, d, "unsat", build)


def lint(spark, d):
    return L.lint_findings(entries(spark, d), builtin_upper())


def lines_of(spark, d, table="documents", key="doc_id", text="text"):
    return read(spark, d, table).select(F.col(key), F.explode(F.split(text, "\n", -1)).alias("name"))


# == sources =====================================================================


@query("S1_ntriples_round_trip", sql(
    "SELECT artifact_id, s_kind, p, o_kind, CASE WHEN s_kind = 'iri' THEN s ELSE '' END AS s, "
    "CASE WHEN o_kind = 'bnode' THEN '' ELSE o END AS o FROM triples", "triples"))
def s1(spark, d):
    lines = corpus(spark, d).select("artifact_id", NT.line_text().alias("value"))
    triples, _ = NT.parse_lines(lines)
    return triples.select(
        "artifact_id", "s_kind", "p", "o_kind",
        F.when(F.col("s_kind") == "iri", F.col("s")).otherwise("").alias("s"),
        F.when(F.col("o_kind") == "bnode", "").otherwise(F.col("o")).alias("o"),
    )


@query("S1_ntriples_of_documents", "SELECT CAST(doc_id AS VARCHAR) AS artifact_id, text AS o, lang AS o_lang FROM documents")
def s1_text(spark, d):
    docs = read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("artifact_id"),
        F.concat(F.lit(EX), "doc_id").alias("s"), F.lit("iri").alias("s_kind"), F.lit(S.COMMENT).alias("p"),
        F.col("text").alias("o"), F.lit("literal").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"), F.col("lang").alias("o_lang"),
    )
    triples, _ = NT.parse_lines(docs.select("artifact_id", NT.line_text().alias("value")))
    return triples.select("artifact_id", "o", "o_lang")


FILE_NAME = "p_name || CASE p_type WHEN 'ECONOMY' THEN '.ttl' WHEN 'SMALL' THEN '.OWL' WHEN 'MEDIUM' THEN '.nt' WHEN 'PROMO' THEN '.txt' WHEN 'LARGE' THEN '.jsonld' ELSE '' END"


def file_names(spark, d):
    return read(spark, d, "part").select("p_partkey", F.expr(FILE_NAME).alias("file"))


@query("S3_candidate_formats", f"""SELECT p_partkey, file, CASE ext
    WHEN 'ttl' THEN 'turtle,xml,n3,nt,json-ld' WHEN 'owl' THEN 'xml,turtle,n3,nt,json-ld'
    WHEN 'nt' THEN 'nt,xml,turtle,n3,json-ld' WHEN 'jsonld' THEN 'json-ld,xml,turtle,n3,nt'
    ELSE 'xml,turtle,n3,nt,json-ld' END AS formats
    FROM (SELECT p_partkey, {FILE_NAME} AS file, lower(regexp_extract({FILE_NAME}, '\\.([^./\\\\]+)$', 1)) AS ext FROM part)""")
def s3(spark, d):
    f = file_names(spark, d)
    return f.withColumn("formats", F.array_join(FM.candidate_formats(N.extension(F.col("file"))), ","))


@query("P17_uploadable_files", f"""SELECT p_partkey, file FROM (SELECT p_partkey, {FILE_NAME} AS file FROM part)
    WHERE contains(file, '.') AND lower(regexp_replace(file, '^.*\\.', '')) IN ('owl','rdf','xml','ttl','n3','nt','ofn','own','owx')""")
def p17(spark, d):
    return file_names(spark, d).where(N.is_uploadable(F.col("file")))


SNIFF = r"""SELECT kind, id, CASE
    WHEN starts_with(bare, '<?xml') OR contains(head, '<rdf:RDF') OR contains(head, '<owl:Ontology') THEN 'xml'
    WHEN len(list_filter(lines, lambda x : starts_with(x, '@'))) > 0 THEN 'turtle'
    WHEN len(list_filter(lines, lambda x : x <> '' AND NOT (ends_with(x, '.') OR starts_with(x, '#')))) = 0 THEN 'nt'
    WHEN starts_with(bare, '{') AND contains(head, '"@context"') THEN 'json-ld' ELSE 'turtle' END AS format
  FROM (SELECT kind, id, head, regexp_replace(head, '^\s+|\s+$', '', 'g') AS bare,
    list_transform(string_split(head, chr(10))[1:10], lambda x : regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines
    FROM (SELECT 'page' AS kind, page_id AS id, substring(html, 1, 1000) AS head FROM pages
      UNION ALL SELECT 'document', doc_id, substring(text, 1, 1000) FROM documents))"""


@query("S4_sniff_format", SNIFF)
def s4(spark, d):
    texts = read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t")).union(
        read(spark, d, "documents").select(F.lit("document"), "doc_id", "text")
    )
    return texts.select("kind", "id", FM.sniff_format(F.col("t")).alias("format"))


@query("S5_dead_letters", "SELECT CAST(doc_id AS VARCHAR) AS artifact_id, 'E_PARSE' AS code, "
       "'could not parse line (tried [nt]): ' || line AS message FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
       r"WHERE NOT regexp_matches(line, '^\s*(#.*)?$')")
def s5(spark, d):
    lines = lines_of(spark, d).select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("name").alias("value"))
    _, errors = NT.parse_lines(lines)
    return errors


S6_UPPER = "CASE p_type WHEN 'ECONOMY' THEN '0000040' WHEN 'MEDIUM' THEN '0000019' END"


@query("S6_tables_to_triples", f"""WITH c AS (SELECT p_brand AS a, p_partkey AS id, 'P' || p_partkey AS name, p_name AS descr, {S6_UPPER} AS up, CAST(p_size AS BIGINT) AS parent FROM part),
  pr AS (SELECT p_brand AS a, CAST(p_size AS BIGINT) AS id, 'prop' || p_size AS name, CASE WHEN p_size < 20 THEN 'object' WHEN p_size < 40 THEN 'data' ELSE 'annotation' END AS t,
     min(p_partkey) AS dom, max(p_partkey) AS rng FROM part GROUP BY p_brand, p_size),
  iri AS (SELECT {q(EX)} AS b),
  ind AS (SELECT p_brand AS a, p_partkey AS id, 'I' || p_partkey AS name, CAST(p_size AS BIGINT) AS pid FROM part),
  r AS (
   SELECT a, name AS s, {q(S.TYPE)} AS p, {q(S.CLASS)} AS o, 'iri' AS k FROM c
   UNION ALL SELECT a, name, {q(S.LABEL)}, name, 'literal' FROM c UNION ALL SELECT a, name, {q(S.COMMENT)}, descr, 'literal' FROM c
   UNION ALL SELECT a, name, {q(S.SUBCLASS)}, {q(UP)} || up, 'iri' FROM c WHERE up IS NOT NULL
   UNION ALL SELECT c.a, c.name, {q(S.SUBCLASS)}, b || c.a || '#' || x.name, 'iri' FROM iri, c JOIN c x ON c.a = x.a AND c.parent = x.id
   UNION ALL SELECT a, name, {q(S.TYPE)}, CASE t WHEN 'object' THEN {q(S.OBJECT_PROPERTY)} WHEN 'data' THEN {q(S.DATA_PROPERTY)} ELSE {q(S.ANNOTATION_PROPERTY)} END, 'iri' FROM pr
   UNION ALL SELECT a, name, {q(S.LABEL)}, name, 'literal' FROM pr UNION ALL SELECT a, name, {q(S.COMMENT)}, '', 'literal' FROM pr
   UNION ALL SELECT a, name, {q(S.DOMAIN)}, b || a || '#P' || dom, 'iri' FROM iri, pr WHERE t <> 'annotation'
   UNION ALL SELECT a, name, {q(S.RANGE)}, b || a || '#P' || rng, 'iri' FROM iri, pr WHERE t = 'object'
   UNION ALL SELECT a, name, {q(S.RANGE)}, {q(S.XSD + 'string')}, 'iri' FROM pr WHERE t = 'data'
   UNION ALL SELECT a, name, {q(S.TYPE)}, {q(S.NAMED_INDIVIDUAL)}, 'iri' FROM ind
   UNION ALL SELECT a, name, {q(S.LABEL)}, name, 'literal' FROM ind UNION ALL SELECT a, name, {q(S.COMMENT)}, '', 'literal' FROM ind
   UNION ALL SELECT a, name, {q(S.TYPE)}, b || a || '#P' || id, 'iri' FROM iri, ind
   UNION ALL SELECT ind.a, ind.name, b || ind.a || '#' || pr.name, CASE WHEN t = 'object' THEN b || ind.a || '#' || ind.name ELSE CAST(ind.id AS VARCHAR) END, CASE WHEN t = 'object' THEN 'iri' ELSE 'literal' END
     FROM iri, ind JOIN pr ON ind.a = pr.a AND ind.pid = pr.id)
  SELECT DISTINCT a AS artifact_id, b || a || '#' || s AS s, p, o, k AS o_kind FROM iri, r""")
def s6(spark, d):
    part = read(spark, d, "part")
    size = F.col("p_size").cast("bigint")
    none = F.lit(None).cast("string")
    classes = part.select(
        F.col("p_brand").alias("artifact_id"), F.col("p_partkey").alias("id"), F.concat(F.lit("P"), "p_partkey").alias("name"),
        F.col("p_name").alias("description"), F.expr(S6_UPPER).alias("upper_id"), size.alias("parent_id"),
    )
    kind = F.when(F.col("p_size") < 20, "object").when(F.col("p_size") < 40, "data").otherwise("annotation")
    properties = part.groupBy(F.col("p_brand").alias("artifact_id"), "p_size").agg(
        F.min("p_partkey").alias("domain_class_id"), F.max("p_partkey").alias("range_class_id")
    ).select(
        "artifact_id", size.alias("id"), F.concat(F.lit("prop"), "p_size").alias("name"), none.alias("description"),
        kind.alias("property_type"), "domain_class_id", "range_class_id",
    )
    individuals = part.select(
        F.col("p_brand").alias("artifact_id"), F.col("p_partkey").alias("id"), F.concat(F.lit("I"), "p_partkey").alias("name"),
        none.alias("description"), F.col("p_partkey").alias("class_id"),
        F.create_map(size, F.col("p_partkey").cast("string")).alias("property_values"),
    )
    return RL.tables_to_triples(classes, properties, individuals, EX).select("artifact_id", "s", "p", "o", "o_kind")


# == names =========================================================================


@query("P1_local_names", sql(
    f"SELECT DISTINCT s AS iri, {local('s')} AS local_name, {short('s')} AS short_name, {IS_UP.format('s')} AS is_upper, "
    "FROM (SELECT s FROM triples WHERE s_kind = 'iri' UNION SELECT p FROM triples UNION SELECT o FROM triples WHERE o_kind = 'iri')", "triples"))
def p1(spark, d):
    t = corpus(spark, d)
    iris = t.select(F.inline(F.array(
        F.struct(F.when(F.col("s_kind") == "iri", F.col("s")).alias("iri")),
        F.struct(F.col("p").alias("iri")),
        F.struct(F.when(F.col("o_kind") == "iri", F.col("o")).alias("iri")),
    ))).where("iri IS NOT NULL").distinct()
    i = F.col("iri")
    return iris.select("iri", N.local_name(i).alias("local_name"), N.short_name(i).alias("short_name"), N.is_upper(i).alias("is_upper"))


@query("P4_named_terms", sql("SELECT artifact_id, count(*) FILTER (WHERE s_kind = 'iri') AS named_subjects, "
       "count(*) FILTER (WHERE o_kind = 'iri') AS named_objects FROM triples GROUP BY artifact_id", "triples"))
def p4(spark, d):
    return corpus(spark, d).groupBy("artifact_id").agg(
        F.count_if(F.col("s_kind") == "iri").alias("named_subjects"), F.count_if(F.col("o_kind") == "iri").alias("named_objects"))


@query("P5_labels", sql(f"SELECT c.artifact_id, c.cls, coalesce(l.label, {short('c.cls')}) AS label FROM declared c LEFT JOIN "
       f"(SELECT artifact_id, s, min(o) AS label FROM tbox WHERE p = {q(S.LABEL)} GROUP BY artifact_id, s) l ON c.artifact_id = l.artifact_id AND c.cls = l.s", "declared"))
def p5(spark, d):
    t = tbox(spark, d)
    labels = t.where(F.col("p") == S.LABEL).groupBy("artifact_id", F.col("s").alias("cls")).agg(F.min("o").alias("label"))
    return W.declared_classes(t).join(labels, ["artifact_id", "cls"], "left").select(
        "artifact_id", "cls", F.coalesce("label", N.short_name(F.col("cls"))).alias("label"))


DOC_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS name FROM documents)"
PRIVATE = f"(regexp_matches(name, {q(N.PRIVATION_START)}) OR regexp_matches(name, {q(N.PRIVATION_ANYWHERE)}))"
COMPOUND = (f"(len(list_filter(regexp_extract_all(name, {q(N.NAME_TOKEN)}, 1), lambda t : lower(t) IN ('with','and','of','by','over'))) >= 2 "
            f"AND len(regexp_extract_all(name, {q(N.NAME_TOKEN)}, 1)) >= 5)")


@query("P6_P7_name_antipatterns", f"SELECT doc_id, name, CASE WHEN {PRIVATE} THEN 'privation' WHEN {COMPOUND} THEN 'compound' END AS kind FROM {DOC_LINES}")
def p6(spark, d):
    return lines_of(spark, d).select("doc_id", "name", N.antipattern(F.col("name")).alias("kind"))


@query("P6_privation_strict", f"SELECT doc_id, name, regexp_matches(name, {q(N.PRIVATION_START_STRICT)}) OR regexp_matches(name, {q(N.PRIVATION_ANYWHERE)}) AS hit FROM {DOC_LINES}")
def p6_strict(spark, d):
    return lines_of(spark, d).select("doc_id", "name", N.is_privation(F.col("name"), strict=True).alias("hit"))


KIND_SQL = ", ".join(f"regexp_matches(lower(name), '{'|'.join(w)}') AS is_{k}" for k, w in N.CATEGORY_WORDS.items())
CLASS_SQL = ", ".join(f"regexp_matches(lower(name), '{'|'.join(w)}') AS as_{k.lower()}" for k, w in N.CLASS_WORDS.items())


@query("P14_P16_name_categories", f"SELECT doc_id, name, regexp_matches(lower(name), '{N.TEMPORAL_WORDS}') AS temporal, {KIND_SQL}, {CLASS_SQL} FROM {DOC_LINES}")
def p16(spark, d):
    n = F.col("name")
    return lines_of(spark, d).select(
        "doc_id", "name", N.is_temporal_name(n).alias("temporal"),
        *[N.suggests(k, n).alias(f"is_{k}") for k in N.CATEGORY_WORDS],
        *[N.suggests_class(k, n).alias(f"as_{k.lower()}") for k in N.CLASS_WORDS])


CORE = "lower(regexp_replace(regexp_replace(name, '[^0-9a-zA-Z_]', '_', 'g'), '^_+|_+$', '', 'g'))"


@query("P11_P18_symbols", f"SELECT doc_id, name, CASE WHEN {CORE} = '' THEN 'c' WHEN regexp_matches({CORE}, '^[a-z]') THEN {CORE} ELSE 'c_' || {CORE} END AS symbol, "
       f"replace(name, '-', '_') AS predicate FROM {DOC_LINES}")
def p11(spark, d):
    n = F.col("name")
    return lines_of(spark, d).select("doc_id", "name", N.logic_symbol(n).alias("symbol"), N.predicate_symbol(n).alias("predicate"))


@query("P13_node_types", f"""SELECT doc_id, name, CASE WHEN regexp_matches(n, 'process|event|activity|action') THEN 'Process'
    WHEN regexp_matches(n, 'role|function|disposition|quality') THEN 'DependentContinuant' WHEN regexp_matches(n, 'entity|object|material|substance') THEN 'IndependentContinuant'
    WHEN regexp_matches(n, 'temporal|time|moment|interval') THEN 'TemporalRegion' WHEN regexp_matches(n, 'spatial|region|location|place') THEN 'SpatialRegion'
    ELSE 'IndependentContinuant' END AS node_type FROM (SELECT doc_id, name, lower(name) AS n FROM {DOC_LINES})""")
def p13(spark, d):
    return lines_of(spark, d).select("doc_id", "name", N.node_type(F.col("name"), [], fixed=True).alias("node_type"))


@query("P8_axiom_listing", sql(f"""SELECT artifact_id, axiom_type, sn || ' ' || sep || ' ' || ons AS description FROM (
    SELECT artifact_id, k.t AS axiom_type, k.sep, {local('s')} AS sn, {local('o')} AS ons FROM triples JOIN (VALUES ({q(S.SUBCLASS)}, 'SubClassOf', '⊑'), ({q(S.EQUIVALENT)}, 'EquivalentClass', '≡'),
    ({q(S.DISJOINT)}, 'DisjointWith', '⊥'), ({q(S.DOMAIN)}, 'Domain', 'domain ⇒'), ({q(S.RANGE)}, 'Range', 'range ⇒')) AS k(p, t, sep) ON triples.p = k.p
    WHERE s_kind = 'iri' AND o_kind = 'iri') WHERE sn NOT IN ('', 'Thing', 'Nothing') AND ons <> ''""", "triples"))
def p8(spark, d):
    return P.axiom_listing(corpus(spark, d))


# == hierarchy =======================================================================


@query("J1_grounding_edges", sql("SELECT artifact_id, child, parent FROM edges_k", "edges_k"))
def j1(spark, d):
    return W.grounding_edges(tbox(spark, d), builtin_kernel())


@query("J2_entry_points", sql("SELECT DISTINCT artifact_id, cls, upper_iri FROM entry_k", "entry_k"))
def j2(spark, d):
    ws = Workspace(spark)
    return W.entry_points(W.grounding_edges(tbox(spark, d), builtin_kernel()), ws)


TARGETS = [KERNEL_NS + "Agent", KERNEL_NS + "LegalEvent", EX + "size/S3"]


@query("J3_reaches", sql(f"SELECT artifact_id, child AS cls, ancestor AS target FROM clo_k WHERE ancestor IN ({', '.join(map(q, TARGETS))}) "
       f"UNION SELECT artifact_id, node, node FROM (SELECT artifact_id, child AS node FROM edges_k UNION SELECT artifact_id, parent FROM edges_k) WHERE node IN ({', '.join(map(q, TARGETS))})", "clo_k"))
def j3(spark, d):
    ws = Workspace(spark)
    return W.reaches(W.grounding_edges(tbox(spark, d), builtin_kernel()), TARGETS, ws)


@query("J3_reaches_upper", sql("SELECT DISTINCT e.artifact_id, e.cls, a.ancestor AS target FROM entry_k e JOIN up_anc a ON e.upper_iri = a.iri", "entry_k", "up_anc"))
def j3_upper(spark, d):
    g = W.entry_points(W.grounding_edges(tbox(spark, d), builtin_kernel()), Workspace(spark))
    anc = builtin_upper().ancestor_table(spark).withColumnRenamed("iri", "upper_iri")
    return g.join(anc, "upper_iri").select("artifact_id", "cls", F.col("ancestor").alias("target")).distinct()


@query("J4_closure", sql("SELECT artifact_id, child, ancestor FROM clo", "clo"))
def j4(spark, d):
    return W.closure(W.subclass_edges(tbox(spark, d)), Workspace(spark))


@query("J5_category_ancestors", sql(f"SELECT e.artifact_id, count(*) AS pairs, count(DISTINCT a.ancestor) AS ancestors FROM (SELECT DISTINCT artifact_id, parent FROM edges WHERE {IS_UP.format('parent')}) e "
       "JOIN up_anc a ON e.parent = a.iri GROUP BY e.artifact_id", "edges", "up_anc"))
def j5(spark, d):
    used = TH.referenced_categories(W.subclass_edges(tbox(spark, d)))
    anc = builtin_upper().ancestor_table(spark).withColumnRenamed("iri", "upper_iri")
    return used.join(anc, "upper_iri").groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("ancestor").alias("ancestors"))


@query("J6_J7_category_clashes", sql(f"WITH used AS (SELECT DISTINCT artifact_id, parent AS c FROM edges WHERE {IS_UP.format('parent')}) "
       "SELECT l.artifact_id, x.a, x.b FROM used l JOIN up_clash x ON l.c = x.a JOIN used r ON r.c = x.b AND r.artifact_id = l.artifact_id", "edges", "up_clash"))
def j7(spark, d):
    used = TH.referenced_categories(W.subclass_edges(tbox(spark, d))).withColumn("cls", F.lit(""))
    return L.straddle_pairs(used, builtin_upper()).select("artifact_id", "a", "b")


# Upper ontology and kernel of any size, out of the parts: categories in a tree of four children each, siblings 0 and 1 of every third parent disjoint.
def _part_tree(spark, d, prefix):
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_type").distinct()
    child = F.concat(F.lit(prefix), F.col("p_partkey").cast("string"))
    up = F.floor(F.col("p_partkey") / 4).cast("string")
    cells = lambda *rows: F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind")) for p, o, k in rows])
    base = [(S.TYPE, F.lit(S.CLASS), "iri"), (S.LABEL, F.col("p_name"), "literal")]
    return part, child, up, cells, base


def _as_triples(rows):
    none = F.lit(None).cast("string")
    return rows.select(F.lit("u").alias("artifact_id"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", none.alias("o_datatype"), none.alias("o_lang"))


@query("S7_upper_of_parts", f"""WITH RECURSIVE anc(k, a) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT k, a // 4 FROM anc WHERE a // 4 > 0),
  known AS (SELECT DISTINCT anc.k, anc.a FROM anc JOIN part ON p_partkey = anc.a), n AS (SELECT k, count(*) AS depth FROM known GROUP BY k),
  side AS (SELECT k, a // 4 AS g, a % 4 AS m FROM known WHERE (a // 4) % 3 = 0 AND a // 4 > 0 AND a % 4 IN (0, 1) AND EXISTS (SELECT 1 FROM part WHERE p_partkey = a // 4 * 4) AND EXISTS (SELECT 1 FROM part WHERE p_partkey = a // 4 * 4 + 1)),
  pair AS (SELECT DISTINCT l.p_partkey AS x, r.p_partkey AS y FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1 + l.p_size),
  hit AS (SELECT DISTINCT x, y FROM pair JOIN side l ON l.k = x JOIN side r ON r.k = y AND r.g = l.g AND r.m <> l.m)
  SELECT least('{UP}' || x, '{UP}' || y) AS a, greatest('{UP}' || x, '{UP}' || y) AS b,
  CASE WHEN i.depth = j.depth THEN greatest('{UP}' || x, '{UP}' || y) WHEN i.depth < j.depth THEN '{UP}' || x ELSE '{UP}' || y END AS drop_iri FROM hit JOIN n i ON i.k = x JOIN n j ON j.k = y""")
def s7(spark, d):
    from quercus.sources.upper import upper_from_triples

    part, child, up, cells, base = _part_tree(spark, d, UP)
    rows = part.select(child.alias("s"), F.inline(cells(*base, (S.SUBCLASS, F.concat(F.lit(UP), up), "iri"))))
    key = F.col("p_partkey")
    first = part.where((key % 4 == 0) & (key > 3) & (F.floor(key / 4) % 3 == 0)).select(child.alias("s"), F.lit(S.DISJOINT).alias("p"), F.concat(F.lit(UP), (key + 1).cast("string")).alias("o"), F.lit("iri").alias("o_kind"))
    exists = part.select(child.alias("o"))
    upper = upper_from_triples(spark, _as_triples(rows.union(first.join(exists, "o", "left_semi").select("s", "p", "o", "o_kind"))))
    asked = read(spark, d, "part").select((F.col("p_partkey") + 1 + F.col("p_size")).alias("y"), F.col("p_partkey").alias("x")).join(part.select(F.col("p_partkey").alias("y")), "y")
    x, y = (F.concat(F.lit(UP), F.col(c).cast("string")) for c in "xy")
    return upper.clashing(asked.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()).select("a", "b", "drop_iri")


def part_kernel(spark, d):
    from quercus.sources.kernel import kernel_from_triples

    part, child, up, cells, base = _part_tree(spark, d, "urn:parts#P")
    anchor = F.concat(F.lit(UP), F.when(F.col("p_partkey") % 2 == 0, "0000040").otherwise("0000003"))
    label = F.when(F.col("p_partkey") % 10 == 2, F.concat(F.lit("A Contradiction of "), "p_name")).otherwise(F.col("p_name"))
    top = F.when(F.col("p_partkey") < 4, anchor).otherwise(F.concat(F.lit("urn:parts#P"), up))
    rows = part.select(child.alias("s"), F.inline(cells(base[0], (S.LABEL, label, "literal"), (S.SUBCLASS, top, "iri"))))
    version = part.limit(1).select(F.lit("urn:parts").alias("s"), F.lit(S.owl("versionInfo")).alias("p"), F.lit("parts/1").alias("o"), F.lit("literal").alias("o_kind"))
    return kernel_from_triples(spark, _as_triples(rows.union(version)))


@query("S8_kernel_categories", f"SELECT 'urn:parts#P' || p_partkey AS category, CASE WHEN p_partkey % 10 = 2 THEN 'A Contradiction of ' ELSE '' END || p_name AS category_label, "
       f"'{UP}' || CASE WHEN p_partkey % 2 = 0 THEN '0000040' ELSE '0000003' END AS required FROM part WHERE p_partkey < 4")
def s8(spark, d):
    return part_kernel(spark, d).category_table(spark)


@query("A15_kernel_totals", """WITH RECURSIVE below(k) AS (SELECT p_partkey FROM part WHERE p_partkey // 4 > 0 AND (p_partkey // 4) % 10 = 2 AND p_partkey // 4 IN (SELECT p_partkey FROM part)
  UNION SELECT p_partkey FROM part JOIN below ON p_partkey // 4 = k)
  SELECT (SELECT count(*) FROM part) AS classes, (SELECT count(*) FROM part WHERE p_partkey < 4) AS categories, (SELECT count(DISTINCT k) FROM below) AS contradiction_types, 'parts/1' AS version""")
def a15(spark, d):
    return part_kernel(spark, d).totals()


# The message wording is rebuilt here from the labels and ancestor roots.
LINT_SQL = f"""SELECT l.artifact_id, class_iri, class_name, category_a, category_b, category_a_iri, category_b_iri, drop_iri,
  CASE WHEN list_sort([category_a, category_b]) = ['disposition', 'quality'] THEN class_name || ' is placed under both Quality and Disposition, which are disjoint. Pick one. If ' || class_name ||
     ' is a realizable that the bearer is engineered for, model it as a Disposition (or Function) and give the measured magnitude a separate Quality.'
   WHEN (ca AND ob) OR (oa AND cb) THEN class_name || ' is both a ' || category_a || ' and a ' || category_b || '. Continuant and Occurrent are disjoint. Separate the continuant aspect from the process or other occurrent it participates in.'
   WHEN (ma AND ib) OR (ia AND mb) THEN class_name || ' is both a ' || category_a || ' and a ' || category_b || '. Material entity and immaterial entity are disjoint. Decide whether ' || class_name || ' bears matter or is a boundary, site, or spatial region.'
   ELSE class_name || ' is placed under both ' || category_a || ' and ' || category_b || ', which are disjoint in BFO 2020. A single class cannot be both. Split ' || class_name || ' into separate classes, one per category, or pick the category that fits.' END AS message
  FROM lint l JOIN roots ra ON ra.iri = category_a_iri JOIN (SELECT iri, ca AS cb, oa AS ob, ma AS mb, ia AS ib FROM roots) rb ON rb.iri = category_b_iri"""
ROOTS = "roots AS (SELECT iri, " + ", ".join(
    f"bool_or(ancestor = '{UP}{n}') AS {c}" for c, n in (("ca", "0000002"), ("oa", "0000003"), ("ma", "0000040"), ("ia", "0000141"))
) + " FROM up_anc GROUP BY iri)"
LINT_ORACLE = sql("WITH " + ROOTS + " " + LINT_SQL, "lint", "up_anc")


@query("J8_straddle_lint", LINT_ORACLE)
def j8(spark, d):
    return L.straddle_lint(tbox(spark, d), builtin_upper(), Workspace(spark))


@query("P10_derivation_steps", sql("SELECT artifact_id, class_iri, 'Inconsistency' AS axiom_type, 'BFO Lint' AS origin, 'High' AS confidence, "
       "class_name || ' is placed under both ' || category_a || ' and ' || category_b || ', which are disjoint.' AS description, "
       "class_name || ' transitively subclasses ' || category_a || '; ' || class_name || ' transitively subclasses ' || category_b || '; ' || category_a || ' and ' || category_b || ' are disjoint in BFO 2020' AS facts FROM lint", "lint"))
def p10(spark, d):
    steps = L.derivation_steps(lint(spark, d))
    return steps.select("artifact_id", "class_iri", "axiom_type", "origin", "confidence", "description",
                        F.array_join("supporting_facts", "; ").alias("facts"))


ORPHANS = "(SELECT artifact_id, cls FROM domain WHERE NOT EXISTS (SELECT 1 FROM entry_k e WHERE e.artifact_id = domain.artifact_id AND e.cls = domain.cls))"


@query("J9_orphans", sql(f"SELECT * FROM {ORPHANS}", "domain", "entry_k"))
def j9(spark, d):
    g = gate_inputs(spark, d)
    return G.orphans(g.domain_classes, g.entries)


@query("W4_orphan_findings", sql(f"SELECT artifact_id, 'B' AS stage, 'E_ORPHAN' AS code, '''' || {short('cls')} || ''' does not reach any BFO upper category via subClassOf*.' AS message, "
       f"cls AS iri, 'add subClassOf to the BFO category that fits ' || {short('cls')} AS suggested_rewrite FROM {ORPHANS}", "domain", "entry_k"))
def w4(spark, d):
    return G.orphan_findings(j9(spark, d))


@query("W4_orphan_notes", sql(f"SELECT artifact_id, count(*) AS orphan_count, CAST(greatest(count(*) - 50, 0) AS BIGINT) AS orphans_truncated FROM {ORPHANS} GROUP BY artifact_id", "domain", "entry_k"))
def w4_notes(spark, d):
    return G.orphan_notes(j9(spark, d))


@query("J10_gate_straddles", sql(f"SELECT p.artifact_id, 'B' AS stage, 'E_DISJOINT' AS code, '''' || {short('p.cls')} || ''' is under both ' || la.label || ' and ' || lb.label || ', which are disjoint in BFO 2020.' AS message, p.cls AS iri, '' AS suggested_rewrite "
       "FROM pairs_k p JOIN domain USING (artifact_id, cls) JOIN up_class la ON la.iri = p.a JOIN up_class lb ON lb.iri = p.b", "pairs_k", "domain", "up_class"))
def j10(spark, d):
    g = gate_inputs(spark, d)
    return G.straddle_findings(g.entries, g.upper)


ANCHOR_LIST = ", ".join(q(UP + n) for _, n in ANCHORS)


@query("J11_mistyped", sql(f"""SELECT c.artifact_id, 'B' AS stage, 'E_MISTYPED' AS code, '''' || {short('c.child')} || ''' is a ' || k.label || ' so must ground to ' || lr.label || ', but it also reaches the disjoint ' || la.label || '.' AS message,
    c.child AS iri, '' AS suggested_rewrite FROM clo_k c JOIN kernel_edge ke ON ke.child = c.ancestor AND ke.parent IN ({ANCHOR_LIST}) JOIN kernel_class k ON k.iri = ke.child JOIN domain dm ON dm.artifact_id = c.artifact_id AND dm.cls = c.child
    JOIN entry_k e ON e.artifact_id = c.artifact_id AND e.cls = c.child AND e.upper_iri IN ({ANCHOR_LIST}) JOIN up_clash x ON x.a = least(e.upper_iri, ke.parent) AND x.b = greatest(e.upper_iri, ke.parent)
    JOIN up_class lr ON lr.iri = ke.parent JOIN up_class la ON la.iri = e.upper_iri WHERE c.child <> ke.child""", "clo_k", "entry_k", "domain", "kernel_class", "up_clash"))
def j11(spark, d):
    g = gate_inputs(spark, d)
    g.begin("entries", "reach")
    return G.mistyped_findings(G.mistyped(g.reach, g.domain_classes, g.entries, g.kernel, g.upper), g.upper)


ANCHOR_VALUES = ", ".join(f"({i}, '{n}', '{UP}{k}')" for i, (n, k) in enumerate(ANCHORS))
MISSING_SQL = (f"SELECT a.artifact_id, string_agg(v.label, ', ' ORDER BY v.i) AS missing FROM (SELECT DISTINCT artifact_id FROM tbox) a, (VALUES {ANCHOR_VALUES}) AS v(i, label, iri) "
               "WHERE NOT EXISTS (SELECT 1 FROM entry_k e JOIN declared dc USING (artifact_id, cls) JOIN up_anc u ON u.iri = e.upper_iri WHERE e.artifact_id = a.artifact_id AND u.ancestor = v.iri) "
               f"AND NOT EXISTS (SELECT 1 FROM tbox t WHERE t.artifact_id = a.artifact_id AND t.p = {q(S.TYPE)} AND t.o = v.iri) GROUP BY a.artifact_id")


@query("J12_missing_anchors", sql(MISSING_SQL, "entry_k", "declared", "up_anc"))
def j12(spark, d):
    g = gate_inputs(spark, d)
    m = G.missing_anchors(g.counts.select("artifact_id"), G.populated_anchors(g.triples, g.entries, g.upper))
    return m.select("artifact_id", F.array_join("missing", ", ").alias("missing"))


@query("U1_union_with_kernel", sql("SELECT artifact_id, count(*) AS triples FROM (SELECT artifact_id, s, p, o FROM tbox UNION SELECT artifact_id, child, "
       f"{q(S.SUBCLASS)}, parent FROM edges_k) GROUP BY artifact_id", "edges_k"))
def u1(spark, d):
    t = tbox(spark, d)
    grounded = W.grounding_edges(t, builtin_kernel()).select(
        "artifact_id", F.col("child").alias("s"), F.lit(S.SUBCLASS).alias("p"), F.col("parent").alias("o"))
    return t.select("artifact_id", "s", "p", "o").unionByName(grounded).distinct().groupBy("artifact_id").agg(F.count(F.lit(1)).alias("triples"))


@query("U2_set_semantics", "SELECT count(*) AS triples FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def u2(spark, d):
    line = read(spark, d, "lineitem").select(
        F.lit("lineitem").alias("artifact_id"), F.concat(F.lit(EX), "l_orderkey").alias("s"), F.lit("iri").alias("s_kind"), F.lit(CONTAINS).alias("p"),
        F.concat(F.lit(EX), "l_partkey").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    return C.as_set(line).agg(F.count(F.lit(1)).alias("triples"))


@query("U3_disjoint_groups", sql("SELECT artifact_id, group_id, member FROM dis_group", "dis_group"))
def u3(spark, d):
    return D.disjoint_groups(tbox(spark, d), Workspace(spark))


# == aggregates ==========================================================================

PROPS = f"(SELECT DISTINCT artifact_id, s FROM triples WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND o = {q(S.OBJECT_PROPERTY)})"
ALL_PROPS = f"(SELECT DISTINCT artifact_id, s FROM triples WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND o IN ({q(S.OBJECT_PROPERTY)}, {q(S.DATA_PROPERTY)}))"
DECLARED_ALL = f"(SELECT DISTINCT artifact_id, s FROM triples WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND o IN ({q(S.CLASS)}, {q(S.RDFS_CLASS)}))"
_in = lambda xs: "(" + ", ".join(map(q, xs)) + ")"
COUNT_SQL = f"""SELECT artifact_id, sum(n) FILTER (WHERE m = 'classes')::BIGINT AS classes, coalesce(sum(n) FILTER (WHERE m = 'sub'), 0)::BIGINT AS "subClassOf",
  coalesce(sum(n) FILTER (WHERE m = 'obj'), 0)::BIGINT AS "objectProperties", coalesce(sum(n) FILTER (WHERE m = 'objax'), 0)::BIGINT AS "objectPropertyAxioms",
  coalesce(sum(n) FILTER (WHERE m = 'data'), 0)::BIGINT AS "dataProperties", coalesce(sum(n) FILTER (WHERE m = 'ind'), 0)::BIGINT AS individuals, coalesce(sum(n) FILTER (WHERE m = 'ax'), 0)::BIGINT AS axioms FROM (
  SELECT artifact_id, 'classes' AS m, count(*) AS n FROM {DECLARED_ALL} GROUP BY 1
  UNION ALL SELECT artifact_id, 'sub', count(*) FROM triples WHERE {NAMED_EDGE} AND o NOT IN {_in(C.TRIVIAL_PARENTS)} GROUP BY 1
  UNION ALL SELECT artifact_id, 'obj', count(*) FROM {PROPS} GROUP BY 1
  UNION ALL SELECT artifact_id, 'data', count(DISTINCT s) FROM triples WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND o = {q(S.DATA_PROPERTY)} GROUP BY 1
  UNION ALL SELECT artifact_id, 'ind', count(DISTINCT s) FROM triples t WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND (o = {q(S.NAMED_INDIVIDUAL)} OR (artifact_id, o) IN (SELECT artifact_id, s FROM {DECLARED_ALL})) GROUP BY 1
  UNION ALL SELECT artifact_id, 'ax', count(*) FROM triples WHERE p = {q(S.SUBCLASS)} AND o NOT IN {_in(C.TRIVIAL_PARENTS)} GROUP BY 1
  UNION ALL SELECT artifact_id, 'ax', count(*) FROM triples WHERE p IN {_in(C.LOGICAL_PREDICATES)} OR (p = {q(S.TYPE)} AND o IN {_in(C.CHARACTERISTICS)}) GROUP BY 1
  UNION ALL SELECT artifact_id, 'ax', count(*) FROM triples WHERE p = {q(S.TYPE)} AND o = {q(S.RESTRICTION)} AND s_kind = 'bnode' GROUP BY 1
  UNION ALL SELECT artifact_id, 'ax', count(*) FROM triples WHERE p IN {_in(C.EXPRESSION_PREDICATES)} GROUP BY 1
  UNION ALL SELECT artifact_id, 'ax', count(*) FROM triples WHERE (artifact_id, p) IN (SELECT artifact_id, s FROM {ALL_PROPS}) GROUP BY 1
  UNION ALL SELECT artifact_id, 'ax', count(*) FROM triples WHERE p = {q(S.TYPE)} AND o_kind = 'iri' AND (artifact_id, o) IN (SELECT artifact_id, s FROM {DECLARED_ALL}) GROUP BY 1
  UNION ALL SELECT artifact_id, 'objax', count(*) FROM triples WHERE (p IN {_in(C.PROPERTY_USE_PREDICATES)} OR (p = {q(S.TYPE)} AND o IN {_in(C.CHARACTERISTICS)})) AND (artifact_id, s) IN (SELECT artifact_id, s FROM {PROPS}) GROUP BY 1
  UNION ALL SELECT artifact_id, 'objax', count(*) FROM triples WHERE p = {q(OWL + 'onProperty')} AND (artifact_id, o) IN (SELECT artifact_id, s FROM {PROPS}) GROUP BY 1
  UNION ALL SELECT artifact_id, 'objax', count(*) FROM triples WHERE (artifact_id, p) IN (SELECT artifact_id, s FROM {PROPS}) GROUP BY 1) GROUP BY artifact_id"""


@query("A6_counts", sql(COUNT_SQL, "triples"))
def a6(spark, d):
    return C.counts(corpus(spark, d), Workspace(spark))


@query("A1_declarations", sql(f"SELECT artifact_id, s AS iri, bool_or(o IN ({q(S.CLASS)}, {q(S.RDFS_CLASS)})) AS is_class, bool_or(o = {q(S.OBJECT_PROPERTY)}) AS is_object, bool_or(o = {q(S.DATA_PROPERTY)}) AS is_data "
       f"FROM triples WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND o IN ({q(S.CLASS)}, {q(S.RDFS_CLASS)}, {q(S.OBJECT_PROPERTY)}, {q(S.DATA_PROPERTY)}) GROUP BY artifact_id, s", "triples"))
def a1(spark, d):
    return C.declarations(corpus(spark, d))


@query("A2_individuals", sql(f"SELECT DISTINCT artifact_id, s AS iri FROM triples WHERE p = {q(S.TYPE)} AND s_kind = 'iri' AND (o = {q(S.NAMED_INDIVIDUAL)} OR (artifact_id, o) IN (SELECT artifact_id, s FROM {DECLARED_ALL}))", "triples"))
def a2(spark, d):
    return C.individuals(corpus(spark, d), Workspace(spark))


KIND_ROWS = ", ".join(f"({q(i)}, '{k}')" for i, k in P.ENTITY_KINDS)
ENTITY_SQL = f"(SELECT DISTINCT artifact_id, kind, name FROM (SELECT artifact_id, v.kind, {local('s')} AS name FROM triples JOIN (VALUES {KIND_ROWS}) AS v(iri, kind) ON o = v.iri WHERE p = {q(S.TYPE)} AND s_kind = 'iri') WHERE name NOT IN ('', 'Thing', 'Nothing'))"


@query("A7_W12_entities", sql(f"SELECT * FROM {ENTITY_SQL}", "triples"))
def a7_entities(spark, d):
    return P.entities(corpus(spark, d))


EXPRESSIVITY_SQL = f"""SELECT artifact_id, (CASE WHEN bool_or(p = '{OWL}someValuesFrom') THEN 'ALE' ELSE 'AL' END) || CASE WHEN bool_or(p = '{OWL}unionOf') THEN 'U' ELSE '' END || CASE WHEN bool_or(p = '{OWL}complementOf') THEN 'C' ELSE '' END
  || CASE WHEN bool_or(p IN {_in(P.CARDINALITIES)}) THEN 'N' ELSE '' END || CASE WHEN bool_or(p = '{OWL}inverseOf') THEN 'I' ELSE '' END || CASE WHEN bool_or(p = {q(S.SUBPROPERTY)}) THEN 'H' ELSE '' END
  || CASE WHEN bool_or(p = {q(S.TYPE)} AND o = '{OWL}TransitiveProperty') THEN 'R+' ELSE '' END || CASE WHEN bool_or(p = {q(S.TYPE)} AND o = '{OWL}FunctionalProperty') THEN 'F' ELSE '' END || CASE WHEN bool_or(p = '{OWL}oneOf') THEN 'O' ELSE '' END AS expressivity
  FROM triples GROUP BY artifact_id"""


@query("A8_expressivity", sql(EXPRESSIVITY_SQL, "triples"))
def a8(spark, d):
    return P.expressivity(corpus(spark, d))


PROFILE_SQL = f"""SELECT x.artifact_id, coalesce(h.iri, '') AS ontology_iri, coalesce({local('h.iri')}, 'Unknown Ontology') AS ontology_name,
  coalesce(e.c, 0) AS classes, coalesce(e.o, 0) AS object_properties, coalesce(e.dp, 0) AS data_properties, coalesce(e.i, 0) AS individuals, coalesce(e.an, 0) AS annotation_properties,
  coalesce(ax.n, 0) AS axiom_count, coalesce(im.n, 0) AS imports, x.expressivity FROM ({EXPRESSIVITY_SQL}) x
  LEFT JOIN (SELECT artifact_id, count(*) FILTER (WHERE kind = 'class') AS c, count(*) FILTER (WHERE kind = 'object_property') AS o, count(*) FILTER (WHERE kind = 'data_property') AS dp,
     count(*) FILTER (WHERE kind = 'individual') AS i, count(*) FILTER (WHERE kind = 'annotation_property') AS an FROM {ENTITY_SQL} GROUP BY artifact_id) e USING (artifact_id)
  LEFT JOIN (SELECT artifact_id, count(*) AS n FROM triples WHERE p IN {_in([p for p, _, _ in P.AXIOM_KINDS])} AND s_kind = 'iri' AND o_kind = 'iri' GROUP BY artifact_id) ax USING (artifact_id)
  LEFT JOIN (SELECT artifact_id, count(*) AS n FROM triples WHERE p = '{OWL}imports' GROUP BY artifact_id) im USING (artifact_id)
  LEFT JOIN (SELECT artifact_id, min(s) AS iri FROM triples WHERE p = {q(S.TYPE)} AND o = '{OWL}Ontology' GROUP BY artifact_id) h USING (artifact_id)"""


@query("A7_W11_profile", sql(PROFILE_SQL, "triples"))
def a7(spark, d):
    return P.profile(corpus(spark, d))


# == gate =================================================================================

ONE = "'' AS iri, '' AS suggested_rewrite"
TBOX_COUNTS = COUNT_SQL.replace("triples", "tbox")
STRUCTURAL_SQL = f"""SELECT artifact_id, 'A' AS stage, code, message, {ONE} FROM (
  SELECT artifact_id, 'E_NO_AXIOMS' AS code, 'Artifact has 0 logical axioms (declarations and labels do not count).' AS message FROM cnt WHERE axioms <= 0
  UNION ALL SELECT artifact_id, 'E_FLAT', 'No non-trivial rdfs:subClassOf axioms.' FROM cnt WHERE "subClassOf" <= 0
  UNION ALL SELECT artifact_id, 'E_FLAT', 'No owl:ObjectProperty declared.' FROM cnt WHERE "objectProperties" <= 0
  UNION ALL SELECT artifact_id, 'E_FLAT', 'Object properties are declared but never used in any axiom or assertion (declarations alone do not satisfy A3).' FROM cnt WHERE "objectProperties" > 0 AND "objectPropertyAxioms" <= 0
  UNION ALL SELECT artifact_id, 'E_BLOATED', classes || ' classes exceeds kernel x max_factor (10 x 4 = 40).' FROM cnt WHERE classes > 40)"""
ANCHOR_SQL = f"""SELECT artifact_id, 'A' AS stage, 'E_NO_BFO' AS code, 'BFO anchor(s) absent or unpopulated: ' || missing || '. Bare BFO fragment stubs with nothing under them fail A4.' AS message, {ONE} FROM ({MISSING_SQL})"""
ANTI_SQL = f"""SELECT artifact_id, 'A' AS stage, 'E_ANTIPATTERN' AS code, CASE kind WHEN 'privation' THEN '''' || name || ''' names a privation class. Failure/absence must be a typology instance, not a named class.'
  ELSE '''' || name || ''' is a compound class bundling several concepts; decompose it.' END AS message, name AS iri, CASE kind WHEN 'privation' THEN 'instance of a contradiction/failure type, not class ' || name ELSE '' END AS suggested_rewrite
  FROM (SELECT artifact_id, name, CASE WHEN {PRIVATE} THEN 'privation' WHEN {COMPOUND} THEN 'compound' END AS kind FROM (SELECT artifact_id, {short('cls')} AS name FROM declared)) WHERE kind IS NOT NULL"""


@query("GA1_GA5_structure", sql(f"WITH cnt AS ({TBOX_COUNTS}) {STRUCTURAL_SQL}", "tbox"))
def ga15(spark, d):
    g = gate_inputs(spark, d)
    return G.structural_findings(g.counts, g.kernel)


@query("GA_structure_of_corpus", sql(f"WITH cnt AS ({COUNT_SQL}) {STRUCTURAL_SQL}", "triples"))
def ga_corpus(spark, d):
    return G.structural_findings(C.counts(corpus(spark, d), Workspace(spark)), builtin_kernel())


@query("GA4_anchor_findings", sql(ANCHOR_SQL, "entry_k", "declared", "up_anc"))
def ga4(spark, d):
    g = gate_inputs(spark, d)
    return G.anchor_findings(G.missing_anchors(g.counts.select("artifact_id"), G.populated_anchors(g.triples, g.entries, g.upper)))


@query("GA6_antipatterns", sql(ANTI_SQL, "declared"))
def ga6(spark, d):
    return G.antipattern_findings(gate_inputs(spark, d).classes)


EMPTY_MSG = "SELECT artifact_id, 'C' AS stage, 'E_INCONSISTENT' AS code, 'Class is unsatisfiable (equivalent to owl:Nothing): ' || cls AS message, cls AS iri, '' AS suggested_rewrite FROM empty_k WHERE NOT ends_with(cls, 'Nothing')"
# Entailed over artifact, kernel and upper ontology, less what the asserted closure holds.
NOVEL = (f"novel AS (SELECT DISTINCT x.artifact_id, x.child AS cls, x.ancestor FROM (SELECT * FROM ruled_k_clo UNION SELECT r.artifact_id, r.child, u.ancestor FROM ruled_k_clo r JOIN up_anc u ON u.iri = r.ancestor) x "
         "JOIN declared dc ON dc.artifact_id = x.artifact_id AND dc.cls = x.child WHERE x.child <> x.ancestor AND NOT ends_with(x.ancestor, 'Thing') "
         "AND NOT EXISTS (SELECT 1 FROM clo_k c WHERE c.artifact_id = x.artifact_id AND c.child = x.child AND c.ancestor = x.ancestor))")
NOVEL_NEEDS = ("ruled_k_clo", "clo_k", "declared", "up_anc")


def novelty(spark, d):
    def build():
        g = gate_inputs(spark, d)
        return G.novelty(g.ws.table(M.rule_edges(g.triples, g.ws, g.edges).select(*W.EDGE), "ruled"), g)

    return shared(spark, d, "novelty", build)


@query("GC1_unsatisfiable_findings", sql(EMPTY_MSG, "empty_k"))
def gc1(spark, d):
    return G.stage_c(gate_inputs(spark, d, "unsat", "entries"))


@query("GC2_novel_subsumptions", sql(f"WITH {NOVEL} SELECT artifact_id, count(*) AS novel, count(*) FILTER (WHERE NOT {IS_UP.format('ancestor')}) AS novel_below_upper FROM novel GROUP BY artifact_id", *NOVEL_NEEDS))
def gc2(spark, d):
    return novelty(spark, d).counts().groupBy("artifact_id").agg(F.sum("n").alias("novel"), F.sum("below").alias("novel_below_upper"))


@query("W6_novelty_examples", sql(f"WITH {NOVEL} SELECT artifact_id, cls, string_agg(ancestor, ' ' ORDER BY ancestor) AS inferred FROM (SELECT *, dense_rank() OVER (PARTITION BY artifact_id ORDER BY cls) AS dr, "
       "row_number() OVER (PARTITION BY artifact_id, cls ORDER BY ancestor) AS rn FROM novel) WHERE dr <= 5 AND rn <= 3 GROUP BY artifact_id, cls", *NOVEL_NEEDS))
def w6(spark, d):
    n = G.first_novel(novelty(spark, d), gate_inputs(spark, d).ws)
    return G.novelty_examples(n).select("artifact_id", "cls", F.array_join("inferred", " ").alias("inferred"))


D4_SQL = f"""SELECT artifact_id, 'D' AS stage, 'E_ANTIPATTERN' AS code, 'D4 - no AbsenceOf*/Lack*/Failure* named class (failure must be an instance): ' || cls AS message, cls AS iri, '' AS suggested_rewrite FROM
  (SELECT DISTINCT artifact_id, s AS cls FROM tbox WHERE p = {q(S.TYPE)} AND o = {q(S.CLASS)} AND s_kind = 'iri'
  AND regexp_matches({short('s')}, {q(G.D4_NAMES)}))"""


@query("GD_W5_competency", sql(D4_SQL, "tbox"))
def gd(spark, d):
    return G.competency_findings(gate_inputs(spark, d))[0]


@query("GD1_norm_individuals", sql(f"SELECT a.artifact_id, count(*) AS norm_individuals, 0::BIGINT AS violations FROM abox a JOIN (SELECT DISTINCT artifact_id, s FROM abox WHERE p = {q(S.SUBCLASS)} AND o = {q(KERNEL_NS + 'Norm')}) n "
       f"ON a.artifact_id = n.artifact_id AND a.o = n.s WHERE a.p = {q(S.TYPE)} GROUP BY a.artifact_id", "abox"))
def gd1(spark, d):
    def build():
        ws, t = Workspace(spark), abox(spark, d)
        return G.GateInputs(t, t.select("artifact_id").distinct(), builtin_kernel(), builtin_upper(), ws)

    g = shared(spark, d, "gate_abox", build)
    norm = g.reach.where(F.col("target") == G.NORM).select("artifact_id", F.col("cls").alias("o"))
    typed = g.triples.where(F.col("p") == S.TYPE).join(norm, ["artifact_id", "o"], "left_semi")
    bad = G.norms_are_dependent(g).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("v"))
    n = typed.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("norm_individuals"))
    return n.join(bad, "artifact_id", "left").select("artifact_id", "norm_individuals", F.coalesce("v", F.lit(0)).cast("bigint").alias("violations"))


@query("GDx_shapes", sql(f"SELECT artifact_id, s AS offender, {q(CONTAINS)} AS path, 'maxCount' AS constraint FROM abox WHERE p = {q(CONTAINS)} GROUP BY artifact_id, s HAVING count(*) > 6 "
       f"UNION ALL SELECT a.artifact_id, a.s, {q(CONTAINS)}, 'minCount' FROM abox a WHERE a.p = {q(S.TYPE)} AND a.o IN ({', '.join(q(EX + 'status/' + x) for x in 'FOP')}) AND NOT EXISTS (SELECT 1 FROM abox b WHERE b.p = {q(CONTAINS)} AND b.artifact_id = a.artifact_id AND b.s = a.s) "
       f"UNION ALL SELECT a.artifact_id, a.s, {q(PLACED_BY)}, 'class' FROM abox a JOIN abox t ON t.artifact_id = a.artifact_id AND t.s = a.s AND t.p = {q(S.TYPE)} AND t.o = {q(EX + 'status/P')} WHERE a.p = {q(PLACED_BY)} AND NOT EXISTS "
       f"(SELECT 1 FROM abox c WHERE c.artifact_id = a.artifact_id AND c.s = a.o AND c.p = {q(S.TYPE)} AND c.o = {q(EX + 'segment/BUILDING')})", "abox"))
def gdx(spark, d):
    t = abox(spark, d)
    rows = [(EX + "status/" + x, CONTAINS, 1, 6, None, None, None) for x in "FOP"] + [(EX + "status/P", PLACED_BY, None, None, EX + "segment/BUILDING", None, None)]
    shapes = constant_table(spark, "target_class string, path string, min_count int, max_count int, value_class string, datatype string, pattern string", rows)
    types = t.where((F.col("p") == S.TYPE) & (F.col("s_kind") == "iri")).select("artifact_id", F.col("s").alias("ind"), F.col("o").alias("cls"))
    return G.shape_violations(t, shapes, types)


def fixed(spark, d):
    def build():
        ws, t = Workspace(spark), tbox(spark, d)
        out, removed = R.fix_all(t, lint(spark, d))
        return ws.table(out, "fixed"), ws.table(removed, "removed")

    return shared(spark, d, "fixed", build)


GONE = "gone AS (SELECT DISTINCT l.artifact_id, l.class_iri AS cls, l.drop_iri FROM lint l JOIN edges e ON e.artifact_id = l.artifact_id AND e.child = l.class_iri AND e.parent = l.drop_iri)"


@query("GE_delta_unlogged", sql(f"WITH {GONE}, base AS ({TBOX_COUNTS}) SELECT artifact_id, 'E' AS stage, 'E_OVER_RELAXED' AS code, 'Axiom count dropped from ' || axioms || ' to ' || (axioms - n) || ', more than the 0 logged removal(s) account for (floor ' || axioms || ').' AS message, {ONE} "
       "FROM base JOIN (SELECT artifact_id, count(*) AS n FROM gone GROUP BY artifact_id) USING (artifact_id)", "lint", "edges"))
def ge(spark, d):
    after = C.counts(fixed(spark, d)[0])
    none = spark.createDataFrame([], "artifact_id string, n_logged bigint, n_property bigint")
    return G.delta_findings(after, gate_inputs(spark, d).counts, none)


@query("GE_delta_logged", sql("SELECT artifact_id, 'E' AS stage, '' AS code, '' AS message, '' AS iri, '' AS suggested_rewrite FROM tbox WHERE 1 = 0", "tbox"))
def ge_logged(spark, d):
    out, removed = fixed(spark, d)
    return R.delta_guard(tbox(spark, d), out, R.quarantine(removed))


def gate_run(spark, d):
    return shared(spark, d, "gate_run", lambda: GP.check(tbox(spark, d), all_stages=True))


@query("Grun_stages_halted", sql(f"WITH a AS ({ANTI_SQL}), bad AS (SELECT DISTINCT artifact_id FROM a) SELECT b.artifact_id, v.stage, v.stage <> 'A' AS passed, CASE v.stage WHEN 'A' THEN '' WHEN 'E' THEN {q(GP.NO_BASELINE)} ELSE 'halted at A' END AS skipped FROM bad b, (VALUES ('A'),('B'),('C'),('D'),('E')) AS v(stage)", "declared"))
def grun(spark, d):
    # Every artifact carries an anti-pattern class, so all of them stop at A.
    return GP.check(tbox(spark, d)).stages


FAILURES = f"""fails AS (SELECT artifact_id, stage, code, count(*) AS n FROM (
  SELECT artifact_id, stage, code FROM ({STRUCTURAL_SQL}) UNION ALL SELECT artifact_id, stage, code FROM ({ANCHOR_SQL}) UNION ALL SELECT artifact_id, stage, code FROM ({ANTI_SQL})
  UNION ALL SELECT artifact_id, 'B', 'E_ORPHAN' FROM {ORPHANS}
  UNION ALL SELECT artifact_id, 'B', 'E_DISJOINT' FROM pairs_k JOIN domain USING (artifact_id, cls)
  UNION ALL SELECT artifact_id, 'B', 'E_MISTYPED' FROM ({ORACLES['J11_mistyped'][ORACLES['J11_mistyped'].index("SELECT c.artifact_id, 'B' AS stage"):]})
  UNION ALL SELECT artifact_id, stage, code FROM ({EMPTY_MSG}) UNION ALL SELECT artifact_id, stage, code FROM ({D4_SQL})) GROUP BY artifact_id, stage, code)"""
FAIL_NEEDS = ("entry_k", "declared", "up_anc", "domain", "pairs_k", "clo_k", "kernel_class", "kernel_edge", "up_class", "up_clash", "empty_k")


@query("Grun_failures", sql(f"WITH cnt AS ({TBOX_COUNTS}), {FAILURES} SELECT * FROM fails", *FAIL_NEEDS))
def grun_failures(spark, d):
    return gate_run(spark, d).failures()


@query("A13_verdicts", sql(f"WITH cnt AS ({TBOX_COUNTS}), {FAILURES} SELECT artifact_id, 'fail' AS verdict FROM fails GROUP BY artifact_id", *FAIL_NEEDS))
def a13(spark, d):
    return gate_run(spark, d).verdicts()


@query("A14_suggested_rewrites", sql(f"SELECT artifact_id, iri AS key, suggested_rewrite AS rewrite FROM ({ANTI_SQL}) WHERE suggested_rewrite <> '' UNION ALL "
       f"SELECT artifact_id, cls, 'add subClassOf to the BFO category that fits ' || {short('cls')} FROM {ORPHANS}", "declared", "domain", "entry_k"))
def a14(spark, d):
    return gate_run(spark, d).suggested_rewrites()


@query("A14_antipattern_hits", sql(f"SELECT artifact_id, iri AS name FROM ({ANTI_SQL})", "declared"))
def a14_hits(spark, d):
    return gate_run(spark, d).antipattern_hits()


@query("S10_reports_json", sql(f"WITH cnt AS ({TBOX_COUNTS}) SELECT artifact_id, 'kernel/0.1' AS kernel_version, 'fail' AS verdict, classes, axioms FROM cnt", "tbox"))
def s10(spark, d):
    from quercus.sources.sinks import write_reports

    ws = Workspace(spark)
    out = ws.path("reports")
    reports = gate_run(spark, d).reports()
    write_reports(reports, out)
    back = spark.read.schema(reports.schema).json(out)
    return back.select("artifact_id", "kernel_version", "verdict", "counts.classes", "counts.axioms")


@query("Gtax_failures_by_description", sql(f"WITH cnt AS ({TBOX_COUNTS}), {FAILURES}, tax AS (SELECT * FROM (VALUES {', '.join(f'({q(c)}, {q(t)}, {q(s)})' for c, t, s in G.TAXONOMY)}) AS v(code, description, home)) "
       "SELECT code, description, home AS stage, coalesce(sum(n), 0)::BIGINT AS failures FROM tax LEFT JOIN fails USING (code) GROUP BY ALL", *FAIL_NEEDS))
def gtax(spark, d):
    f = gate_run(spark, d).failures().groupBy("code").agg(F.sum("n").alias("n"))
    return G.taxonomy(spark).join(f, "code", "left").select("code", "description", "stage", F.coalesce("n", F.lit(0)).cast("bigint").alias("failures"))


# == repair ===================================================================================


@query("R1_drop_choices", sql("SELECT DISTINCT artifact_id, category_a_iri, category_b_iri, drop_iri FROM lint", "lint"))
def r1(spark, d):
    return lint(spark, d).select("artifact_id", "category_a_iri", "category_b_iri", "drop_iri").distinct()


REQUESTS = f"""req AS (SELECT p_brand AS artifact_id, {q(EX + 'part/P')} || p_partkey AS cls, CASE p_type WHEN 'LARGE' THEN {q(EX + 'type/LARGE')} WHEN 'ECONOMY' THEN {q(UP + '0000040')} WHEN 'SMALL' THEN {q(UP + '0000029')} ELSE {q(UP + '0000016')} END AS drop_iri FROM part
  UNION ALL SELECT DISTINCT artifact_id, class_iri, drop_iri FROM lint WHERE category_a = 'process')"""


@query("R2_J19_requested_drops", sql(f"WITH {REQUESTS} SELECT r.artifact_id, r.cls, r.drop_iri, CASE WHEN NOT {IS_UP.format('r.drop_iri')} THEN {q(R.NOT_UPPER)} "
       "WHEN NOT EXISTS (SELECT 1 FROM lint l WHERE l.artifact_id = r.artifact_id AND l.class_iri = r.cls AND r.drop_iri IN (l.category_a_iri, l.category_b_iri)) THEN 'No matching straddle finding' "
       f"WHEN NOT EXISTS (SELECT 1 FROM edges e WHERE e.artifact_id = r.artifact_id AND e.child = r.cls AND e.parent = r.drop_iri) THEN {q(R.NOT_THERE)} ELSE '' END AS reason FROM req r", "lint", "edges"))
def r2(spark, d):
    found = lint(spark, d)
    drop = F.expr(f"CASE p_type WHEN 'LARGE' THEN '{EX}type/LARGE' WHEN 'ECONOMY' THEN '{UP}0000040' WHEN 'SMALL' THEN '{UP}0000029' ELSE '{UP}0000016' END")
    asked = read(spark, d, "part").select(F.col("p_brand").alias("artifact_id"), F.concat(F.lit(EX + "part/P"), "p_partkey").alias("cls"), drop.alias("drop_iri"))
    more = found.where("category_a = 'process'").select("artifact_id", F.col("class_iri").alias("cls"), "drop_iri").distinct()
    return R.judge_requests(asked.union(more), tbox(spark, d), found)


@query("R3_fix_all", sql(f"WITH {GONE} SELECT artifact_id, cls, drop_iri FROM gone", "lint", "edges"))
def r3(spark, d):
    return fixed(spark, d)[1].select("artifact_id", "cls", "drop_iri")


@query("R3_fixed_edges", sql(f"WITH {GONE} SELECT artifact_id, child, parent FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.artifact_id = e.artifact_id AND g.cls = e.child AND g.drop_iri = e.parent)", "lint", "edges"))
def r3_edges(spark, d):
    return W.subclass_edges(fixed(spark, d)[0])


@query("R4_W10_budgeted_removals", sql(f"""WITH base AS ({TBOX_COUNTS}), first AS (SELECT l.artifact_id, l.class_iri AS cls, l.drop_iri, min((l.category_a_iri, l.category_b_iri)) AS f FROM lint l JOIN edges e ON e.artifact_id = l.artifact_id AND e.child = l.class_iri AND e.parent = l.drop_iri GROUP BY ALL)
  SELECT f.artifact_id, cls, drop_iri, rn AS rank, bound, n_findings FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY cls, f) AS rn FROM first) f
  JOIN (SELECT artifact_id, greatest(1, floor(axioms * 0.02))::BIGINT AS bound FROM base) b USING (artifact_id) JOIN (SELECT artifact_id, count(*) AS n_findings FROM lint GROUP BY artifact_id) USING (artifact_id) WHERE rn <= bound""", "lint", "edges"))
def r4(spark, d):
    out = R.budgeted_removals(tbox(spark, d), lint(spark, d), gate_inputs(spark, d).counts, Workspace(spark))
    return out.select("artifact_id", "cls", "drop_iri", "rank", "bound", "n_findings")


@query("S11_quarantine_notes", sql(f"WITH {GONE} SELECT artifact_id, 'SubClassOf(' || {short('cls')} || ' ' || {short('drop_iri')} || ')' AS axiom, 'subclass_edge' AS kind, cls || ' ' || {q(S.SUBCLASS)} || ' ' || drop_iri AS axiom_iri FROM gone", "lint", "edges"))
def s11(spark, d):
    from quercus.sources.sinks import append_quarantine

    out = Workspace(spark).path("quarantine")
    append_quarantine(R.quarantine(fixed(spark, d)[1]), out)
    return spark.read.parquet(out).select("artifact_id", "axiom", "kind", F.array_join("axiom_iri", " ").alias("axiom_iri"))


@query("R4_repair_status", sql("SELECT DISTINCT artifact_id, 'unchanged' AS status FROM tbox", "tbox"))
def r4_status(spark, d):
    # All artifacts stop at stage A here, and repair leaves such artifacts alone.
    return R.repair(tbox(spark, d), builtin_upper(), Workspace(spark)).status.select("artifact_id", "status")


@query("R6_relint_after_fix", sql("SELECT artifact_id, cls AS class_iri, a AS category_a_iri, b AS category_b_iri FROM pairs_f", "pairs_f"))
def r6(spark, d):
    found = L.straddle_lint(fixed(spark, d)[0], builtin_upper(), Workspace(spark))
    return found.select("artifact_id", "class_iri", "category_a_iri", "category_b_iri")


@query("R6_published_versions", sql("SELECT g.artifact_id AS parent_id, g.artifact_id || '.autofixed' AS artifact_id, g.removed, coalesce(l.n, 0) AS lint_findings, coalesce(u.n, 0) AS unsatisfiable_classes, "
       "CASE WHEN u.n > 0 THEN 'incoherent' ELSE 'coherent' END AS coherence_status FROM (SELECT artifact_id, count(*) AS removed FROM gone GROUP BY artifact_id) g "
       "LEFT JOIN (SELECT artifact_id, count(*) AS n FROM pairs_f GROUP BY artifact_id) l USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n FROM empty_f GROUP BY artifact_id) u USING (artifact_id)",
       "gone", "pairs_f", "empty_f"))
def r6_versions(spark, d):
    from quercus.plans.analysis import publish_fixes

    out = publish_fixes(tbox(spark, d), lint(spark, d), builtin_upper(), Workspace(spark))
    rows = out.analysis.rows.select("artifact_id", "lint_findings", "unsatisfiable_classes", "coherence_status")
    return out.lineage.select("parent_id", "artifact_id", "removed").join(rows, "artifact_id")


# == rules ======================================================================================


@query("M1_class_hierarchy", sql("SELECT artifact_id, child, ancestor FROM ruled_clo WHERE child <> ancestor", "ruled_clo"))
def m1(spark, d):
    return M.class_hierarchy(tbox(spark, d), Workspace(spark))


INFERRED = (f"SELECT artifact_id, child, ancestor FROM ruled_clo r WHERE child <> ancestor AND NOT {IS_UP.format('child')} AND ancestor <> {q(S.THING)} "
            "AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.artifact_id = r.artifact_id AND e.child = r.child AND e.parent = r.ancestor)")


DERIVED = f"""inf AS ({INFERRED}), rr AS (SELECT artifact_id, child, parent, min(rule) AS rule FROM (SELECT artifact_id, child, parent, 'scm-sco' AS rule FROM edges
    UNION ALL SELECT artifact_id, s, o, 'scm-eqc' FROM tbox WHERE p = {q(S.EQUIVALENT)} AND o_kind = 'iri' UNION ALL SELECT artifact_id, o, s, 'scm-eqc' FROM tbox WHERE p = {q(S.EQUIVALENT)} AND o_kind = 'iri') GROUP BY artifact_id, child, parent),
  last AS (SELECT c.artifact_id, c.child, r.parent AS ancestor, min(r.child) AS via, arg_min(r.rule, r.child) AS rule FROM (SELECT artifact_id, child, ancestor FROM ruled_clo UNION SELECT artifact_id, child, child FROM rr) c
    JOIN rr r ON r.artifact_id = c.artifact_id AND r.child = c.ancestor GROUP BY c.artifact_id, c.child, r.parent)"""


@query("J14_M6_inferred_axioms", sql(f"WITH {DERIVED} SELECT i.artifact_id, 'SubClassOf' AS axiom_type, {local('i.child')} || ' ⊑ ' || {local('i.ancestor')} AS description, l.rule, "
       f"CASE WHEN l.via <> i.child THEN {local('i.child')} || ' ⊑ ' || {local('l.via')} || '; ' ELSE '' END || {local('l.via')} || ' ⊑ ' || {local('i.ancestor')} AS supporting_facts, 'rules' AS origin, i.child, i.ancestor "
       "FROM inf i JOIN last l ON l.artifact_id = i.artifact_id AND l.child = i.child AND l.ancestor = i.ancestor "
       f"UNION ALL SELECT c.artifact_id, 'EquivalentClass', {local('c.child')} || ' ≡ ' || {local('c.ancestor')}, 'scm-eqc2', {local('c.child')} || ' ⊑ ' || {local('c.ancestor')} || '; ' || {local('c.ancestor')} || ' ⊑ ' || {local('c.child')}, 'rules', c.child, c.ancestor "
       "FROM ruled_clo c JOIN ruled_clo b ON b.artifact_id = c.artifact_id AND b.child = c.ancestor AND b.ancestor = c.child WHERE c.child < c.ancestor AND NOT EXISTS "
       f"(SELECT 1 FROM tbox t WHERE t.artifact_id = c.artifact_id AND t.p = {q(S.EQUIVALENT)} AND least(t.s, t.o) = c.child AND greatest(t.s, t.o) = c.ancestor)", "ruled_clo"))
def j14(spark, d):
    ws, t = Workspace(spark), tbox(spark, d)
    ruled = ws.table(M.rule_edges(t, ws), "ruled")
    hierarchy = ws.table(W.closure(ruled.select(*W.EDGE), ws).where("child <> ancestor"), "hierarchy")
    return M.derivations(M.inferred_subsumptions(t, ws, hierarchy), M.inferred_equivalences(t, hierarchy), ruled, hierarchy)


@query("J15_hierarchy_diff", sql(f"SELECT DISTINCT artifact_id, {local('child')} AS name, {local('ancestor')} AS parent FROM ruled_clo r WHERE child <> ancestor AND NOT EXISTS "
       f"(SELECT 1 FROM edges e WHERE e.artifact_id = r.artifact_id AND {local('e.child')} = {local('r.child')} AND {local('e.parent')} = {local('r.ancestor')})", "ruled_clo"))
def j15(spark, d):
    def named(df, up):
        return df.select("artifact_id", N.local_name(F.col("child")).alias("name"), N.local_name(F.col(up)).alias("parent")).distinct()

    t = tbox(spark, d)
    after = named(M.class_hierarchy(t, Workspace(spark)), "ancestor")
    return after.join(named(W.subclass_edges(t), "parent"), ["artifact_id", "name", "parent"], "left_anti")


# The list of inferred axioms that a client is sent.
CAP = 5000


@query("W7_capped_inferences", sql(f"WITH inf AS ({INFERRED}) SELECT artifact_id, child, ancestor, total FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY child, ancestor) AS rn, count(*) OVER (PARTITION BY artifact_id) AS total FROM inf) WHERE rn <= {CAP}", "ruled_clo"))
def w7(spark, d):
    return M.first_inferred(tbox(spark, d), CAP, Workspace(spark))


ABOX_EDGES = f"ae AS (SELECT DISTINCT artifact_id, s AS child, o AS parent FROM abox WHERE {NAMED_EDGE})"
ENTAILED = f"""ent AS (SELECT artifact_id, s, p, o, min(rule) AS rule FROM (
  SELECT artifact_id, s, p, o, 'asserted' AS rule FROM abox WHERE p IN ({q(CONTAINS)}, {q(PLACED_BY)})
  UNION ALL SELECT artifact_id, s, {q(EX + 'prop#involves')}, o, 'prp-spo1' FROM abox WHERE p = {q(PLACED_BY)}
  UNION ALL SELECT artifact_id, o, {q(EX + 'prop#containedIn')}, s, 'prp-inv' FROM abox WHERE p = {q(CONTAINS)}) GROUP BY ALL)"""
TYPES = f"""typ AS (SELECT artifact_id, ind, cls, min(rule) AS rule FROM (
  SELECT artifact_id, s AS ind, o AS cls, 'asserted' AS rule FROM abox WHERE p = {q(S.TYPE)} AND NOT starts_with(o, {q(S.OWL)})
  UNION ALL SELECT a.artifact_id, a.s, e.parent, 'cax-sco' FROM abox a JOIN ae e ON e.artifact_id = a.artifact_id AND e.child = a.o WHERE a.p = {q(S.TYPE)}
  UNION ALL SELECT artifact_id, o, {q(UP + '0000040')}, 'prp-rng' FROM ent WHERE p IN ({q(CONTAINS)}, {q(PLACED_BY)})
  UNION ALL SELECT artifact_id, s, {q(UP + '0000015')}, 'prp-dom' FROM ent WHERE p = {q(CONTAINS)}) GROUP BY artifact_id, ind, cls)"""


def entailed(spark, d):
    def build():
        ws = Workspace(spark)
        return ws.table(M.entailed_assertions(abox(spark, d), ws), "entailed")

    return shared(spark, d, "entailed", build)


@query("M2_entailed_assertions", sql(f"WITH {ENTAILED} SELECT p, rule, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM ent GROUP BY p, rule", "abox"))
def m2(spark, d):
    return entailed(spark, d).groupBy("p", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


@query("M2_entailed_types", sql(f"WITH {ABOX_EDGES}, {ENTAILED}, {TYPES} SELECT artifact_id, ind, cls, rule FROM typ", "abox"))
def m2_types(spark, d):
    return M.entailed_types(abox(spark, d), Workspace(spark))


@query("M3_J13_unsatisfiable_classes", sql("WITH " + ROOTS + f""", msg AS (SELECT artifact_id, class_name, arg_max(message, class_iri || ' ' || category_a_iri || ' ' || category_b_iri) AS text FROM ({LINT_SQL}) GROUP BY artifact_id, class_name)
  SELECT e.artifact_id, e.cls, {short('e.cls')} AS name, coalesce(m.text, {q(M.NOT_JUSTIFIED)}) AS justification FROM empty e LEFT JOIN msg m ON m.artifact_id = e.artifact_id AND m.class_name = {short('e.cls')}""", "lint", "up_anc", "empty"))
def m3(spark, d):
    return M.justified(unsat(spark, d), lint(spark, d))


@query("M3_unsatisfiable_reasons", sql("SELECT artifact_id, cls, reason FROM empty", "empty"))
def m3_reasons(spark, d):
    return unsat(spark, d)


BAD_IND = f"bad AS (SELECT DISTINCT l.artifact_id, l.ind, 'cax-dw' AS rule FROM typ l JOIN typ r ON l.artifact_id = r.artifact_id AND l.ind = r.ind JOIN up_clash c ON c.a = l.cls AND c.b = r.cls)"


@query("M4_inconsistent_individuals", sql(f"WITH {ABOX_EDGES}, {ENTAILED}, {TYPES}, {BAD_IND} SELECT artifact_id, ind, rule FROM bad", "abox", "up_clash"))
def m4(spark, d):
    return M.inconsistent_individuals(abox(spark, d), builtin_upper(), Workspace(spark))


# class expressions of every form: what has to follow is known from a part's key, not from another reasoner
EXPR_PART = f"forms AS (SELECT DISTINCT 'expr-' || p_brand AS artifact_id, CAST(p_partkey AS VARCHAR) AS key, p_partkey % 12 AS form FROM part)"


def _of_forms(columns, rows):
    """SQL rows of (form, values) pairs, over the parts of each form; a value is SQL text over ``key``."""
    return " UNION ALL ".join(f"SELECT artifact_id, {', '.join(f'{v} AS {c}' for c, v in zip(columns, values, strict=True))} FROM forms WHERE form = {form}" for form, values in rows)


def _made(mark):
    return f"'http://example.org/expr#{mark}' || key"


EXPR_EMPTY = [
    *[(form, (_made("P"), f"'{reason}'")) for form, reason in ((0, "asserted"), (1, "asserted"), (2, "inherited"), (3, "asserted"), (4, "asserted"), (5, "inherited"), (6, "asserted"),
                                                                (8, "inherited"), (9, "asserted"), (10, "inherited"))],
    (8, (_made("L"), "'asserted'")), (8, (_made("M"), "'asserted'")), (10, (_made("L"), "'asserted'")),
]
EXPR_TYPES = [
    (form, (_made(who), f"'http://example.org/expr#{cls}'", f"'{rule}'"))
    for form, who, rule, names in (
        (0, "I", "asserted", "Hot Wet"), (0, "I", "cls-int1", "HotWet"), (1, "I", "asserted", "Hot Wet Allowed"), (1, "I", "cls-int1", "HotWet"),
        (2, "I", "cls-svf1", "Carrier"), (2, "I", "cls-svf2", "Any"), (2, "J", "asserted", "Wet"),
        (3, "I", "cls-svf1", "Holder"), (3, "I", "cls-svf2", "Any"), (3, "J", "asserted", "Hot"),
        (4, "I", "cls-svf1", "Linked"), (4, "J", "cls-svf1", "Linked"), (4, "L", "asserted", "Core"),
        (5, "I", "prp-dom", "Active"), (5, "J", "prp-rng", "Passive"),
        (6, "I", "cls-svf1", "Carrier Holder Deep"), (6, "I", "cls-svf2", "Any"), (6, "J", "asserted", "Hot Wet"), (6, "J", "cls-int1", "HotWet"),
        (7, "I", "cls-hv2", "Fixed"), (7, "I", "cls-svf2", "Any"), (8, "I", "cax-sco", "Carrier Any"), (0, "M", "prp-rng", "End"), (11, "I", "asserted", "Hot Cold"),
    )
    for cls in names.split()
]
EXPR_BAD = [(1, (_made("I"), "'cax-dw'")), (9, (_made("I"), "'prp-irp'")), (10, (_made("I"), "'prp-asyp'")), (10, (_made("J"), "'prp-asyp'")), (11, (_made("I"), "'cax-dw'"))]


EXPR_LINKS = [
    (form, (_made(a), f"'http://example.org/expr#{p}'", _made(b), f"'{rule}'"))
    for form, a, p, b, rule in (
        (0, "I", "first", "J", "asserted"), (0, "J", "second", "L", "asserted"), (0, "L", "third", "M", "asserted"), (0, "I", "whole", "M", "prp-spo2"),
        (2, "I", "has", "J", "asserted"), (3, "I", "part", "J", "asserted"), (3, "I", "has", "J", "prp-spo1"),
        (4, "I", "inside", "J", "asserted"), (4, "J", "inside", "L", "asserted"), (4, "I", "inside", "L", "prp-trp"),
        (5, "I", "touches", "J", "asserted"), (6, "I", "has", "J", "asserted"), (9, "I", "beside", "I", "asserted"),
        (10, "I", "above", "J", "asserted"), (10, "J", "above", "I", "asserted"),
    )
] + [(7, (_made("I"), "'http://example.org/expr#has'", "'http://example.org/expr#fixed'", "'asserted'"))]


@query("M2_expression_assertions", f"WITH {EXPR_PART} " + _of_forms(("s", "p", "o", "rule"), EXPR_LINKS))
def m2_expression_links(spark, d):
    return M.entailed_assertions(load(spark, d, "expr"), Workspace(spark))


@query("M2_expression_types", f"WITH {EXPR_PART} " + _of_forms(("ind", "cls", "rule"), EXPR_TYPES))
def m2_expressions(spark, d):
    return M.entailed_types(load(spark, d, "expr"), Workspace(spark))


@query("M3_expression_unsatisfiable", f"WITH {EXPR_PART} " + _of_forms(("cls", "reason"), EXPR_EMPTY))
def m3_expressions(spark, d):
    return M.unsatisfiable_classes(load(spark, d, "expr"), builtin_upper(), Workspace(spark))


@query("M4_expression_individuals", f"WITH {EXPR_PART} " + _of_forms(("ind", "rule"), EXPR_BAD))
def m4_expressions(spark, d):
    return M.inconsistent_individuals(load(spark, d, "expr"), builtin_upper(), Workspace(spark))


@query("M5_coherence", sql(f"WITH {ABOX_EDGES}, {ENTAILED}, {TYPES}, {BAD_IND} SELECT a.artifact_id, coalesce(b.n, 0) AS inconsistent_individuals, coalesce(u.n, 0) AS unsatisfiable_classes, "
       "CASE WHEN b.n > 0 THEN 'inconsistent' WHEN u.n > 0 THEN 'incoherent' ELSE 'coherent' END AS coherence_status, 'rules' AS method FROM (SELECT DISTINCT artifact_id FROM triples) a "
       "LEFT JOIN (SELECT artifact_id, count(*) AS n FROM bad GROUP BY artifact_id) b USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n FROM empty GROUP BY artifact_id) u USING (artifact_id)", "triples", "up_clash", "empty"))
def m5(spark, d):
    things, artifacts = abox(spark, d), corpus(spark, d).select("artifact_id").distinct()
    done = Workspace.beside(bad=lambda: M.inconsistent_individuals(things, builtin_upper(), Workspace(spark)), empty=lambda: unsat(spark, d))
    return M.coherence(artifacts, done["empty"], done["bad"])


@query("M8_analysis_rows", sql(f"SELECT p.artifact_id, p.classes, p.axiom_count, p.expressivity, coalesce(l.n, 0) AS lint_findings, coalesce(u.n, 0) AS unsatisfiable_classes, coalesce(i.n, 0) AS inferred_axioms, "
       f"CASE WHEN u.n > 0 THEN 'incoherent' ELSE 'coherent' END AS coherence_status FROM ({PROFILE_SQL.replace('triples', 'tbox')}) p LEFT JOIN (SELECT artifact_id, count(*) AS n FROM lint GROUP BY artifact_id) l USING (artifact_id) "
       f"LEFT JOIN (SELECT artifact_id, count(*) AS n FROM empty GROUP BY artifact_id) u USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n FROM ({INFERRED}) GROUP BY artifact_id) i USING (artifact_id)", "tbox", "lint", "empty", "ruled_clo"))
def m8(spark, d):
    from quercus.plans.analysis import analyse

    rows = analyse(tbox(spark, d), builtin_upper(), Workspace(spark)).rows
    return rows.select("artifact_id", "classes", "axiom_count", "expressivity", "lint_findings", "unsatisfiable_classes", "inferred_axioms", "coherence_status")


@query("S13_S14_analysis_history", sql(f"SELECT artifact_id, classes, axiom_count FROM ({PROFILE_SQL.replace('triples', 'tbox')})", "tbox"))
def s13(spark, d):
    from quercus.sources.sinks import replace_analyses

    out = Workspace(spark).path("analyses")
    rows = P.profile(tbox(spark, d)).select("artifact_id", "classes", "axiom_count")
    replace_analyses(rows, out)
    replace_analyses(rows, out)  # the second run replaces the first
    return spark.read.parquet(out).select("artifact_id", "classes", "axiom_count")


@query("L2_property_chains", "SELECT DISTINCT 'expr-' || p_brand AS artifact_id, 'PropertyChain' AS premise_type, '∀x0,x1,x2,x3: (first(x0,x1) ∧ second(x1,x2) ∧ third(x2,x3)) → whole(x0,x3)' AS fol, "
       "'Following first and then second and then third leads along whole' AS description FROM part")
def l2_chains(spark, d):
    return PR.axiom_premises(load(spark, d, "expr"), Workspace(spark)).where("premise_type = 'PropertyChain'")


EXPR_LISTED = "listed AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY iri) AS i, count(*) OVER (PARTITION BY artifact_id) AS n FROM (SELECT DISTINCT 'expr-' || p_brand AS artifact_id, 'd' || p_partkey AS sym, 'http://example.org/expr#D' || p_partkey AS iri FROM part))"


@query("A9_long_list_pairs", f"WITH {EXPR_LISTED} SELECT artifact_id, CAST(any_value(n) * (any_value(n) - 1) // 2 + 6 AS BIGINT) AS n FROM listed GROUP BY artifact_id")
def a9_long(spark, d):
    return D.pair_counts(D.disjoint_groups(load(spark, d, "expr"), Workspace(spark)))


@query("F7_long_list_lines", f"WITH {EXPR_LISTED} SELECT artifact_id, CASE WHEN i = 1 THEN '  all X all T (instance_of(X,' || sym || ',T) -> one_of(X,g1_1,T)).' "
       "ELSE '  all X all T ((instance_of(X,' || sym || ',T) -> (one_of(X,g1_' || i || ',T) & -one_of(X,g1_' || (i - 1) || ',T))) & (one_of(X,g1_' || (i - 1) || ',T) -> one_of(X,g1_' || i || ',T))).' END || '  % asserted' AS line "
       "FROM listed WHERE n > 16")
def f7_long(spark, d):
    lines = TH.render(TH.build_theory(load(spark, d, "expr"), builtin_upper(), Workspace(spark)))
    return lines.where("section = 4 AND line LIKE '%one_of%'").select("artifact_id", "line")


# == theory ========================================================================================

TH_CLASSES = f"""tc AS (SELECT DISTINCT artifact_id, iri FROM (SELECT artifact_id, s AS iri FROM tbox WHERE p = {q(S.TYPE)} AND o = {q(S.CLASS)} AND s_kind = 'iri' UNION ALL SELECT artifact_id, child FROM edges UNION ALL SELECT artifact_id, parent FROM edges)
   WHERE {local('iri')} NOT IN ('Thing', 'Nothing', 'Class') UNION SELECT artifact_id, member FROM dis_group),
  tl AS (SELECT tc.*, coalesce(u.label, {local('tc.iri')}) AS label FROM tc LEFT JOIN up_class u ON u.iri = tc.iri),
  tk AS (SELECT artifact_id, iri, bool_or(ancestor = '{UP}0000002') AS c, bool_or(ancestor = '{UP}0000003') AS o FROM (SELECT e.artifact_id, e.cls AS iri, a.ancestor FROM entry e JOIN up_anc a ON a.iri = e.upper_iri WHERE NOT {IS_UP.format('e.cls')}
    UNION ALL SELECT tc.artifact_id, tc.iri, a.ancestor FROM tc JOIN up_anc a ON a.iri = tc.iri) GROUP BY artifact_id, iri),
  kinds AS (SELECT tl.artifact_id, tl.iri, tl.label, CASE WHEN c AND NOT o THEN 'continuant' WHEN o AND NOT c THEN 'occurrent' ELSE 'unknown' END AS kind FROM tl LEFT JOIN tk USING (artifact_id, iri)),
  tdis AS (SELECT artifact_id, a, b, 'asserted' AS origin FROM dis_pair UNION ALL SELECT l.artifact_id, x.a, x.b, 'bfo' FROM (SELECT DISTINCT artifact_id, parent AS c FROM edges) l JOIN up_clash x ON x.a = l.c JOIN (SELECT DISTINCT artifact_id, parent AS c FROM edges) r ON r.artifact_id = l.artifact_id AND r.c = x.b
    WHERE NOT EXISTS (SELECT 1 FROM dis_pair p WHERE p.artifact_id = l.artifact_id AND p.a = x.a AND p.b = x.b)),
  named AS (SELECT artifact_id, iri, label, 0 AS isp FROM tl UNION ALL SELECT DISTINCT artifact_id, s, {local('s')}, 1 FROM tbox WHERE p = {q(S.TYPE)} AND o = {q(S.OBJECT_PROPERTY)}),
  based AS (SELECT *, CASE WHEN b = '' THEN 'c' WHEN regexp_matches(b, '^[a-z]') THEN b ELSE 'c_' || b END AS base FROM (SELECT *, lower(regexp_replace(regexp_replace(label, '[^0-9a-zA-Z_]', '_', 'g'), '^_+|_+$', '', 'g')) AS b FROM named)),
  symd AS (SELECT artifact_id, iri, isp, label, CASE WHEN rn = 1 THEN base ELSE base || '_' || rn END AS sym FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, base ORDER BY isp, iri) AS rn FROM based)),
  th AS (SELECT k.*, s.sym FROM kinds k JOIN symd s ON s.artifact_id = k.artifact_id AND s.iri = k.iri AND s.isp = 0)"""
TH_NEEDS = ("edges", "dis_group", "dis_pair", "entry", "up_anc", "up_class", "up_clash")


@query("F1_F2_W9_theory_classes", sql(f"WITH {TH_CLASSES} SELECT artifact_id, iri, label, sym, kind FROM th", *TH_NEEDS))
def f1(spark, d):
    return theory(spark, d).classes.select("artifact_id", "iri", "label", "sym", "kind")


@query("F3_subsumptions", sql("SELECT artifact_id, child AS sub, parent AS sup FROM edges", "edges"))
def f3(spark, d):
    return theory(spark, d).subsumptions


@query("F4_F5_disjoint_pairs", sql(f"WITH {TH_CLASSES} SELECT artifact_id, a, b, origin FROM tdis", *TH_NEEDS))
def f4(spark, d):
    return TH.disjoint_pairs(theory(spark, d))


@query("F6_properties", sql(f"WITH {TH_CLASSES} SELECT artifact_id, iri, label, sym FROM symd WHERE isp = 1", *TH_NEEDS))
def f6(spark, d):
    return theory(spark, d).properties.select("artifact_id", "iri", "label", "sym")


@query("A9_theory_stats", sql(f"WITH {TH_CLASSES} SELECT artifact_id, count(*) AS classes, count(*) FILTER (WHERE kind = 'continuant') AS continuants, count(*) FILTER (WHERE kind = 'occurrent') AS occurrents, count(*) FILTER (WHERE kind = 'unknown') AS unknown_kind, "
       "any_value(s.n) AS subsumptions, any_value(x.n) AS disjoint_axioms, any_value(p.n) AS properties FROM th JOIN (SELECT artifact_id, count(*) AS n FROM edges GROUP BY 1) s USING (artifact_id) JOIN (SELECT artifact_id, count(*) AS n FROM tdis GROUP BY 1) x USING (artifact_id) "
       "JOIN (SELECT artifact_id, count(*) AS n FROM symd WHERE isp = 1 GROUP BY 1) p USING (artifact_id) GROUP BY artifact_id", *TH_NEEDS))
def a9(spark, d):
    return TH.stats(theory(spark, d))


def _lines(syntax, align):
    """SQL text of the rendered subsumption and disjointness lines."""
    def memb(alias, ar):
        if syntax == "prover9":
            return f"'instance_of_at(X,' || {alias}.sym || ')'" if ar == 2 else f"'instance_of(X,' || {alias}.sym || ',T)'"
        return f"'(instance_of_at x ' || {alias}.sym || ')'" if ar == 2 else f"'(instance_of x ' || {alias}.sym || ' t)'"

    def text(kind, ar):
        l, r = memb("l", ar), memb("r", ar)
        if syntax == "prover9":
            head = "'  all X ('" if ar == 2 else "'  all X all T ('"
            return f"{head} || {l} || ' -> ' || {r} || ').'" if kind == "sub" else f"{head} || '-(' || {l} || ' & ' || {r} || ')).'"
        head = "'  (forall (x) '" if ar == 2 else "'  (forall (x t) '"
        return f"{head} || '(if ' || {l} || ' ' || {r} || '))'" if kind == "sub" else f"{head} || '(not (and ' || {l} || ' ' || {r} || ')))'"

    both = "false" if align else "l.kind = 'occurrent' AND r.kind = 'occurrent'"
    case = lambda k: f"CASE WHEN {both} THEN {text(k, 2)} ELSE {text(k, 3)} END"
    note = "''"
    if syntax == "prover9" and not align:
        note = f"CASE WHEN l.kind <> r.kind AND 'unknown' NOT IN (l.kind, r.kind) THEN {q(TH.MISMATCH)} ELSE '' END"
    tag = "CASE origin WHEN 'bfo' THEN 'BFO' ELSE 'asserted' END"
    tail = f"'  % ' || {tag} || ': ' || l.label || ' / ' || r.label" if syntax == "prover9" else f"'  ;; ' || {tag}"
    return (f"WITH {TH_CLASSES} SELECT e.artifact_id, 2 AS section, e.child || ' ' || e.parent AS sort_key, {case('sub')} || {note} AS line FROM edges e JOIN th l ON l.artifact_id = e.artifact_id AND l.iri = e.child JOIN th r ON r.artifact_id = e.artifact_id AND r.iri = e.parent "
            f"UNION ALL SELECT e.artifact_id, 4, e.a || ' ' || e.b, {case('dis')} || {tail} FROM tdis e JOIN th l ON l.artifact_id = e.artifact_id AND l.iri = e.a JOIN th r ON r.artifact_id = e.artifact_id AND r.iri = e.b")


for _name, _syntax, _align in (("F7_prover9_lines", "prover9", False), ("F7_prover9_aligned", "prover9", True), ("F8_clif_lines", "clif", False), ("F8_clif_aligned", "clif", True)):
    def _render(spark, d, syntax=_syntax, align=_align):
        return TH.render(theory(spark, d), syntax, align).where("section IN (2, 4)")

    query(_name, sql(_lines(_syntax, _align), *TH_NEEDS))(_render)


# A node of the Horn theory is (predicate arity, class).
HORN = f"""hedge AS (SELECT e.artifact_id, CASE WHEN l.kind = 'occurrent' AND r.kind = 'occurrent' THEN 2 ELSE 3 END AS ar, e.child, e.parent FROM edges e JOIN kinds l ON l.artifact_id = e.artifact_id AND l.iri = e.child JOIN kinds r ON r.artifact_id = e.artifact_id AND r.iri = e.parent),
  hclo(artifact_id, ar, cls, node) AS (SELECT artifact_id, CASE kind WHEN 'occurrent' THEN 2 ELSE 3 END, iri, iri FROM kinds WHERE NOT {IS_UP.format('iri')} UNION SELECT h.artifact_id, h.ar, h.cls, e.parent FROM hclo h JOIN hedge e ON e.artifact_id = h.artifact_id AND e.ar = h.ar AND e.child = h.node),
  hdis AS (SELECT t.artifact_id, t.a, t.b, CASE WHEN l.kind = 'occurrent' AND r.kind = 'occurrent' THEN 2 ELSE 3 END AS ar FROM tdis t JOIN kinds l ON l.artifact_id = t.artifact_id AND l.iri = t.a JOIN kinds r ON r.artifact_id = t.artifact_id AND r.iri = t.b),
  hempty AS (SELECT DISTINCT x.artifact_id, x.cls FROM hclo x JOIN hclo y ON x.artifact_id = y.artifact_id AND x.cls = y.cls AND x.ar = y.ar JOIN hdis h ON h.artifact_id = x.artifact_id AND h.ar = x.ar AND h.a = x.node AND h.b = y.node),
  verdicts AS (SELECT k.artifact_id, k.iri, k.label, CASE WHEN e.cls IS NULL THEN 'satisfiable' ELSE 'unsatisfiable' END AS verdict FROM kinds k LEFT JOIN hempty e ON e.artifact_id = k.artifact_id AND e.cls = k.iri WHERE NOT {IS_UP.format('k.iri')})"""


def verdicts(spark, d):
    def build():
        ws = Workspace(spark)
        return ws.table(TH.empty_classes(theory(spark, d), builtin_upper(), ws), "verdicts")

    return shared(spark, d, "verdicts", build)


@query("F10_class_emptiness", sql(f"WITH {TH_CLASSES}, {HORN} SELECT artifact_id, iri, label, verdict FROM verdicts", *TH_NEEDS))
def f10(spark, d):
    return verdicts(spark, d)


TESTED = "tested AS (SELECT * FROM verdicts)"


@query("W8_tested_classes", sql(f"WITH {TH_CLASSES}, {HORN}, {TESTED} SELECT artifact_id, iri, verdict FROM tested", *TH_NEEDS))
def w8(spark, d):
    return TH.tested_classes(verdicts(spark, d)).select("artifact_id", "iri", "verdict")


SIDES = f"""pv AS (SELECT DISTINCT artifact_id, label AS name FROM tested WHERE verdict = 'unsatisfiable'), rv AS (SELECT DISTINCT artifact_id, {local('cls')} AS name FROM empty),
  sides AS (SELECT artifact_id, name, CASE WHEN p IS NULL THEN 'only_reasoner' WHEN r IS NULL THEN 'only_prover' ELSE 'both' END AS side FROM (SELECT *, true AS p FROM pv) FULL JOIN (SELECT *, true AS r FROM rv) USING (artifact_id, name))"""


def reasoner_names(spark, d):
    return unsat(spark, d).select("artifact_id", N.local_name(F.col("cls")).alias("name"))


@query("J18_divergence", sql(f"WITH {TH_CLASSES}, {HORN}, {TESTED}, {SIDES} SELECT artifact_id, name, side FROM sides", *TH_NEEDS, "empty"))
def j18(spark, d):
    prover = TH.tested_classes(verdicts(spark, d)).where("verdict = 'unsatisfiable'").select("artifact_id", F.col("label").alias("name"))
    return TH.divergence(prover, reasoner_names(spark, d))


@query("F11_cross_check", sql(f"WITH {TH_CLASSES}, {HORN}, {TESTED}, {SIDES} SELECT v.artifact_id, count(*) AS tested, false AS capped, coalesce(any_value(p), 0) AS prover_unsatisfiable, coalesce(any_value(r), 0) AS reasoner_unsatisfiable, coalesce(any_value(op), 0) AS only_prover, "
       "coalesce(any_value(orr), 0) AS only_reasoner, coalesce(any_value(op), 0) = 0 AND coalesce(any_value(orr), 0) = 0 AS agree FROM verdicts v LEFT JOIN (SELECT artifact_id, count(*) FILTER (WHERE side <> 'only_reasoner') AS p, count(*) FILTER (WHERE side <> 'only_prover') AS r, "
       "count(*) FILTER (WHERE side = 'only_prover') AS op, count(*) FILTER (WHERE side = 'only_reasoner') AS orr FROM sides GROUP BY artifact_id) USING (artifact_id) GROUP BY v.artifact_id", *TH_NEEDS, "empty"))
def f11(spark, d):
    tbox(spark, d)
    done = Workspace.beside(verdicts=lambda: verdicts(spark, d), names=lambda: reasoner_names(spark, d))
    return TH.cross_check(done["verdicts"], done["names"])


# == premises and coverage ============================================================================

PREMISE_SQL = (f"(SELECT artifact_id, CASE kind WHEN 'class' THEN 'class' ELSE 'property' END AS premise_type, CASE kind WHEN 'class' THEN 'instance_of(x, ' || name || ', t)' ELSE name || '(x, y, t)' END AS fol, "
               "CASE kind WHEN 'class' THEN 'Entities that are instances of ' || name ELSE 'Relation ' || name || ' between entities' END AS description, name AS entity_name "
               f"FROM {ENTITY_SQL} WHERE (kind = 'class' AND name NOT IN ('Thing', 'Nothing', 'Entity')) OR kind = 'object_property')")


@query("F12_simple_premises", sql(f"SELECT * FROM {PREMISE_SQL}", "triples"))
def f12(spark, d):
    return PR.simple_premises(corpus(spark, d))


MISSING_ENT = f"(SELECT artifact_id, kind, name FROM {ENTITY_SQL} e WHERE kind <> 'annotation_property' AND NOT EXISTS (SELECT 1 FROM {PREMISE_SQL} p WHERE p.artifact_id = e.artifact_id AND p.entity_name = e.name))"


@query("J16_missing_entities", sql(f"SELECT * FROM {MISSING_ENT}", "triples"))
def j16(spark, d):
    t = corpus(spark, d)
    return PR.missing_entities(t, PR.simple_premises(t))


@query("J16_completeness", sql(f"SELECT e.artifact_id, e.n AS total_entities, coalesce(m.n, 0) AS missing_entities, coalesce(p.n, 0) AS total_premises, coalesce(m.n, 0) = 0 AS complete FROM "
       f"(SELECT artifact_id, count(*) AS n FROM {ENTITY_SQL} WHERE kind <> 'annotation_property' GROUP BY 1) e LEFT JOIN (SELECT artifact_id, count(*) AS n FROM {MISSING_ENT} GROUP BY 1) m USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n FROM {PREMISE_SQL} GROUP BY 1) p USING (artifact_id)", "triples"))
def j16_report(spark, d):
    t = corpus(spark, d)
    return PR.completeness(t, PR.simple_premises(t))


BOTH = "s_kind = 'iri' AND o_kind = 'iri'"
CHAR_CASE = "CASE o " + " ".join(f"WHEN {q(i)} THEN '{n}'" for i, n in PR.CHAR_NAMES.items()) + " END"
OBJ_ASSERT = f"(SELECT * FROM triples t WHERE {BOTH} AND NOT starts_with(p, {q(S.RDF)}) AND NOT starts_with(p, {q(S.RDFS)}) AND NOT starts_with(p, {q(S.OWL)}) AND (artifact_id, p) IN (SELECT artifact_id, s FROM {PROPS}))"
AXIOM_SQL = f"""(SELECT artifact_id, CASE p WHEN {q(S.SUBCLASS)} THEN 'SubClassOf' WHEN {q(S.EQUIVALENT)} THEN 'EquivalentClasses' ELSE 'DisjointClasses' END AS axiom_type, {local('s')} AS subject, NULL AS property, {local('o')} AS object,
   {local('s')} || CASE p WHEN {q(S.SUBCLASS)} THEN ' is a subclass of ' WHEN {q(S.EQUIVALENT)} THEN ' is equivalent to ' ELSE ' is disjoint with ' END || {local('o')} AS description FROM triples WHERE p IN ({q(S.SUBCLASS)}, {q(S.EQUIVALENT)}, {q(S.DISJOINT)}) AND {BOTH}
  UNION ALL SELECT t.artifact_id, CASE WHEN o.s IS NULL THEN 'DataProperty' ELSE 'ObjectProperty' END || CASE p WHEN {q(S.DOMAIN)} THEN 'Domain' ELSE 'Range' END, {local('t.s')}, NULL, {local('t.o')}, {local('t.s')} || ' has ' || CASE p WHEN {q(S.DOMAIN)} THEN 'domain ' ELSE 'range ' END || {local('t.o')}
   FROM triples t JOIN {ALL_PROPS} a ON a.artifact_id = t.artifact_id AND a.s = t.s LEFT JOIN {PROPS} o ON o.artifact_id = t.artifact_id AND o.s = t.s WHERE p IN ({q(S.DOMAIN)}, {q(S.RANGE)}) AND {BOTH}
  UNION ALL SELECT artifact_id, {CHAR_CASE}, {local('s')}, NULL, NULL, {local('s')} || ' is ' || lower({CHAR_CASE}) FROM triples WHERE p = {q(S.TYPE)} AND o IN {_in(C.CHARACTERISTICS)} AND (artifact_id, s) IN (SELECT artifact_id, s FROM {PROPS})
  UNION ALL SELECT artifact_id, 'ClassAssertion', {local('s')}, NULL, {local('o')}, {local('s')} || ' is an instance of ' || {local('o')} FROM triples WHERE p = {q(S.TYPE)} AND {BOTH} AND (artifact_id, o) IN (SELECT artifact_id, s FROM triples WHERE p = {q(S.TYPE)} AND o = {q(S.CLASS)})
  UNION ALL SELECT artifact_id, 'ObjectPropertyAssertion', {local('s')}, {local('p')}, {local('o')}, {local('s')} || ' ' || {local('p')} || ' ' || {local('o')} FROM {OBJ_ASSERT})"""


@query("L1_typed_axioms", sql(f"SELECT * FROM {AXIOM_SQL}", "triples"))
def l1(spark, d):
    return PR.typed_axioms(corpus(spark, d))


AXIOM_PREMISES = f"""(SELECT artifact_id, 'SubClassOf' AS premise_type, '∀x,t: instance_of(x,' || {local('s')} || ',t) → instance_of(x,' || {local('o')} || ',t)' AS fol, 'All instances of ' || {local('s')} || ' are also instances of ' || {local('o')} AS description FROM tbox WHERE p = {q(S.SUBCLASS)} AND {BOTH}
  UNION ALL SELECT artifact_id, CASE p WHEN {q(S.DOMAIN)} THEN 'PropertyDomain' ELSE 'PropertyRange' END, '∀x,y: ' || {local('s')} || '(x,y) → ' || {local('o')} || CASE p WHEN {q(S.DOMAIN)} THEN '(x)' ELSE '(y)' END, 'If x relates to y via ' || {local('s')} || CASE p WHEN {q(S.DOMAIN)} THEN ', then x is a ' ELSE ', then y is a ' END || {local('o')}
   FROM tbox WHERE p IN ({q(S.DOMAIN)}, {q(S.RANGE)}) AND {BOTH} AND (artifact_id, s) IN (SELECT artifact_id, s FROM {PROPS.replace('triples', 'tbox')})
  UNION ALL SELECT artifact_id, 'Transitive', '∀x,y,z: (' || {local('s')} || '(x,y) ∧ ' || {local('s')} || '(y,z)) → ' || {local('s')} || '(x,z)', 'Property ' || {local('s')} || ' is transitive' FROM tbox WHERE p = {q(S.TYPE)} AND o = {q(OWL + 'TransitiveProperty')}
  UNION ALL SELECT artifact_id, 'EquivalentClasses', '∀x: ' || {local('s')} || '(x) ↔ ' || {local('o')} || '(x)', 'A thing is a ' || {local('s')} || ' if and only if it is a ' || {local('o')} FROM tbox WHERE p = {q(S.EQUIVALENT)} AND {BOTH}
  UNION ALL SELECT artifact_id, 'DisjointClasses', '∀x,t: ¬(instance_of(x,' || m || ',t) ∧ instance_of(x,' || n || ',t))', 'No instance can be both a ' || m || ' and a ' || n FROM (SELECT artifact_id, {local('a')} AS m, {local('b')} AS n FROM dis_pair UNION ALL SELECT artifact_id, {local('b')}, {local('a')} FROM dis_pair))"""


def axiom_premises(spark, d):
    def build():
        ws = Workspace(spark)
        return ws.table(PR.axiom_premises(tbox(spark, d), ws), "premises")

    return shared(spark, d, "premises", build)


@query("L2_axiom_premises", sql(f"SELECT * FROM {AXIOM_PREMISES}", "tbox", "dis_pair"))
def l2(spark, d):
    return axiom_premises(spark, d)


@query("L2_cardinality_premises", """SELECT p_partkey, CASE k WHEN 'min' THEN 'MinCardinality' WHEN 'max' THEN 'MaxCardinality' ELSE 'ExactCardinality' END AS premise_type, CASE
    WHEN k = 'min' THEN '∀x: P' || p_partkey || '(x) → ∃' || ys || ': ' || ry || CASE n WHEN 1 THEN '' ELSE ' ∧ ' || ney END
    WHEN n = 0 THEN '∀x: P' || p_partkey || '(x) → ¬∃y: has(x,y)'
    WHEN k = 'max' THEN '∀x: P' || p_partkey || '(x) → ∀' || my || ': (' || rm || ') → (' || em || ')'
    ELSE '∀x: P' || p_partkey || '(x) → (∃' || ys || ': ' || ry || CASE n WHEN 1 THEN '' ELSE ' ∧ ' || ney END || ' ∧ ∀' || replace(my, 'y', 'z') || ': (' || replace(rm, 'y', 'z') || ') → (' || replace(em, 'y', 'z') || '))' END AS fol
  FROM (SELECT *, CASE n WHEN 1 THEN 'y1' WHEN 2 THEN 'y1,y2' WHEN 0 THEN '' END AS ys, CASE n WHEN 1 THEN 'has(x,y1)' WHEN 2 THEN 'has(x,y1) ∧ has(x,y2)' END AS ry, 'y1 ≠ y2' AS ney,
     CASE n WHEN 1 THEN 'y1,y2' ELSE 'y1,y2,y3' END AS my, CASE n WHEN 1 THEN 'has(x,y1) ∧ has(x,y2)' ELSE 'has(x,y1) ∧ has(x,y2) ∧ has(x,y3)' END AS rm, CASE n WHEN 1 THEN 'y1 = y2' ELSE 'y1 = y2 ∨ y1 = y3 ∨ y2 = y3' END AS em
    FROM (SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'min' WHEN p_type IN ('LARGE', 'PROMO') THEN 'max' ELSE 'exact' END AS k, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS n FROM part)) WHERE k <> 'min' OR n > 0""")
def l2_card(spark, d):
    kind = F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "minCardinality").when(F.col("p_type").isin("LARGE", "PROMO"), "maxCardinality").otherwise("cardinality")
    n = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    cls, node = F.concat(F.lit(EX + "P"), "p_partkey"), F.concat(F.lit("_:"), "p_partkey")

    def row(s, s_kind, p, o, o_kind):
        return F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), p.alias("p"), o.alias("o"), F.lit(o_kind).alias("o_kind"))

    rows = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("artifact_id"), F.inline(F.array(
        row(cls, "iri", F.lit(S.SUBCLASS), node, "bnode"),
        row(node, "bnode", F.lit(S.owl("onProperty")), F.lit(EX + "has"), "iri"),
        row(node, "bnode", F.concat(F.lit(S.OWL), kind), n.cast("string"), "literal"),
    )))
    return PR.cardinality_premises(rows).select(F.col("artifact_id").cast("bigint").alias("p_partkey"), "premise_type", "fol")


@query("L3_coverage", sql(f"WITH m AS (SELECT DISTINCT artifact_id, lower(unnest(regexp_extract_all(fol, {q(X.PREMISE_TERM)}, 1))) AS term FROM {AXIOM_PREMISES}) SELECT artifact_id, count(*) AS total_elements, count(m.term) AS covered_elements, count(*) - count(m.term) AS missing_elements, round(100.0 * count(m.term) / count(*), 2)::DOUBLE AS coverage_percentage "
       f"FROM (SELECT * FROM {ENTITY_SQL.replace('triples', 'tbox')} WHERE kind <> 'annotation_property') e LEFT JOIN m USING (artifact_id) WHERE false GROUP BY artifact_id", "tbox", "dis_pair").replace("LEFT JOIN m USING (artifact_id) WHERE false", "LEFT JOIN m ON m.artifact_id = e.artifact_id AND m.term = lower(e.name)").replace("SELECT artifact_id, count(*) AS total", "SELECT e.artifact_id, count(*) AS total").replace("GROUP BY artifact_id", "GROUP BY e.artifact_id"))
def l3(spark, d):
    return PR.coverage(tbox(spark, d), axiom_premises(spark, d))


@query("L4_axioms_of_contradictions", sql(f"SELECT * FROM {AXIOM_SQL.replace('triples', 'tbox')} a WHERE EXISTS (SELECT 1 FROM empty e WHERE e.artifact_id = a.artifact_id AND {local('e.cls')} IN (a.subject, a.object, a.property))", "tbox", "empty"))
def l4(spark, d):
    ws, t = Workspace(spark), tbox(spark, d)
    done = ws.beside(axioms=lambda: ws.table(PR.typed_axioms(t), "axioms"), empty=lambda: unsat(spark, d))
    terms = done["empty"].select("artifact_id", N.local_name(F.col("cls")).alias("term")).distinct()
    return PR.axioms_mentioning(done["axioms"], terms)


# == expressions ========================================================================================

FORMULA = """CASE p_type WHEN 'ECONOMY' THEN 'forall x,t (instance_of(x,' || replace(p_name, ' ', '_') || ',t) -> exists p (participates_in(x,p)))'
  WHEN 'SMALL' THEN 'formulas(assumptions). all X all T (instance_of(X,' || replace(p_name, ' ', '_') || ',T) -> instance_of(X,quality,T)). % note'
  WHEN 'MEDIUM' THEN '(forall (x t) (if (instance_of x role t) (instance_of x ' || replace(p_name, ' ', '_') || ' t)))'
  WHEN 'PROMO' THEN 'Process(x) & ' || replace(p_name, ' ', '_') || '(y) & part_of(x, y)'
  WHEN 'STANDARD' THEN 'exists ((Object(x) && spatial(x) & located() forall x, y, z (temporal_part_of(x, y) | R(z))' ELSE p_name END"""
FORMULAS_SQL = f"(SELECT p_partkey AS expr_id, {FORMULA} AS e FROM part)"


def expressions(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("expr_id"), F.expr(FORMULA).alias("expression"))


def _re(col, pattern):
    return f"regexp_matches({col}, {q(pattern)})"


SYNTAX_SQL = (f"CASE WHEN trim(e) = '' THEN NULL WHEN starts_with(trim(e), '(') AND ({_re('trim(e)', X.CLIF_KEYWORD)} OR {_re('trim(e)', X.CLIF_ATOM)}) THEN 'clif' "
              f"WHEN {_re('trim(e)', X.P9_QUANTIFIER)} AND NOT contains(string_split(trim(e), '(')[1], '.') THEN 'prover9' WHEN {_re('trim(e)', X.P9_SCAFFOLD)} THEN 'prover9' "
              f"WHEN contains(e, 'instance_of') THEN 'instance_of' WHEN {_re('trim(e)', X.TRADITIONAL)} THEN 'traditional' END")
FORMAT_SQL = f"CASE WHEN {_re('e', X.INSTANCE_OF)} THEN 'instance_of' WHEN {_re('e', X.UNARY_CAPITAL)} THEN 'traditional' END"


@query("E1_E2_syntax", f"SELECT expr_id, e AS expression, {SYNTAX_SQL} AS syntax, {FORMAT_SQL} AS format FROM {FORMULAS_SQL}")
def e1(spark, d):
    e = F.col("expression")
    return expressions(spark, d).select("expr_id", "expression", X.syntax(e).alias("syntax"), X.format_of(e).alias("format"))


@query("E1_syntax_of_texts", f"SELECT kind, id, {SYNTAX_SQL} AS syntax, {FORMAT_SQL} AS format FROM (SELECT 'page' AS kind, page_id AS id, html AS e FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)")
def e1_texts(spark, d):
    texts = read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("e")).union(read(spark, d, "documents").select(F.lit("document"), "doc_id", "text"))
    return texts.select("kind", "id", X.syntax(F.col("e")).alias("syntax"), X.format_of(F.col("e")).alias("format"))


EXPAND_SQL = (f"string_split_regex(e, {q(X.MULTI_QUANTIFIER)})[1] || array_to_string(list_transform(range(1, len(regexp_extract_all(e, {q(X.MULTI_QUANTIFIER)})) + 1), lambda i : "
              f"array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(regexp_extract_all(e, {q(X.MULTI_QUANTIFIER)})[i], {q(X.MULTI_QUANTIFIER)}, 2), ','), lambda v : trim(v)), lambda v : v <> ''), "
              f"lambda v : regexp_extract(regexp_extract_all(e, {q(X.MULTI_QUANTIFIER)})[i], {q(X.MULTI_QUANTIFIER)}, 1) || ' ' || v), ' ') || ' (' || string_split_regex(e, {q(X.MULTI_QUANTIFIER)})[i + 1]), '')")


@query("E3_expanded_quantifiers", f"SELECT expr_id, {EXPAND_SQL} AS expanded FROM {FORMULAS_SQL}")
def e3(spark, d):
    return expressions(spark, d).select("expr_id", X.expand_quantifiers(F.col("expression")).alias("expanded"))


P9_SQL = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(e, '(set|formulas)\([^)]*\)\s*\.|end_of_list\.|%[^\n]*', ' ', 'g'), '\s+', ' ', 'g')), '\.$', ''),
  '\b(all|exists) ([A-Za-z]\w*) ', '\1 \2.', 'g'), '\b(all|exists) ([A-Za-z]\w*)\(', '\1 \2.(', 'g')"""


@query("E4_prover9_infix", f"SELECT expr_id, trim({P9_SQL}) AS infix FROM {FORMULAS_SQL}")
def e4(spark, d):
    return expressions(spark, d).select("expr_id", X.prover9_infix(F.col("expression")).alias("infix"))


def _terms_sql(e):
    parts = " UNION ".join(f"SELECT expr_id, unnest(regexp_extract_all(e, {q(p)}, 1)) AS term FROM src" for p in (X.TERM_UNARY, X.TERM_RELATION))
    return (f"src AS ({e}), tm AS (SELECT expr_id, unnest(regexp_extract_all(e, {q(X.TERM_INSTANCE)}, 1)) AS term FROM src UNION SELECT * FROM ({parts}) WHERE term NOT IN ('instance_of', 'forall', 'exists')), "
            "terms AS (SELECT DISTINCT expr_id, term FROM tm WHERE term <> 'instance_of')")


@query("E5_terms", f"WITH {_terms_sql(f'SELECT * FROM {FORMULAS_SQL}')} SELECT expr_id, term FROM terms")
def e5(spark, d):
    return expressions(spark, d).select("expr_id", F.explode(X.terms(F.col("expression"))).alias("term"))


@query("E5_terms_of_pages", f"WITH {_terms_sql('SELECT page_id AS expr_id, html AS e FROM pages')} SELECT expr_id, term FROM terms")
def e5_pages(spark, d):
    pages = read(spark, d, "pages").select(F.col("page_id").alias("expr_id"), F.col("html").alias("expression"))
    return pages.select("expr_id", F.explode(X.terms(F.col("expression"))).alias("term"))


@query("E6_free_variables", "SELECT p_partkey AS expr_id, CASE p_type WHEN 'PROMO' THEN 'x,y' WHEN 'STANDARD' THEN 'x' ELSE '' END AS free FROM part")
def e6(spark, d):
    return expressions(spark, d).select("expr_id", F.array_join(X.free_variables(F.col("expression")), ",").alias("free"))


@query("L5_surface_issues", f"SELECT expr_id, concat_ws('; ', CASE WHEN len(e) - len(replace(e, '(', '')) <> len(e) - len(replace(e, ')', '')) THEN 'Unbalanced parentheses in the expression' END, CASE WHEN {_re('e', chr(92) + '(' + chr(92) + 's*' + chr(92) + ')')} THEN 'Empty parentheses found' END, "
       f"CASE WHEN {_re('e', '[&|]' + chr(92) + 's*[&|]')} THEN 'Consecutive logical operators found' END, CASE WHEN NOT {_re('e', chr(92) + 'b(exists|forall)' + chr(92) + 'b' + chr(92) + 's*[a-zA-Z]+')} AND (contains(e, 'exists') OR contains(e, 'forall')) THEN 'Quantifier used without a variable' END) AS issues FROM {FORMULAS_SQL}")
def l5(spark, d):
    return expressions(spark, d).select("expr_id", F.array_join(X.surface_issues(F.col("expression")), "; ").alias("issues"))


VOCAB_VALUES = ", ".join(f"({i}, '{k}', '{label}', '{uri}', '{kind}')" for i, k, label, uri, kind in vocabulary_rows())
MATCH_SQL = f"""vocab AS (SELECT * FROM (VALUES {VOCAB_VALUES}) AS v(pos, key, label, uri, kind)), best AS (SELECT term, min(pos) FILTER (WHERE key = lower(term)) AS ex, min(pos) AS pa FROM (SELECT DISTINCT term FROM terms) t JOIN vocab ON contains(key, lower(term)) OR contains(lower(term), key) GROUP BY term),
  matched AS (SELECT t.expr_id, t.term, CASE WHEN b.ex IS NOT NULL THEN 'exact' WHEN b.pa IS NOT NULL THEN 'partial' ELSE 'none' END AS match, v.label, v.kind FROM terms t LEFT JOIN best b USING (term) LEFT JOIN vocab v ON v.pos = coalesce(b.ex, b.pa))"""


@query("J17_vocabulary_matches", f"WITH {_terms_sql(f'SELECT * FROM {FORMULAS_SQL}')}, {MATCH_SQL} SELECT expr_id, term, match, label, kind FROM matched")
def j17(spark, d):
    return E.expression_terms(expressions(spark, d))


@query("J17_document_words", "WITH terms AS (SELECT DISTINCT 0 AS expr_id, unnest(string_split(text, ' ')) AS term FROM documents), " + MATCH_SQL + " SELECT term, match, label, kind FROM matched")
def j17_words(spark, d):
    words = read(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("term")).distinct()
    return E.match_terms(words)


# formulas with a part's name, and what is free in them
SCOPED = [
    ("forall x ({n}(x)) & {n}(x)", "x"), ("forall x ({n}(x) & P(x))", ""), ("all x. P(x) -> {n}(x)", "x"), ("exists x exists y ({n}(x,y)) | P(y)", "y"),
    ("-(forall z1 (P(z1) & exists y {n}(y,z1))) & R(y,z1)", "y,z1"), ("forall x x = y", "y"), ("forall x (exists x ({n}(x)) & P(x))", ""),
    ("(forall x {n}(x)) & (exists y (P(y))) & R(x,y)", "x,y"), ("{n}(x1) & forall x1, x2 (R(x1,x2)) & P(x2)", "x1,x2"),
    ("forall x -{n}(x) | P(x)", "x"), ("(forall (x t) (if ({n} x t) (part_of x y)))", "y"),
]
SCOPED_CASE = "CASE p_partkey % " + str(len(SCOPED)) + " " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(SCOPED))) + " END"


@query("E6_scopes", "SELECT p_partkey AS expr_id, " + SCOPED_CASE.format(*[f"'{free}'" for _, free in SCOPED]) + " AS free FROM part")
def e6_scopes(spark, d):
    text = SCOPED_CASE.format(*["'" + t.format(n="' || replace(p_name, ' ', '_') || '") + "'" for t, _ in SCOPED])
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("expr_id"), F.expr(text).alias("expression"))
    return rows.select("expr_id", F.array_join(X.free_variables(F.col("expression")), ",").alias("free"))


@query("E7_verdicts", f"""WITH {_terms_sql(f'SELECT * FROM {FORMULAS_SQL}')}, {MATCH_SQL}, fv AS ({ORACLES['E6_free_variables']}), si AS ({ORACLES['L5_surface_issues']}),
  per AS (SELECT expr_id, string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (WHERE match = 'exact' AND kind = 'class') AS c, string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (WHERE match = 'exact' AND kind = 'relation') AS r, string_agg(DISTINCT term, ', ' ORDER BY term) FILTER (WHERE match = 'none') AS u FROM matched GROUP BY expr_id)
  SELECT s.expr_id, si.issues = '' AS parsed, si.issues = '' AND fv.free = '' AS well_formed, u IS NULL AS bfo_compatible, si.issues = '' AND fv.free = '' AND u IS NULL AS valid, coalesce(c, '') AS classes_used, coalesce(r, '') AS relations_used, coalesce(u, '') AS unknown_terms,
   concat_ws('; ', nullif(si.issues, ''), CASE WHEN fv.free <> '' THEN 'Found free variables not bound by quantifiers: ' || replace(fv.free, ',', ', ') END) AS issues FROM src s JOIN fv USING (expr_id) JOIN si USING (expr_id) LEFT JOIN per USING (expr_id)""")
def e7(spark, d):
    v = E.check_expressions(expressions(spark, d))
    return v.select("expr_id", "parsed", "well_formed", "bfo_compatible", "valid", *[F.array_join(c, ", ").alias(c) for c in ("classes_used", "relations_used", "unknown_terms")], F.array_join("issues", "; ").alias("issues"))


@query("E8_expression_results", f"SELECT expr_id, {SYNTAX_SQL} AS syntax, CASE coalesce({SYNTAX_SQL}, '') WHEN 'prover9' THEN trim({P9_SQL}) WHEN 'clif' THEN e ELSE {EXPAND_SQL} END AS prepared FROM {FORMULAS_SQL}")
def e8(spark, d):
    out = Workspace(spark).path("expression-results")
    E.check_table(expressions(spark, d)).write.mode("append").parquet(out)
    return spark.read.parquet(out).select("expr_id", "syntax", "prepared")


@query("E9_vocabulary_usage", f"WITH {_terms_sql(f'SELECT * FROM {FORMULAS_SQL}')}, {MATCH_SQL} SELECT v.key, v.label, v.uri, v.kind, count(DISTINCT m.expr_id) AS expressions FROM vocab v LEFT JOIN matched m ON m.match = 'exact' AND lower(m.term) = v.key GROUP BY ALL")
def e9(spark, d):
    return E.vocabulary_usage(E.expression_terms(expressions(spark, d)), spark)


@query("E10_premise_terms", sql(f"SELECT DISTINCT artifact_id, lower(unnest(regexp_extract_all(fol, {q(X.PREMISE_TERM)}, 1))) AS term FROM {AXIOM_PREMISES}", "tbox", "dis_pair"))
def e10(spark, d):
    return PR.mentioned_terms(axiom_premises(spark, d))


CLIF = """'(cl:comment ''note on ' || p_name || ' (not an axiom)'' (cl:outdiscourse ' || p_type || ') (forall (x t) (if (instance-of x ' || p_type || ' t) (exists (y) (and (' || CASE WHEN p_size > 25 THEN 'participates-in x y t' ELSE 'occurs-in x y' END || ') (not (= x y)) (' || CASE p_type WHEN 'PROMO' THEN 'precedes x y t' ELSE 'precedes x y' END || '))))))' || chr(10) || ';; (ignored x)' || chr(10) || '(' || replace(p_name, ' ', '-') || ' a)'"""


def clif_atoms(spark, d):
    docs = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.expr(CLIF.replace("''", "\\'")).alias("value"))
    return CL.atoms(docs)


INVENTORY = """inv AS (SELECT predicate, arity, count(*) AS uses FROM (SELECT 'instance-of' AS predicate, 3::BIGINT AS arity FROM part UNION ALL SELECT CASE WHEN p_size > 25 THEN 'participates-in' ELSE 'occurs-in' END, CASE WHEN p_size > 25 THEN 3 ELSE 2 END FROM part
  UNION ALL SELECT 'precedes', CASE p_type WHEN 'PROMO' THEN 3 ELSE 2 END FROM part UNION ALL SELECT replace(p_name, ' ', '-'), 1 FROM part) GROUP BY predicate, arity)"""
SIGNATURE_SQL = "sig AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n})" for p, n in CL.signature_rows()) + ") AS v(predicate, declared))"


@query("E11_A10_predicate_inventory", f"WITH {INVENTORY} SELECT * FROM inv")
def e11(spark, d):
    return CL.predicate_inventory(clif_atoms(spark, d))


@query("A10_drifting_predicates", f"WITH {INVENTORY} SELECT predicate, count(DISTINCT arity) AS arities FROM inv GROUP BY predicate HAVING count(DISTINCT arity) > 1")
def a10(spark, d):
    return CL.drifting_predicates(e11(spark, d))


def signature_table(spark):
    from quercus.sources.tables import constant_table

    return constant_table(spark, "predicate string, arity bigint", CL.signature_rows())


@query("J22_signature_drift", f"WITH {INVENTORY}, {SIGNATURE_SQL} SELECT predicate, arity, CASE WHEN declared IS NULL THEN 'unmapped' ELSE 'arity' END AS problem FROM inv LEFT JOIN sig USING (predicate) WHERE declared IS NULL OR declared <> arity")
def j22(spark, d):
    inv, sig = e11(spark, d), signature_table(spark)
    return CL.unmapped(inv, sig).select("predicate", "arity", F.lit("unmapped").alias("problem")).union(
        CL.arity_mismatches(inv, sig).select("predicate", "arity", F.lit("arity")))


# == graph tables ===========================================================================================

NODE_SQL = f"""nodes AS (SELECT t.artifact_id, t.s AS id, {local('t.s')} AS name, CASE WHEN t.o = {q(S.OBJECT_PROPERTY)} THEN 'Relation' WHEN regexp_matches(lower({local('t.s')}), 'process|event|activity|action') THEN 'Process' WHEN regexp_matches(lower({local('t.s')}), 'role|function|disposition|quality') THEN 'DependentContinuant'
   WHEN regexp_matches(lower({local('t.s')}), 'entity|object|material|substance') THEN 'IndependentContinuant' WHEN regexp_matches(lower({local('t.s')}), 'temporal|time|moment|interval') THEN 'TemporalRegion' WHEN regexp_matches(lower({local('t.s')}), 'spatial|region|location|place') THEN 'SpatialRegion' ELSE 'IndependentContinuant' END AS type,
   coalesce(c.o, CASE WHEN t.o = {q(S.CLASS)} THEN 'OWL class: ' ELSE 'OWL property: ' END || {local('t.s')}) AS description, t.o = {q(S.CLASS)} AND regexp_matches(lower({local('t.s')}), '{N.TEMPORAL_WORDS}') AS temporal
   FROM triples t LEFT JOIN (SELECT artifact_id, s, min(o) AS o FROM triples WHERE p = {q(S.COMMENT)} GROUP BY 1, 2) c ON c.artifact_id = t.artifact_id AND c.s = t.s WHERE t.p = {q(S.TYPE)} AND t.o IN ({q(S.CLASS)}, {q(S.OBJECT_PROPERTY)}) AND t.s_kind = 'iri')"""
OWL_CLASSES = f"(SELECT artifact_id, s FROM triples WHERE p = {q(S.TYPE)} AND o = {q(S.CLASS)} AND s_kind = 'iri')"
EDGE_SQL = f"""gedges AS (SELECT artifact_id, o AS source, s AS target, 'is_a' AS relation, 'inheritance' AS type FROM triples WHERE p = {q(S.SUBCLASS)} AND {BOTH} AND (artifact_id, s) IN {OWL_CLASSES}
  UNION ALL SELECT artifact_id, o, s, 'has_property', 'domain' FROM triples WHERE p = {q(S.DOMAIN)} AND {BOTH} AND (artifact_id, s) IN {PROPS} UNION ALL SELECT artifact_id, s, o, 'points_to', 'range' FROM triples WHERE p = {q(S.RANGE)} AND {BOTH} AND (artifact_id, s) IN {PROPS})"""
GRAPH = f"WITH {NODE_SQL}, {EDGE_SQL}"


def graph_nodes(spark, d):
    return GR.nodes(corpus(spark, d), fixed=True)


@query("B1_nodes", sql(f"{GRAPH} SELECT * FROM nodes", "triples"))
def b1(spark, d):
    return graph_nodes(spark, d)


@query("B1_default_node_types", sql(f"SELECT artifact_id, s AS id FROM triples WHERE p = {q(S.TYPE)} AND o = {q(S.CLASS)} AND s_kind = 'iri' AND regexp_matches(lower({local('s')}), 'process|role|quality|object|site|function|history|disposition|entity|continuant|occurrent')", "triples"))
def b1_default(spark, d):
    t = corpus(spark, d)
    default = GR.nodes(t).where("type = 'IndependentContinuant'").select("artifact_id", "id")
    words = "process|role|quality|object|site|function|history|disposition|entity|continuant|occurrent"
    return default.where(F.lower(N.local_name(F.col("id"))).rlike(words))


@query("B2_edges", sql(f"{GRAPH} SELECT * FROM gedges", "triples"))
def b2(spark, d):
    return GR.edges(corpus(spark, d))


@query("B3_graph_summary", sql(f"{GRAPH} SELECT artifact_id, count(*) FILTER (WHERE type <> 'Relation') AS class_count, count(*) FILTER (WHERE type = 'Relation') AS property_count FROM nodes GROUP BY artifact_id", "triples"))
def b3(spark, d):
    return GR.summary(graph_nodes(spark, d))


def _has(kind, c):
    return f"regexp_matches(lower({c}), '{'|'.join(N.CATEGORY_WORDS[kind])}')"


def _as(kind, c):
    return f"regexp_matches(lower({c}), '{'|'.join(N.CLASS_WORDS[kind])}')"


VIOLATION_SQL = f"""tied AS (SELECT artifact_id, relation, {path('source')} AS src, {path('target')} AS dst FROM gedges WHERE relation IN ('inheres_in', 'has_property', 'points_to')),
  viol AS (SELECT artifact_id, 'quality_inheres_material' AS rule_id, 'edge' AS rule_path, src AS source, relation AS property, dst AS target FROM tied WHERE {_has('quality', 'src')} AND {_has('immaterial', 'dst')}
   UNION ALL SELECT artifact_id, 'quality_inheres_material', 'property', 'inheres_in property', relation, dst FROM tied WHERE lower(src) = 'inheres_in' AND lower(dst) IN ('immaterialentity', 'voidspace')
   UNION ALL SELECT t.artifact_id, 'quality_inheres_material', 'node', t.src, relation, dst FROM tied t JOIN nodes n ON n.artifact_id = t.artifact_id AND {path('n.name')} = t.src WHERE {_has('quality', 't.src')} AND {_has('immaterial', 'dst')}
   UNION ALL SELECT artifact_id, 'disjoint_classes', 'node', {path('name')}, NULL, NULL FROM nodes, (VALUES (1), (2), (3)) AS v(i) WHERE CASE i WHEN 1 THEN {_as('MaterialEntity', path('name'))} AND {_as('ImmaterialEntity', path('name'))} WHEN 2 THEN {_as('IndependentContinuant', path('name'))} AND {_as('DependentContinuant', path('name'))}
     ELSE {_as('Process', path('name'))} AND {_as('Continuant', path('name'))} END)"""


def graph_violations(spark, d):
    t = corpus(spark, d)
    return GR.violations(t, graph_nodes(spark, d), GR.edges(t))


@query("B4_B8_violations", sql(f"{GRAPH}, {VIOLATION_SQL} SELECT * FROM viol", "triples"))
def b4(spark, d):
    return graph_violations(spark, d).drop("description")


@query("B4_B8_rules_on_words", f"""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations), n AS (SELECT conv_id, turn, word FROM w WHERE word <> ''),
  e AS (SELECT n.conv_id, {q(EX)} || role AS source, {q(EX)} || word AS target FROM n JOIN conversations c USING (conv_id, turn)) SELECT conv_id, 'role_borne_independent' AS rule_id, count(*) AS n FROM e WHERE {_has('role', path('source'))} AND NOT {_has('independent', path('target'))} GROUP BY conv_id""")
def b5(spark, d):
    c = read(spark, d, "conversations")
    words = c.select(F.col("conv_id").alias("artifact_id"), "role", F.explode(F.split("text", " ", -1)).alias("word")).where("word <> ''")
    edges = words.select("artifact_id", F.concat(F.lit(EX), "role").alias("source"), F.concat(F.lit(EX), "word").alias("target"), F.lit("borne_by").alias("relation"))
    bad = GR.role_violations(edges).union(GR.disposition_violations(edges))
    return bad.groupBy(F.col("artifact_id").alias("conv_id"), "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("B9_valid_relations", sql(f"{GRAPH} SELECT artifact_id, relation AS property, {path('source')} AS source, {path('target')} AS target, 'passed' AS validation_status FROM gedges WHERE relation = 'is_a'", "triples"))
def b9(spark, d):
    return GR.valid_relations(GR.edges(corpus(spark, d)))


@query("B10_A16_validation_totals", sql(f"{GRAPH}, {VIOLATION_SQL} SELECT n.artifact_id, n.n AS total_entities, coalesce(e.n, 0) AS total_relations, coalesce(v.n, 0) AS errors, coalesce(e.ok, 0) AS valid FROM (SELECT artifact_id, count(*) AS n FROM nodes GROUP BY 1) n "
       "LEFT JOIN (SELECT artifact_id, count(*) AS n, count(*) FILTER (WHERE relation = 'is_a') AS ok FROM gedges GROUP BY 1) e USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n FROM viol GROUP BY 1) v USING (artifact_id)", "triples"))
def b10(spark, d):
    t = corpus(spark, d)
    return GR.validation_totals(graph_nodes(spark, d), GR.edges(t), graph_violations(spark, d))


@query("D1_diagram_classes", sql(f"SELECT artifact_id, {local('s')} AS name, contains(s, 'BFO') OR contains(s, 'IAO') AS upper FROM {OWL_CLASSES}", "triples"))
def d1(spark, d):
    return GR.diagram_classes(corpus(spark, d))


@query("J20_property_connections", sql(f"SELECT l.artifact_id, {local('l.o')} AS source, {local('r.o')} AS target, {local('l.s')} AS label FROM triples l JOIN triples r ON l.artifact_id = r.artifact_id AND l.s = r.s WHERE l.p = {q(S.DOMAIN)} AND r.p = {q(S.RANGE)} AND (l.artifact_id, l.s) IN {PROPS}", "triples"))
def j20(spark, d):
    return GR.property_connections(corpus(spark, d))


# == history ===================================================================================================


def analyses(spark, d):
    """Events seen as analyses: one file per user and event type."""
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", F.concat_ws("/", "user_id", "event_type").alias("file_id"),
        F.col("event_type").alias("verdict"), F.col("ts").cast("timestamp").alias("ts"))


def files(spark, d):
    return analyses(spark, d).select("file_id", "user_id", F.concat("file_id", F.lit(".owl")).alias("filename")).distinct()


ANALYSES = "an AS (SELECT event_id AS id, user_id, user_id || '/' || event_type AS file_id, event_type AS verdict, CAST(ts AS VARCHAR) AS stamped FROM events)"


@query("W1_latest_per_file", f"WITH {ANALYSES} SELECT file_id, id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY id DESC) AS rn FROM an) WHERE rn = 1")
def w1(spark, d):
    return H.latest_per_file(analyses(spark, d)).select("file_id", "id", "verdict")


@query("W2_newest_twenty", f"WITH {ANALYSES} SELECT id, file_id, verdict FROM an ORDER BY stamped DESC, id DESC LIMIT 20")
def w2(spark, d):
    return H.newest(analyses(spark, d), "ts", 20).select("id", "file_id", "verdict")


@query("W3_full_history", f"WITH {ANALYSES} SELECT id, user_id, file_id, verdict FROM an")
def w3(spark, d):
    return H.newest_first(analyses(spark, d), "ts").select("id", "user_id", "file_id", "verdict")


@query("A11_analyses_per_file", f"WITH {ANALYSES} SELECT file_id, count(*) AS analyses FROM an GROUP BY file_id")
def a11(spark, d):
    return H.analyses_per_file(analyses(spark, d))


@query("A12_user_dashboard", f"WITH {ANALYSES} SELECT user_id, count(DISTINCT file_id) AS files, count(*) AS analyses, count(*) FILTER (WHERE verdict = 'error') AS expressions FROM an GROUP BY user_id")
def a12(spark, d):
    a = analyses(spark, d)
    return H.user_dashboard(files(spark, d), a, a.where("verdict = 'error'"))


@query("J21_user_analyses", f"WITH {ANALYSES} SELECT id, file_id, user_id, verdict, file_id || '.owl' AS filename FROM an")
def j21(spark, d):
    return H.user_analyses(files(spark, d), analyses(spark, d)).select("id", "file_id", "user_id", "verdict", "filename")


@query("S12_recent_reports", f"WITH {ANALYSES} SELECT id, file_id, verdict, 1::BIGINT AS found FROM an")
def s12(spark, d):
    """Every report of the history is found by its id."""
    from quercus.sources.sinks import append_reports, recent_reports

    out = Workspace(spark).path("report-history")
    append_reports(analyses(spark, d), out)
    history = spark.read.parquet(out)
    found = recent_reports(history).groupBy("report_id").agg(F.count(F.lit(1)).alias("found"))
    return history.join(found, "report_id").select("id", "file_id", "verdict", "found")


# == streams ======================================================================================================


def _drain(df, spark, name, mode):
    """Run a stream over what is there and hand back its rows as a table."""
    ws = Workspace(spark)
    out, state = ws.path(name), ws.path(name + "-state")
    stream = df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(
        lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    ).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def event_stream(spark, d):
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("T2_verdict_windows", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS verdict, count(*) AS n FROM events GROUP BY ALL")
def t2(spark, d):
    from quercus.streaming.gate_stream import verdict_windows

    windows = verdict_windows(event_stream(spark, d).withColumnRenamed("event_type", "verdict"))
    return _drain(windows, spark, "windows", "complete").select(F.to_date("window_start").alias("day"), "verdict", "n")


VERSIONS = "SELECT CAST(user_id AS VARCHAR) AS artifact_id, event_id AS version, CAST(floor(value) AS BIGINT) AS axioms FROM events"


@query("T3_delta_stream", f"SELECT artifact_id, version, CASE WHEN prev > 0 AND axioms = 0 THEN 'E_TRIVIALIZED' ELSE 'E_OVER_RELAXED' END AS code, prev AS in_axioms, axioms AS out_axioms FROM "
       f"(SELECT *, lag(axioms) OVER (PARTITION BY artifact_id ORDER BY version) AS prev FROM ({VERSIONS})) WHERE prev IS NOT NULL AND axioms < prev")
def t3(spark, d):
    from quercus.streaming.gate_stream import delta_stream

    versions = event_stream(spark, d).selectExpr(
        "CAST(user_id AS STRING) AS artifact_id", "event_id AS version", "CAST(floor(value) AS BIGINT) AS axioms",
        "CAST(0 AS BIGINT) AS objectProperties", "CAST(0 AS BIGINT) AS n_logged", "CAST(0 AS BIGINT) AS n_property")
    return _drain(delta_stream(versions), spark, "delta", "append")


@query("T1_gate_stream", sql(f"SELECT artifact_id, 'fail' AS verdict, classes FROM ({TBOX_COUNTS})", "tbox"))
def t1(spark, d):
    from quercus.streaming.gate_stream import current, gate_stream

    ws = Workspace(spark)
    drop, out = ws.path("arriving"), ws.path("checked")
    lines = tbox(spark, d).select("artifact_id", NT.line_text().alias("value"))
    lines.repartition(3).write.partitionBy("artifact_id").text(drop)  # 25 artifacts of three files, in two batches
    gate_stream(spark, drop, out, ws.path("gate-state"), files_per_batch=40).awaitTermination()
    return current(spark, out, "reports").select("artifact_id", "verdict", "counts.classes")
