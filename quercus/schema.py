"""Table layouts and RDF vocabulary shared by every operator.

Everything works on one ``triples`` table that holds many artifacts, told apart
by ``artifact_id``.  Blank-node ids are scoped to their artifact.
"""

from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OBO = "http://purl.obolibrary.org/obo/"
UPPER_PREFIX = OBO + "BFO_"

TYPE = RDF + "type"
FIRST = RDF + "first"
REST = RDF + "rest"
NIL = RDF + "nil"
SUBCLASS = RDFS + "subClassOf"
SUBPROPERTY = RDFS + "subPropertyOf"
DOMAIN = RDFS + "domain"
RANGE = RDFS + "range"
LABEL = RDFS + "label"
COMMENT = RDFS + "comment"
RDFS_CLASS = RDFS + "Class"
RESOURCE = RDFS + "Resource"


def owl(name):
    return OWL + name


CLASS = owl("Class")
THING = owl("Thing")
NOTHING = owl("Nothing")
OBJECT_PROPERTY = owl("ObjectProperty")
DATA_PROPERTY = owl("DatatypeProperty")
ANNOTATION_PROPERTY = owl("AnnotationProperty")
NAMED_INDIVIDUAL = owl("NamedIndividual")
RESTRICTION = owl("Restriction")
EQUIVALENT = owl("equivalentClass")
DISJOINT = owl("disjointWith")

TRIPLES = T.StructType(
    [
        T.StructField("artifact_id", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("s_kind", T.StringType()),  # iri | bnode
        T.StructField("p", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("o_kind", T.StringType()),  # iri | bnode | literal
        T.StructField("o_datatype", T.StringType()),
        T.StructField("o_lang", T.StringType()),
    ]
)

COUNT_COLUMNS = [
    "classes",
    "subClassOf",
    "objectProperties",
    "objectPropertyAxioms",
    "dataProperties",
    "individuals",
    "axioms",
]
