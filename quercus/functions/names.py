"""Column functions over IRIs and entity names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quercus.schema import UPPER_PREFIX

# Name patterns of the published gate rules.
PRIVATION_START = (
    "(?i)^(absence|absent|lack|lacking|missing|non[A-Z_]|privation|deprivation|"
    "failure|failureto|failureof|without|no[A-Z])"
)
PRIVATION_ANYWHERE = "(?i)(absenceof|lackof|failureof|failureto|nonexisten|noncompli)"
# Same intent with the case of the letter after "no"/"non" respected.
PRIVATION_START_STRICT = (
    "^(?:(?i:absence|absent|lack|lacking|missing|privation|deprivation|failure|without)"
    "|[Nn]on[A-Z_]|[Nn]o[A-Z])"
)
NAME_TOKEN = "([A-Z]+[a-z0-9]*|[a-z0-9]+)"
CONNECTORS = ["with", "and", "of", "by", "over"]
TWO_CONNECTORS = "(?is)(with|and|of|by|over).*(with|and|of|by|over)"
TEMPORAL_WORDS = "temporal|time|moment|interval|duration|period"
UPLOAD_EXTENSIONS = ["owl", "rdf", "xml", "ttl", "n3", "nt", "ofn", "own", "owx"]

# Words that suggest a category in an entity name.
CATEGORY_WORDS = {
    "quality": ["quality", "color", "redness", "hue", "temperature", "weight"],
    "material": ["entity", "object", "agent", "person", "document", "evidence", "materialentity"],
    "immaterial": [
        "immaterial", "void", "space", "region", "information", "immaterialentity", "voidspace",
    ],
    "role": ["role", "judge", "attorney", "witness", "authority"],
    "independent": ["entity", "agent", "person", "court", "system", "organization"],
    "disposition": ["disposition", "ability", "capacity", "obligation", "right", "power"],
    "process": ["process", "trial", "adjudication", "hearing", "procedure", "enforcement"],
}
CLASS_WORDS = {
    "MaterialEntity": ["document", "evidence", "contract", "agent", "person"],
    "ImmaterialEntity": ["right", "obligation", "quality", "information"],
    "IndependentContinuant": ["entity", "agent", "court", "organization"],
    "DependentContinuant": ["role", "quality", "disposition", "claim"],
    "Process": ["trial", "process", "adjudication", "enforcement"],
    "Continuant": ["entity", "agent", "role", "quality", "document"],
}
# Node type by words in the lower-cased class name, first hit wins.
NODE_TYPE_WORDS = [
    ("Process", ["process", "event", "activity", "action"]),
    ("DependentContinuant", ["role", "function", "disposition", "quality"]),
    ("IndependentContinuant", ["entity", "object", "material", "substance"]),
    ("TemporalRegion", ["temporal", "time", "moment", "interval"]),
    ("SpatialRegion", ["spatial", "region", "location", "place"]),
]


def local_name(iri: Column) -> Column:
    """Profile variant: after the last '#', else a non-empty last path step, else all."""
    tail = F.substring_index(iri, "/", -1)
    return (
        F.when(iri.contains("#"), F.substring_index(iri, "#", -1))
        .when(tail != "", tail)
        .otherwise(iri)
    )


def short_name(iri: Column) -> Column:
    """Gate variant: after the last '#', then after the last '/'; may be empty."""
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def path_name(iri: Column) -> Column:
    """Graph variant: after the last '#' when there is one, else after the last '/'."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(
        F.substring_index(iri, "/", -1)
    )


def is_upper(iri: Column) -> Column:
    return iri.startswith(UPPER_PREFIX)


def is_privation(name: Column, strict: bool = False) -> Column:
    start = PRIVATION_START_STRICT if strict else PRIVATION_START
    return name.rlike(start) | name.rlike(PRIVATION_ANYWHERE)


def is_compound(name: Column) -> Column:
    tokens = F.regexp_extract_all(name, F.lit(NAME_TOKEN), F.lit(1))
    joins = F.filter(tokens, lambda t: F.lower(t).isin(CONNECTORS))
    # The cheap necessary condition goes first: most names are never split.
    return name.rlike(TWO_CONNECTORS) & (F.size(joins) >= 2) & (F.size(tokens) >= 5)


def antipattern(name: Column, strict: bool = False) -> Column:
    return F.when(is_privation(name, strict), "privation").when(is_compound(name), "compound")


def logic_symbol(text: Column) -> Column:
    """A lower-case constant that a first-order prover accepts."""
    core = F.lower(
        F.regexp_replace(F.regexp_replace(text, "[^0-9a-zA-Z_]", "_"), "^_+|_+$", "")
    )
    return F.when(core == "", "c").when(core.rlike("^[a-z]"), core).otherwise(F.concat(F.lit("c_"), core))


def predicate_symbol(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def has_words(name: Column, words) -> Column:
    return F.lower(name).rlike("|".join(words))


def suggests(category: str, name: Column) -> Column:
    return has_words(name, CATEGORY_WORDS[category])


def suggests_class(cls: str, name: Column) -> Column:
    return has_words(name, CLASS_WORDS[cls])


def is_temporal_name(name: Column) -> Column:
    return F.lower(name).rlike(TEMPORAL_WORDS)


def node_type(name: Column, vocabulary_keys, fixed: bool = False) -> Column:
    """Node type of a class name; ``fixed`` skips the catch-all vocabulary branch."""
    lowered = F.lower(name)
    out = None
    if not fixed:
        squeezed = F.replace(lowered, F.lit("_"), F.lit(""))
        hit = lowered.rlike("|".join(vocabulary_keys)) | squeezed.rlike(
            "|".join(k.replace("_", "") for k in vocabulary_keys)
        )
        out = F.when(hit, "IndependentContinuant")
    for kind, words in NODE_TYPE_WORDS:
        cond = lowered.rlike("|".join(words))
        out = out.when(cond, kind) if out is not None else F.when(cond, kind)
    return out.otherwise("IndependentContinuant")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_uploadable(path: Column) -> Column:
    return path.contains(".") & F.lower(F.substring_index(path, ".", -1)).isin(UPLOAD_EXTENSIONS)
