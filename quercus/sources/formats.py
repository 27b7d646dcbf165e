"""Which serialisation a file is in: by extension, and by looking at its start."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parse formats by extension, and the fallback order.
BY_EXTENSION = {
    "ttl": "turtle", "n3": "n3", "nt": "nt", "rdf": "xml", "owl": "xml", "xml": "xml", "owx": "xml",
    "jsonld": "json-ld", "trig": "trig",
}
FALLBACKS = ["xml", "turtle", "n3", "nt", "json-ld"]
SNIFFED_CHARACTERS = 1000
SNIFFED_LINES = 10


def candidate_formats(extension: Column) -> Column:
    """Formats to try, the extension's own first."""
    known = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    own = F.element_at(known, F.lower(extension))
    order = F.array(*map(F.lit, FALLBACKS))
    return F.when(own.isNull(), order).otherwise(F.array_union(F.array(own), order))


def sniff_format(content: Column) -> Column:
    """Format by the first 1,000 characters; an unreadable file (NULL) counts as xml."""
    head = F.substring(content, 1, SNIFFED_CHARACTERS)
    bare = F.regexp_replace(head, r"^\s+|\s+$", "")
    lines = F.transform(
        F.slice(F.split(head, "\n", -1), 1, SNIFFED_LINES), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    )
    filled = F.filter(lines, lambda x: x != "")
    return (
        F.when(content.isNull(), "xml")
        .when(bare.startswith("<?xml") | head.contains("<rdf:RDF") | head.contains("<owl:Ontology"), "xml")
        .when(F.exists(lines, lambda x: x.startswith("@")), "turtle")
        .when(F.forall(filled, lambda x: x.endswith(".") | x.startswith("#")), "nt")
        .when(bare.startswith("{") & head.contains('"@context"'), "json-ld")
        .otherwise("turtle")
    )
