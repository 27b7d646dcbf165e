"""N-Triples and N-Quads: line-oriented, so splittable to any size."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.schema import XSD

IRI = r"<[^<>\"{}|^`\\\x00-\x20]*>"
BNODE = r"_:[\w][\w.\-]*"
# Possessive loops: a literal may be millions of characters long, and they match without recursion.
LITERAL = r'"[^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+"(?:\^\^' + IRI + r"|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
LINE = (
    rf"^\s*({IRI}|{BNODE})\s*({IRI})\s*({IRI}|{BNODE}|{LITERAL})\s*({IRI}|{BNODE})?\s*\.\s*(?:#.*)?$"
)
LITERAL_PARTS = r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9\-]+))?$'
LONG_ESCAPE = r"(\\U[0-9A-Fa-f]{8})"


def _unescape(text: Column) -> Column:
    """Undo string escapes; the common case has none and stays untouched."""
    wide = F.reduce(
        F.array_distinct(F.regexp_extract_all(text, F.lit(LONG_ESCAPE), F.lit(1))),
        text,
        lambda acc, m: F.replace(acc, m, F.decode(F.unhex(F.substring(m, 3, 8)), "UTF-32")),
    )
    quoted = F.concat(F.lit('{"v":"'), F.replace(wide, F.lit("\\'"), F.lit("'")), F.lit('"}'))
    plain = F.coalesce(F.from_json(quoted, "v string")["v"], wide)
    return F.when(text.contains("\\"), plain).otherwise(text)


def _kind(term: Column) -> Column:
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")


def _value(term: Column, artifact: Column) -> Column:
    """IRI text, or a blank-node id that means something only inside its artifact."""
    return F.when(
        term.startswith("<"), _unescape(term.substr(F.lit(2), F.length(term) - 2))
    ).otherwise(F.concat(F.lit("_:"), artifact, F.lit("/"), term.substr(F.lit(3), F.length(term))))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines(artifact_id, value)`` -> (triples, dead letters with code E_PARSE)."""
    # One match per line: the three terms come back joined by a control character.
    terms = F.split(F.regexp_replace("value", LINE, "$1\u0001$2\u0001$3"), "\u0001")
    cut = (
        lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
        .select("artifact_id", "value", terms.alias("t"))
        .select(
            "artifact_id", "value", F.get("t", F.lit(0)).alias("s0"),
            F.get("t", F.lit(1)).alias("p0"), F.get("t", F.lit(2)).alias("o0"),
        )
    )
    a, o0 = F.col("artifact_id"), F.col("o0")
    literal = _kind(o0) == "literal"
    datatype = F.regexp_extract(o0, LITERAL_PARTS, 2)
    lang = F.regexp_extract(o0, LITERAL_PARTS, 3)
    triples = cut.where("o0 IS NOT NULL").select(
        "artifact_id",
        _value(F.col("s0"), a).alias("s"),
        _kind(F.col("s0")).alias("s_kind"),
        _value(F.col("p0"), a).alias("p"),
        F.when(literal, _unescape(F.regexp_extract(o0, LITERAL_PARTS, 1))).otherwise(_value(o0, a)).alias("o"),
        _kind(o0).alias("o_kind"),
        F.when(literal & (lang == ""), F.when(datatype == "", XSD + "string").otherwise(datatype)).alias("o_datatype"),
        F.when(literal & (lang != ""), lang).alias("o_lang"),
    )
    errors = cut.where("o0 IS NULL").select(
        "artifact_id", F.lit("E_PARSE").alias("code"),
        F.concat(F.lit("could not parse line (tried [nt]): "), "value").alias("message"),
    )
    return triples, errors


def artifact_of_file() -> Column:
    """The artifact of an input file: its ``artifact_id=`` folder where the writer made one, else the file's name.

    Folder names escape special characters, and file paths escape the folder names once more.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/artifact_id=([^/]*)/", 1)
    for _ in range(2):
        folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return F.when(F.col("_metadata.file_path").contains("/artifact_id="), folder).otherwise(F.col("_metadata.file_name"))


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every file, or every ``artifact_id=`` folder of files, under ``path`` is one artifact."""
    lines = spark.read.text(path)
    return parse_lines(lines.select(artifact_of_file().alias("artifact_id"), "value"))


def line_text() -> Column:
    """A triple as one N-Triples line."""
    def escaped(c):
        c = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
        for raw, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(raw), F.lit(esc))
        return c

    def node(value, kind):
        # Characters a blank-node label may not hold are spelled with a dash.
        label = F.regexp_replace(F.col(value).substr(F.lit(3), F.length(value)), r"[^\w.\-]", "-")
        return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(
            F.concat(F.lit("_:"), label)
        )

    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(
        F.col("o_datatype").isNotNull() & (F.col("o_datatype") != XSD + "string"),
        F.concat(F.lit("^^<"), "o_datatype", F.lit(">")),
    ).otherwise("")
    literal = F.concat(F.lit('"'), escaped("o"), F.lit('"'), tail)
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o", "o_kind"))
    return F.concat(node("s", "s_kind"), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" ."))


