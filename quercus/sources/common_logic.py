"""Common Logic documents flattened to the atoms their axioms use."""

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = "doc string, axiom_no bigint, predicate string, arity bigint, error string"
TOKEN = re.compile(r"""\s+|;;[^\n]*|(?P<t>[()]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s()'"]+)""", re.S)
# Heads that wrap axioms, that declare, and that combine formulas.
WRAPPERS = {"cl:text", "cl:ttl", "cl:comment", "cl:module"}
DECLARATIONS = {"cl:outdiscourse", "cl:imports"}
QUANTIFIERS = {"forall", "exists"}
CONNECTIVES = {"and", "or", "not", "if", "iff"}
FORMULAS, SKIP, ATOM = "formulas", "skip", "atom"


def _atoms(doc: str, text: str):
    """One pass over the tokens; a stack remembers what each open list holds.

    A frame is [what it holds, predicate, arguments so far, axiom number].
    """
    stack, axiom, fresh = [], 0, False
    for m in TOKEN.finditer(text):
        token = m.group("t")
        if token is None:
            continue
        if fresh:  # first token after "(" decides what the list is
            fresh = False
            outer = stack[-1][0] if stack else WRAPPERS
            head = token.lower()
            if outer in (SKIP, ATOM):
                stack.append([SKIP, None, 0, 0])
            elif outer is QUANTIFIERS:  # the variable list
                stack[-1][0] = FORMULAS
                stack.append([SKIP, None, 0, 0])
            elif head in DECLARATIONS and outer is WRAPPERS:
                stack.append([SKIP, None, 0, 0])
            elif head in WRAPPERS and outer is WRAPPERS:
                stack.append([WRAPPERS, None, 0, 0])
            else:
                if outer is WRAPPERS:
                    axiom += 1
                if head in QUANTIFIERS:
                    stack.append([QUANTIFIERS, None, 0, axiom])
                elif head in CONNECTIVES:
                    stack.append([FORMULAS, None, 0, axiom])
                elif head == "=":
                    stack.append([SKIP, None, 0, axiom])
                else:
                    stack.append([ATOM, token, 0, axiom])
            if token not in "()":
                continue
        if token == "(":
            if stack and stack[-1][0] == ATOM:
                stack[-1][2] += 1
            fresh = True
        elif token == ")":
            if not stack:
                raise ValueError("unexpected ')'")
            kind, predicate, arity, number = stack.pop()
            if kind == ATOM:
                yield (doc, number, predicate, arity)
        elif stack and stack[-1][0] == ATOM:
            stack[-1][2] += 1
    if stack or fresh:
        raise ValueError("unbalanced '('")


def _rows(doc: str, text: str):
    """The atoms of a document, or one row that says why it has none."""
    try:
        return [(*r, None) for r in _atoms(doc, text or "")]
    except ValueError as exc:
        return [(doc, None, None, None, str(exc))]


def _flatten(batches):
    for batch in batches:
        rows = [r for doc, text in zip(batch["doc"], batch["value"]) for r in _rows(doc, text)]
        frame = pd.DataFrame(rows, columns=["doc", "axiom_no", "predicate", "arity", "error"], dtype=object)
        yield frame.astype({"axiom_no": "Int64", "arity": "Int64"})


def parse(documents: DataFrame) -> DataFrame:
    """``documents(doc, value)`` -> one row per predicate use, or one with ``error`` for a broken document."""
    return documents.select("doc", "value").mapInPandas(_flatten, ATOMS)


def atoms(documents: DataFrame) -> DataFrame:
    """``documents(doc, value)`` -> one row per predicate use of the documents that parse."""
    return parse(documents).where("error IS NULL").drop("error")


def dead_letters(documents: DataFrame) -> DataFrame:
    """(artifact_id, code, message) of the documents that do not parse."""
    return parse(documents).where("error IS NOT NULL").select(
        F.col("doc").alias("artifact_id"), F.lit("E_PARSE").alias("code"), F.col("error").alias("message")
    )


def read_common_logic(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    return atoms(texts.select(F.col("_metadata.file_name").alias("doc"), "value"))


def predicate_inventory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("predicate", "arity").agg(F.count(F.lit(1)).alias("uses"))


def drifting_predicates(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("predicate").agg(F.countDistinct("arity").alias("arities")).where("arities > 1")


def unmapped(inventory: DataFrame, signature: DataFrame) -> DataFrame:
    """Predicates the signature table does not know."""
    return inventory.select("predicate", "arity").join(signature, "predicate", "left_anti")


def arity_mismatches(inventory: DataFrame, signature: DataFrame) -> DataFrame:
    """Predicates used at another arity than the signature's."""
    declared = signature.select("predicate", F.col("arity").alias("declared"))
    return inventory.join(declared, "predicate").where("arity <> declared").select("predicate", "arity", "declared")


# Predicates of the BFO 2020 axiomatization and their arities.
SIGNATURE = [
    ("universal", 1),
    ("particular", 1),
    ("entity", 1),
    ("temporal-part-of", 2),
    ("proper-temporal-part-of", 2),
    ("has-temporal-part", 2),
    ("has-proper-temporal-part", 2),
    ("occurrent-part-of", 2),
    ("proper-occurrent-part-of", 2),
    ("has-occurrent-part", 2),
    ("has-proper-occurrent-part", 2),
    ("precedes", 2),
    ("preceded-by", 2),
    ("occurs-in", 2),
    ("environs", 2),
    ("history-of", 2),
    ("has-history", 2),
    ("occupies-temporal-region", 2),
    ("occupies-spatiotemporal-region", 2),
    ("temporally-projects-onto", 2),
    ("has-first-instant", 2),
    ("first-instant-of", 2),
    ("has-last-instant", 2),
    ("last-instant-of", 2),
    ("exists-at", 2),
    ("specifically-depends-on", 2),
    ("specifically-depended-on-by", 2),
    ("inheres-in", 2),
    ("bearer-of", 2),
    ("realizes", 2),
    ("has-realization", 2),
    ("instance-of", 3),
    ("continuant-part-of", 3),
    ("has-continuant-part", 3),
    ("proper-continuant-part-of", 3),
    ("has-proper-continuant-part", 3),
    ("member-part-of", 3),
    ("has-member-part", 3),
    ("participates-in", 3),
    ("has-participant", 3),
    ("located-in", 3),
    ("location-of", 3),
    ("occupies-spatial-region", 3),
    ("spatially-projects-onto", 3),
    ("generically-depends-on", 3),
    ("concretizes", 3),
    ("is-concretized-by", 3),
    ("has-material-basis", 3),
    ("material-basis-of", 3),
    ("is-carrier-of", 3),
]


def signature_rows():
    return list(SIGNATURE)
