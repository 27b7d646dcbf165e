"""Checking a table of formulas against the vocabulary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.functions.formulas import (
    expand_quantifiers, format_of, free_variables, prover9_infix, simple_format, surface_issues, syntax, terms,
)
from quercus.sources.upper import vocabulary_rows, vocabulary_table


def match_terms(found: DataFrame) -> DataFrame:
    """``found(term)`` plus match kind (exact / partial / none), label and entry kind.

    An exact class wins over an exact relation; else the first entry that contains
    the term or is contained in it.  The vocabulary is 64 fixed entries, so the
    look-up is one generated CASE instead of a theta join.
    """
    rows = vocabulary_rows()
    exact = " ".join(f"WHEN _t = '{k}' THEN {pos}" for pos, k, *_ in rows)
    partial = " ".join(
        f"WHEN contains('{k}', _t) OR contains(_t, '{k}') THEN {pos}" for pos, k, *_ in rows
    )
    at = (
        found.withColumn("_t", F.lower("term"))
        .withColumns({"_exact": F.expr(f"CASE {exact} END"), "_partial": F.expr(f"CASE {partial} END")})
        .withColumn("_pos", F.coalesce("_exact", "_partial"))
    )
    entry = vocabulary_table(found.sparkSession).select(F.col("pos").cast("int").alias("_pos"), "label", "kind")
    return at.join(entry, "_pos", "left").select(
        *found.columns,
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_partial").isNotNull(), "partial")
        .otherwise("none").alias("match"),
        "label", "kind",
    )


def expression_terms(expressions: DataFrame) -> DataFrame:
    """(expr_id, term, match, label, kind): each distinct term is looked up once."""
    mentioned = expressions.select("expr_id", F.explode(terms(F.col("expression"))).alias("term"))
    looked_up = match_terms(mentioned.select("term").distinct())
    return mentioned.join(looked_up, "term")


def _note() -> Column:
    return F.when(
        F.col("match") == "partial",
        F.format_string("'%s' was interpreted as BFO %s '%s' (partial match).", "term", "kind", "label"),
    ).when(
        F.col("match") == "none",
        F.format_string(
            "'%s' is outside the BFO vocabulary. The expression is still valid logic; this term is just not a "
            "recognized BFO class or relation.", "term",
        ),
    )


def check_expressions(expressions: DataFrame) -> DataFrame:
    """One verdict row per (expr_id, expression).

    ``parsed`` rests on surface checks; free variables on a scope-blind test.
    """
    matched = expression_terms(expressions)

    def names(cond, value):
        return F.array_sort(F.collect_set(F.when(cond, value)))

    exact, label = F.col("match") == "exact", F.col("label")
    # The terms of one formula are bounded by its length.
    per = matched.groupBy("expr_id").agg(
        names(exact & (F.col("kind") == "class"), label).alias("classes_used"),
        names(exact & (F.col("kind") == "relation"), label).alias("relations_used"),
        names(F.col("match") == "none", F.col("term")).alias("unknown_terms"),
        F.array_sort(F.collect_set(_note())).alias("notes"),
    )
    none = F.array().cast("array<string>")
    blank = F.trim("expression") == ""
    free, surface = free_variables(F.col("expression")), surface_issues(F.col("expression"))
    unbound = F.when(
        F.size(free) > 0,
        F.array(F.concat(F.lit("Found free variables not bound by quantifiers: "), F.array_join(free, ", "))),
    ).otherwise(none)
    base = expressions.select(
        "expr_id", "expression",
        format_of(F.col("expression")).alias("format"),
        (~blank & (F.size(surface) == 0)).alias("parsed"),
        F.when(blank, F.array(F.lit("Empty expression provided"))).otherwise(F.concat(surface, unbound)).alias("issues"),
    )
    out = base.join(per, "expr_id", "left")
    for c in ("classes_used", "relations_used", "unknown_terms", "notes"):
        out = out.withColumn(c, F.coalesce(c, none))
    well, compatible = F.col("parsed") & (F.size("issues") == 0), F.size("unknown_terms") == 0
    return out.withColumns(
        {"well_formed": well, "bfo_compatible": compatible, "valid": well & compatible}
    )


def prepare(expressions: DataFrame) -> DataFrame:
    """Adds the detected syntax and the text the checks run on."""
    e = F.col("expression")
    kind = syntax(e)
    text = F.when(kind == "prover9", prover9_infix(e)).when(kind == "clif", e).otherwise(expand_quantifiers(e))
    return expressions.withColumns({"syntax": kind, "prepared": text, "simple_format": simple_format(e)})


def check_table(expressions: DataFrame) -> DataFrame:
    """End to end: detect, prepare, check; ready to append to a results table."""
    ready = prepare(expressions)
    verdict = check_expressions(ready.select("expr_id", F.col("prepared").alias("expression")))
    return ready.join(verdict.drop("expression"), "expr_id")


def vocabulary_usage(found: DataFrame, spark) -> DataFrame:
    """Vocabulary listing with how many expressions use each entry exactly."""
    used = found.where("match = 'exact'").groupBy(F.lower("term").alias("key")).agg(
        F.countDistinct("expr_id").alias("expressions")
    )
    return vocabulary_table(spark).join(used, "key", "left").select(
        "key", "label", "uri", "kind", F.coalesce("expressions", F.lit(0)).cast("bigint").alias("expressions")
    )
