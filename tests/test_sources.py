import json

from conftest import UP
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions import formulas as X
from quercus.functions import names as N
from quercus.operators.expressions import check_expressions
from quercus.sources import common_logic as CL
from quercus.sources import formats as FM
from quercus.sources import ntriples as NT
from quercus.sources import sinks


def lines(spark, *texts):
    return spark.createDataFrame([("a", t) for t in texts], "artifact_id string, value string")


def test_ntriples_grammar(spark):
    triples, errors = NT.parse_lines(lines(
        spark,
        "<http://x/s> <http://x/p> <http://x/o> .",
        '_:b1 <http://x/p> "tab\\t quote\\" back\\\\ \\u00e9 \\U0001F600"@en-GB . # note',
        '<http://x/s> <http://x/p> "5"^^<http://x/int> <http://x/graph> .',
        "# comment", "", "<http://x/s> <http://x/p> .", '<http://x/s> <http://x/p> "open .',
    ))
    rows = {(r["s"], r["o"], r["o_kind"], r["o_datatype"], r["o_lang"]) for r in triples.collect()}
    assert rows == {
        ("http://x/s", "http://x/o", "iri", None, None),
        ("_:a/b1", 'tab\t quote" back\\ é \U0001F600', "literal", None, "en-GB"),
        ("http://x/s", "5", "literal", "http://x/int", None),
    }
    assert errors.count() == 2 and errors.first()["code"] == "E_PARSE"


def test_very_long_literal(spark):
    text = 'x\\n"'.replace('"', '\\"') * 50_000
    triples, errors = NT.parse_lines(lines(spark, f'<http://x/s> <http://x/p> "{text}" .'))
    assert errors.count() == 0 and len(triples.first()["o"]) == 150_000


def test_sniffing(spark):
    texts = {
        "xml": "<?xml version='1.0'?>", "turtle": "# c\n@prefix a: <b> .", "nt": "<a> <b> <c> .\n# x", "json-ld": '{ "@context": 1\n}',
    }
    df = spark.createDataFrame(list(texts.items()) + [("xml", None), ("turtle", "hello")], "want string, t string")
    assert df.where(FM.sniff_format(F.col("t")) != F.col("want")).count() == 0


def test_common_logic(spark):
    text = """(cl:comment 'not (an axiom)' (cl:ttl "t" (cl:text (cl:outdiscourse p q)
      (forall (x y) (if (instance-of x y t) (exists (z) (and (= x z) (part-of z (f x)) (not (role z)))))) ;; (no)
      (universal role))))"""
    rows = CL.atoms(spark.createDataFrame([("d", text)], "doc string, value string")).collect()
    assert sorted((r["axiom_no"], r["predicate"], r["arity"]) for r in rows) == [
        (1, "instance-of", 3), (1, "part-of", 2), (1, "role", 1), (2, "universal", 1)]
    assert [sum(n == k for _, n in CL.signature_rows()) for k in (1, 2, 3)] == [3, 28, 19]


def test_broken_common_logic_is_a_row(spark):
    docs = spark.createDataFrame([("good", "(p a)"), ("open", "(p (q"), ("shut", "p)"), ("none", None)], "doc string, value string")
    assert [(r["doc"], r["predicate"]) for r in CL.atoms(docs).collect()] == [("good", "p")]
    assert {(r["artifact_id"], r["code"]) for r in CL.dead_letters(docs).collect()} == {("open", "E_PARSE"), ("shut", "E_PARSE")}


def test_sinks(spark, graph, tmp_path):
    t = graph({"a": [("http://x/s", S.LABEL, 'say "hi"\n'), ("_:b", S.TYPE, S.CLASS)], "b": [("http://x/s", S.TYPE, S.CLASS)]})
    out = str(tmp_path / "nt")
    sinks.write_ntriples(t, out)
    back, errors = NT.read_ntriples(spark, out)
    assert errors.count() == 0 and back.count() == 3
    assert {r["artifact_id"] for r in back.collect()} == {"a", "b"}
    odd = graph({"1 a+b/ü=%": [("http://x/s", S.TYPE, S.CLASS)] * 1})
    sinks.write_ntriples(odd, out + "2")
    assert NT.read_ntriples(spark, out + "2")[0].first()["artifact_id"] == "1 a+b/ü=%"
    assert back.where("o_kind = 'literal'").first()["o"] == 'say "hi"\n'
    history = str(tmp_path / "history")
    rows = spark.range(300).withColumn("artifact_id", F.lit("a"))
    sinks.append_reports(rows, history)
    kept = sinks.recent_reports(spark.read.parquet(history))
    assert kept.count() == 300 and sinks.recent_reports(spark.read.parquet(history), 256).count() == 256
    one = kept.first()["report_id"]
    assert sinks.report_by_id(spark.read.parquet(history), one).count() == 1
    sinks.write_reports(spark.sql("SELECT 'a' AS artifact_id, map('A', 1) AS stages"), str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0])["stages"] == {"A": 1}


def test_formula_examples(spark):
    texts = [
        ("prover9", "all X all T (instance_of(X,force,T) -> instance_of(X,q,T))."),
        ("clif", "(forall (x t) (if (instance_of x f t) (instance_of x q t)))"),
        ("instance_of", "instance_of(x, Quality, t)"),
        ("traditional", "Continuant(x)"),
    ]
    df = spark.createDataFrame(texts, "want string, e string")
    assert df.where(X.syntax(F.col("e")) != F.col("want")).count() == 0
    closed = spark.createDataFrame([(1, "all X.all T.(instance_of(X,force,T) -> instance_of(X,quality,T))")], "expr_id bigint, expression string")
    row = check_expressions(closed).first()
    assert row["well_formed"] and not row["bfo_compatible"] and not row["valid"]
    assert row["issues"] == [] and len(row["notes"]) == 1 and row["unknown_terms"] == ["force"]


def test_names(spark):
    one = spark.range(1).select(
        N.local_name(F.lit("http://x/y/")).alias("a"), N.short_name(F.lit("http://x/y/")).alias("b"),
        N.is_upper(F.lit(UP + "1")).alias("c"), N.is_privation(F.lit("Norm")).alias("d"),
        N.is_privation(F.lit("Norm"), strict=True).alias("e"), N.logic_symbol(F.lit("__1 a-b__")).alias("f"),
    ).first()
    assert tuple(one) == ("http://x/y/", "", True, True, False, "c_1_a_b")
