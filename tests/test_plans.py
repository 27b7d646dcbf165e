"""What the plans must look like, whatever the results."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.operators.counts import counts, individuals
from quercus.operators.rules import entailed_assertions, entailed_types
from quercus.plans import queries as Q
from quercus.plans import starmap
from quercus.plans.starmap import abox
from quercus.sources.relational import tables_to_triples
from quercus.workspace import TASK_ROWS, Workspace, dealt

X_ = "http://x/"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def plans(monkeypatch):
    """Plans of every table written while a query is put together."""
    seen = []
    write = Workspace.write

    def recording(self, df, name, partition_by=None):
        seen.append(plan_of(df))
        return write(self, df, name, partition_by)

    monkeypatch.setattr(Workspace, "write", recording)
    return seen


@pytest.mark.parametrize(
    "name", ["J8_straddle_lint", "A6_counts", "M4_inconsistent_individuals", "F10_class_emptiness", "J17_document_words",
             "GDx_shapes", "B4_B8_violations", "L3_coverage"],
)
def test_no_nested_loops(spark, plans, name):
    Q.corpus(spark, SMALL)
    plans.append(plan_of(Q.QUERIES[name](spark, SMALL)))
    for text in plans:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    text = plan_of(Q.QUERIES["A1_declarations"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(p)" in text and "o_lang" not in text.split("ReadSchema")[1].split("\n")[0]


def test_findings_gather_no_artifact_in_a_task(spark):
    for name in ("W4_orphan_findings", "GD_W5_competency"):
        assert "Window" not in plan_of(Q.QUERIES[name](spark, SMALL))


def test_first_n_is_ranked_in_slices(spark):
    windows = [x for x in plan_of(Q.QUERIES["W7_capped_inferences"](spark, SMALL)).split("\n") if "row_number" in x and "Window" in x]
    assert windows and all("_slice" in x for x in windows)


def test_newest_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(Q.QUERIES["W2_newest_twenty"](spark, SMALL))


def test_load_deals_by_rows(spark):
    """Joins of the load are not put together by bytes, so a task's rows do not grow with the tables."""
    assert dealt(spark.range(10), 30 * TASK_ROWS, "id").rdd.getNumPartitions() == 30
    plan = plan_of(abox(spark, SMALL))
    for key in ("o_custkey", "l_orderkey", "l_partkey"):
        assert any(f"hashpartitioning({key}#" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())


def test_shapes_are_constants(spark):
    """Individuals are not shuffled by their few classes to meet the shapes."""
    plan = plan_of(Q.QUERIES["GDx_shapes"](spark, SMALL))
    assert "ExistingRDD" not in plan and "hashpartitioning(cls#" not in plan


def fullest(df):
    """Rows of the task that holds most."""
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_a_source_file_of_few_bytes_is_laid_out_by_many_tasks(spark, monkeypatch):
    whole = sorted(map(tuple, starmap.tbox(spark, SMALL).collect()))
    monkeypatch.setattr("quercus.workspace.TASK_ROWS", 100)
    rows = starmap.tbox(spark, SMALL)
    assert sorted(map(tuple, rows.collect())) == whole
    classes = rows.where(F.col("s").startswith(starmap.EX + "part/"))
    assert classes.count() > 500 and fullest(classes) <= 200


def test_individuals_of_one_type_are_dealt_to_many_tasks(graph, ws, monkeypatch):
    monkeypatch.setattr("quercus.workspace.TASK_ROWS", 100)
    told = [(X_ + "K", S.TYPE, S.CLASS), (X_ + "m", S.TYPE, S.NAMED_INDIVIDUAL), (X_ + "n", S.TYPE, X_ + "Elsewhere")]
    t = graph({"a": told + [(f"{X_}i{n}", S.TYPE, X_ + "K") for n in range(2000)] * 2, "b": [(X_ + "i0", S.TYPE, X_ + "K")]})
    found = individuals(t, ws)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, individuals(t).collect())) and found.count() == 2001
    assert fullest(found) <= 200
    assert {r["artifact_id"]: r["individuals"] for r in counts(t, ws).collect()} == {"a": 2001, "b": 0}


def test_triples_of_tables_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("quercus.workspace.TASK_ROWS", 100)
    n = spark.range(1000).select(F.lit("a").alias("artifact_id"), "id", F.concat(F.lit("n"), "id").alias("name"), F.lit("").alias("description"))
    classes = n.select("*", F.lit(None).cast("string").alias("upper_id"), F.lit(1).cast("bigint").alias("parent_id")).coalesce(1)
    none = n.where("id < 0")
    properties = none.select("*", F.lit("data").alias("property_type"), F.col("id").alias("domain_class_id"), F.col("id").alias("range_class_id"))
    things = none.select("*", F.col("id").alias("class_id"), F.create_map("id", "name").alias("property_values"))
    rows = tables_to_triples(classes.union(classes), properties, things, X_)
    assert rows.count() == 4000 and fullest(rows) <= 300


def test_rules_of_assertions_and_types_are_picked_without_sorting(graph, ws, plans):
    link = [(X_ + "p", S.TYPE, S.OBJECT_PROPERTY), (X_ + "q", S.TYPE, S.OBJECT_PROPERTY), (X_ + "p", S.SUBPROPERTY, X_ + "q"), (X_ + "q", S.DOMAIN, X_ + "K")]
    t = graph({"a": link + [(X_ + "K", S.SUBCLASS, X_ + "L"), (X_ + "i", X_ + "p", X_ + "j"), (X_ + "i", X_ + "q", X_ + "j"), (X_ + "i", S.TYPE, X_ + "L")]})
    props = entailed_assertions(t, ws)
    types = entailed_types(t, ws, props)
    assert {(r["p"], r["rule"]) for r in props.collect()} == {(X_ + "p", "asserted"), (X_ + "q", "asserted")}
    assert {(r["cls"], r["rule"]) for r in types.collect()} == {(X_ + "K", "prp-dom"), (X_ + "L", "asserted")}
    assert "SortAggregate" not in plan_of(props) + plan_of(types)
