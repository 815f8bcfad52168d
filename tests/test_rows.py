"""Documents, sections and orders are worked on in their own rows: plans stay small and nothing large is shuffled."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import decision

SF = "/root/testdata/sf0.001"
DOCS = "graph_id string, source string, text string"
LONG = "# Problem\nlate\n# Context\nold\n# Option A: fast\nx\n| Option | Cons | Decision |\n|---|---|---|\n| Cheap | slow | yes |\n# Decision\nWe choose fast. Status: accepted\n- Pro: quick\n# Result\n- fine\n"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize(("name", "most"), [("decision_edges", 2), ("option_selection", 1)])
def test_decision_plans_read_orders_once(spark, name, most):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and exchanges(df) <= most


def test_edges_of_documents_are_those_of_the_log(spark):
    d = spark.createDataFrame([("a", "a.md", LONG), ("b", "", LONG[::-1]), ("c", "", None)], DOCS)
    rows = lambda df: sorted(map(repr, df.select("graph_id", "src", "dst", "label", "pos").collect()))
    got = rows(decision.with_edges(decision.logs(d)).select("graph_id", F.inline("edges")))
    assert got == rows(decision.decision_edges(decision.events(d).orderBy(F.rand(1))))
    selects = [r.dst for r in decision.decision_edges(decision.events(d)).where("label = 'selects'").orderBy("pos").collect()]
    assert ["cheap" in x for x in selects] == [True, False]


@pytest.mark.parametrize("name", ["md_table_rows", "table_evidence"])
def test_tables_are_read_in_their_section(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and exchanges(df) <= 1


@pytest.mark.parametrize("name", ["md_table_rows", "table_evidence"])
def test_orders_are_dealt_without_gathering_rows(spark, name):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        df = entry.queries()[name](spark, SF)
        parts = df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert 24 <= parts <= 200  # spark.shuffle.sort.bypassMergeThreshold


@pytest.mark.parametrize("name", ["md_table_rows", "table_evidence", "decision_roles", "decision_items", "option_selection"])
def test_tasks_over_orders_hold_no_rows(spark, name):
    sc, was = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    sc.setJobGroup(group := f"peak of {name}", name)
    try:
        entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", was)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {i for j in sc.statusTracker().getJobIdsForGroup(group) for i in sc.statusTracker().getJobInfo(j).stageIds}
    ran = [s for i in stages if (s := sc._jsc.sc().statusStore().lastStageAttempt(i)).numCompleteTasks()]
    assert len(ran) >= 2 and [s.peakExecutionMemory() for s in ran] == [0] * len(ran)


@pytest.mark.parametrize(("name", "n"), [("md_table_rows", 2), ("table_evidence", 1)])
def test_orders_with_one_key_keep_their_tables(spark, tmp_path, name, n):
    rows = [(1, 5.0, "1-URGENT"), (1, 6.5, "5-LOW"), (1, 6.5, "5-LOW"), (-7, 0.0, "")]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.row_index) for r in got) == sorted((k, i) for k, _, _ in rows for i in range(n))


def test_ranks_over_titles_are_those_over_pairs(spark, monkeypatch):
    from tessera.operators import links, rank

    texts = [("a b", "a b then c d"), ("a b", "c d"), ("c d", "A B and c d"), ("", "e f a b"), ("e f", ""), ("g", "grape g-g")]
    n = spark.createDataFrame([("g", str(i), t, x, float(i % 2)) for i, (t, x) in enumerate(texts)], "graph_id string, node_id string, label string, content string, score double")
    held = links.titles_held(n)
    edges = links.title_links(n).withColumn("graph_id", F.lit("g"))
    assert edges.count() == 8 and held.count() == 8
    want = {r.node_id: r["rank"] for r in rank.ranks_by_graph(n, edges, 5, tol=0.0).collect()}
    for most in (rank.LOCAL_SIZE, 0):
        monkeypatch.setattr(rank, "LOCAL_SIZE", most)
        assert {r.node_id: r["rank"] for r in rank.ranks_by_titles(n, held, 5, tol=0.0).collect()} == pytest.approx(want)


def test_support_reads_documents_once(spark):
    df = entry.queries()["support_edges"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and exchanges(df) == 0
