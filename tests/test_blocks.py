"""Scores in blocks against the same scores made pair by pair, on rows that are odd."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import dot, normalised
from quarry.operators import blocks
from quarry.operators.markdown import descendants
from quarry.operators.retrieval import Weighed, bm25, top_k
from quarry.operators.structuring import markdown_nodes
from quarry.operators.tree import numbered
from quarry.plans.catalogue import QUERIES
from quarry.sources.tables import paragraphs

TEXTS = [(1, "a b c\nb b d\n\n e a"), (1, "a b c\nx"), (2, "c\tc\nA b"), (None, "a d"), (3, None), (4, ""), (5, " \t \na a a b"), (6, "b " * 5000 + "\na")]


@pytest.fixture
def odd(spark):
    return paragraphs(spark.createDataFrame(TEXTS, "doc_id long, text string")), spark.createDataFrame([(1, "a b b"), (2, "d"), (3, "none"), (4, None), (None, "c a")], "query_id long, query string")


def same(a, b, *columns):
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("cells", [4_000_000, 7])
@pytest.mark.parametrize("queries", [512, 2])
def test_best_and_counts_are_those_of_all_pairs(spark, odd, monkeypatch, cells, queries):
    par, q = odd
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "QUERIES", queries)
    monkeypatch.setattr(blocks, "KEPT", 0)
    pairs, x = bm25(par, q).localCheckpoint(), Weighed(par, q)
    for k in (1, 3, 50):
        same(top_k(pairs, k, "doc_id", "p_idx"), x.best(k), "query_id", "doc_id", "p_idx", "score", "rank")
        same(top_k(pairs.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, "doc_id"), x.best(k, documents=True), "query_id", "doc_id", "score", "rank")
    same(pairs.groupBy("query_id").agg(F.count("*").alias("n")), x.counts(), "query_id", "n")
    docs = pairs.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    gold = spark.createDataFrame([(1, 6), (2, 1), (3, 1)], "query_id long, doc_id long")
    own = par.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    same(top_k(docs, 99, F.asc_nulls_last("doc_id")).join(gold, ["query_id", "doc_id"]), x.places(gold, own), "query_id", "rank")


def test_nothing_of_the_pairs_is_shuffled(spark, tmp_path):
    """The plan of a query over all paragraphs exchanges documents and the best of each task, not pairs."""
    spark.createDataFrame([(i, "the word\n" * 3 + str(i)) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "the word") for i in range(20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("r02_bm25_topk", "r17_query_expansion", "r23_gate"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate explode" not in plan.split("MapInArrow")[0]


def test_cosines_of_odd_vectors_are_those_of_all_pairs(spark, monkeypatch):
    v = [[1.0, 0.0], [0.6, 0.8], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [3.0, 4.0], [1.0, 2.0, 3.0], [], [-1.0, 0.0], [float("inf"), 1.0]]
    n = spark.createDataFrame([*enumerate(v), (0, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, v array<double>").select("vec_id", normalised(F.col("v")).alias("e"))
    q = n.toDF("query_id", "qe")
    monkeypatch.setattr(blocks, "KEPT", 0)
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("qe"), F.col("e")))), 4)
    pairs = n.join(q, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", score.alias("score"))
    for k in (2, 100):
        for block in (3, 10_000):
            got = blocks.best_vectors(n, q, k, 4, [("vec_id", "ascending")], others="vec_id", block=block)
            same(top_k(pairs.where("query_id is not null"), k, "vec_id"), top_k(got, k, "vec_id"), "query_id", "vec_id", "score", "rank")


def test_nesting_of_headings_needs_no_function_for_a_document(spark):
    docs = spark.createDataFrame([(1, "### a\n# b\n#### c\n###### d\n## e\n### f\n# g"), (2, "#### x\n###### y\n##### z")], "doc_id long, text string")
    nodes = markdown_nodes(docs)
    assert [tuple(r) for r in nodes.orderBy("doc_id", "node_id").select("node_id", "level", "parent_id").collect()] == [
        (1, 1, None), (2, 1, None), (3, 2, 2), (4, 3, 3), (5, 2, 2), (6, 3, 5), (7, 1, None), (1, 1, None), (2, 2, 1), (3, 2, 1),
    ]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan(nodes)
    for made in (numbered(nodes), descendants(nodes)):
        assert "unboundedfollowing" not in plan(made).replace("unboundedpreceding$(), unboundedfollowing", "")


def test_titles_and_whole_headings_leave_only_the_best_of_a_task(spark, tmp_path):
    from quarry.operators.routing import route_titles

    spark.createDataFrame([(i, "The growth of state 7\nZ\n7") for i in range(40)] + [(99, "growth state seven")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Growth of the state 7"), (2, "seven"), (3, "-")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    heads = QUERIES["r09_whole_heading_search"](spark, str(tmp_path))
    assert "MapInArrow" in heads._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.rank, r.doc_id, r.p_idx, r.score) for r in heads.collect()) == [(1, i + 1, i, 0, 6) for i in range(5)] + [(2, 1, 99, 0, 1)]
    q = spark.createDataFrame([(1, "Growth of the state 7"), (2, "?")], "query_id long, query string")
    docs = spark.createDataFrame([(i, "growth-state7 x") for i in range(2)] + [(50, "of the"), (51, None), (52, "--"), (53, "ofthe")], "doc_id long, source_name string")
    got = route_titles(q, docs, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ok, r.doc_id, r.score) for r in got] == [(1, True, 0, 19.0), (1, True, 1, 19.0), (1, True, 53, 15.0), (1, True, 50, 13.5), (2, False, None, None)]
    assert [r.matched_terms for r in got] == [["7", "growth", "state", "state7"]] * 2 + [["ofthe"], ["of", "the"], None]
