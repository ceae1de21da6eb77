"""What the plans must and must not contain, and that results ignore partitioning."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from codequarry import catalog
from codequarry.catalog import table
from codequarry.operators import aggregates as A
from codequarry.operators import rows, tfidf

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in spark_entry.queries().items() if name in catalog.load()}
# Each fits models over and over before it has a plan to show.
FITTED = {"sweep", "best_clustering", "kmeans_labels", "kmeans_consistency"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_lookup_reaches_the_scan(spark):
    text = plan(rows.lookup(table(spark, FOLDER, "documents"), "doc_id", 7).select("lang"))
    assert "EqualTo(doc_id,7)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_dedup_is_cut_before_the_shuffle(spark):
    text = plan(A.dedup_first(table(spark, FOLDER, "documents"), ["text"], ["doc_id"]))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_search_reads_two_columns_and_shuffles_nothing(spark):
    text = plan(QUERIES["knn_cosine"](spark, FOLDER))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert text.count("ArrowEvalPython (") <= 2  # once in the tree, once in the details


def test_term_counts_shuffle_nothing(spark):
    frame = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    assert "Exchange" not in plan(tfidf.term_counts(frame, "id", "text"))


@pytest.mark.parametrize("name", ["hist_nchars", "tfidf_profile", "centroids", "dedup_text"])
def test_results_ignore_partitioning(spark, tmp_path, name):
    """The same rows from one file and from many."""
    copy = str(tmp_path)
    for source in ("documents", "embeddings"):
        df = table(spark, FOLDER, source)
        df.orderBy(F.rand(3)).repartition(9).write.parquet(f"{copy}/{source}.parquet")
    one, many = QUERIES[name](spark, FOLDER), QUERIES[name](spark, copy)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
