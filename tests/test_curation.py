"""Curation and training pairs on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from codequarry.plans import curation, maps


@pytest.fixture(scope="module")
def functions(spark):
    rows = [
        (1, "short doc"),
        (2, "d" * 100),  # summary alike and longer: dropped, but brief, so it returns
        (3, "d" * 130),  # summary alike and longer: dropped for good
        (4, "d" * 110),  # far from its summary: stays
        (5, "d" * 500),  # takes its summary
        (6, "d" * 90),  # has no summary: returns
        (7, "d" * 120),  # has no summary, too long
        (8, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, docstring string")
    return df.select(
        "id",
        F.concat(F.lit("f"), "id").alias("name"),
        F.array(F.lit("a"), F.lit("b")).alias("args"),
        F.lit("x\ny").alias("body"),
        "docstring",
    )


@pytest.fixture(scope="module")
def judged(spark, functions):
    near, far = [0.0, 0.0], [30.0, 0.0]
    rows = [
        (1, "s" * 20, near),
        (2, "s" * 150, near),
        (3, "s" * 150, near),
        (4, "s" * 20, far),
        (5, "s" * 20, near),
    ]
    short = spark.createDataFrame(rows, "id bigint, short_docstring string, vec array<double>")
    docs = short.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    return curation.judge_summaries(
        functions.join(short.drop("vec"), "id"), docs, short.select("id", "vec")
    )


def test_curate(functions, judged):
    curated = curation.curate(functions, judged)
    assert curated.columns == [
        "id", "name", "args", "body", "docstring", "short_docstring", "filtered_docstring",
    ]
    found = {row.id: row for row in curated.collect()}
    assert sorted(found) == [1, 2, 4, 5, 6]
    assert found[1].filtered_docstring == "short doc"
    assert found[4].filtered_docstring == "d" * 110
    assert found[5].filtered_docstring == "s" * 20 and found[5].docstring == "d" * 500
    for returned in (2, 6):
        assert found[returned].filtered_docstring is None
        assert found[returned].short_docstring is None
        assert found[returned].name == f"f{returned}"


def test_training_pairs(functions, judged):
    curated = curation.curate(functions, judged)
    twice = curated.unionByName(curated.withColumn("id", F.col("id") + 100))
    pairs = curation.training_pairs(twice)
    found = {row.id: row for row in pairs.collect()}
    assert sorted(found) == [1, 2, 4, 5, 6]
    assert found[1].x == "def f1(a, b):\n x y"
    assert found[2].y == "d" * 100
    assert {row.part for row in found.values()} <= {"train", "test"}


def test_vector_missing_means_no_distance(spark, functions):
    none = spark.createDataFrame([], "id bigint, vec array<double>")
    short = functions.where("id = 5").withColumn("short_docstring", F.lit("s"))
    row = curation.judge_summaries(short, none, none).first()
    assert row.distance is None and row.filtered_docstring == "s"


def test_quality_report(spark):
    code = spark.range(40).selectExpr("id", "array(1D, CAST(id AS DOUBLE)) AS vec")
    other = spark.range(40).selectExpr("id", "array(CAST(id AS DOUBLE), 1D) AS vec")
    report = curation.quality_report(code, {"same": code, "other": other}, bins=10)
    assert report.groupBy("label").count().orderBy("label").collect() == [("other", 10), ("same", 10)]


def test_map_points(spark):
    coords = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (2, 1.0, 1.0, 0.0)], "id bigint, x double, y double, z double")
    clusters = spark.createDataFrame([(1, 7), (3, 8)], "id bigint, cluster int")
    functions = spark.createDataFrame([(1, "f", "body", "-")], "id bigint, name string, body string, docstring string")
    points = maps.map_points(coords, clusters, functions)
    assert points.orderBy("id").select("id", "cluster", "name").collect() == [
        (1, 7, "f"),
        (2, None, None),
        (3, 8, None),
    ]
    assert maps.map_box(points).first() == (0.0, 1.0, 1.0, 1.0, 0.0, 2.0)


def test_requests(functions):
    prompts = {r.id: r.prompt for r in curation.summary_requests(functions).collect()}
    assert len(prompts) == 7 and prompts[1] == "Docstring: short doc. Function body: x\ny; Summary: "
    texts = {r.id: r.text for r in curation.embedding_requests(functions, cap=8).collect()}
    assert texts[8] == "def f8(a"
