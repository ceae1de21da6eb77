import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.functions import vectors as V
from codequarry.operators import pivots
from codequarry.operators import search as S
from codequarry.session import scratch_path


def score(spark, a, b, metric, p=2.0):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(V.measure(F.col("a"), F.col("b"), metric, p)).first()[0]


@pytest.mark.parametrize(
    "a, b, metric, p, out",
    [
        ([0.0, 0.0], [3.0, 4.0], "l2", 2, 5.0),
        ([1.0, 2.0], [3.0, 5.0], "minkowski", 3, 35 ** (1 / 3)),
        ([1.0, 2.0], [3.0, 5.0], "minkowski", 1, 5.0),
        ([1.0, 2.0], [1.0, 2.0], "minkowski", 0.1, 0.0),
        ([0.0, 1e-30], [1e-30, 0.0], "minkowski", 20, 1e-30 * 2 ** (1 / 20)),
        ([1e200, 0.0], [0.0, 1e200], "minkowski", 2, 1e200 * math.sqrt(2)),
        ([1.0, 2.0], [3.0, 4.0], "dot", 2, 11.0),
        ([2.0, 0.0], [1.0, 1.0], "cosine", 2, math.sqrt(0.5)),
        ([0.0, 0.0], [1.0, 1.0], "cosine", 2, None),
        ([1.0], [1.0, 1.0], "l2", 2, None),
        (None, [1.0], "dot", 2, None),
        ([1.0, None], [1.0, 1.0], "dot", 2, None),
        ([], [], "dot", 2, None),
    ],
)
def test_measures(spark, a, b, metric, p, out):
    found = score(spark, a, b, metric, p)
    assert found is None if out is None else found == pytest.approx(out, rel=1e-12)


def test_bad_metric(spark):
    with pytest.raises(ValueError):
        V.metric_kernel("manhattan")
    with pytest.raises(ValueError):
        V.metric_kernel("minkowski", 0)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)]
    rows += [(100, [0.0, 0.0, 0.0]), (101, [1.0]), (102, None)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "minkowski"])
@pytest.mark.parametrize("farthest", [False, True])
def test_knn_matches_full_sort(spark, points, metric, farthest):
    query = [1.0, 2.0, 3.0]
    scored = points.select("id", V.measure_to(F.col("vec"), query, metric, 3).alias("s")).collect()
    up = V.metric_kernel(metric)[1] == farthest
    best = sorted((r for r in scored if r.s is not None), key=lambda r: (r.s if up else -r.s, r.id))
    found = S.knn(points, query, 12, metric, 3, farthest).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in best[:12]]


def test_knn_returns_all_when_k_is_large(points):
    assert S.knn(points, [1.0, 2.0, 3.0], 1000).count() == 100  # zero, short, NULL left out


def test_knn_batch_equals_single_queries(spark, points, monkeypatch):
    queries = [(q, [float(q), 1.0, 2.0]) for q in range(5)]
    df = spark.createDataFrame(queries, "qid bigint, qvec array<double>")
    for rows, asked in ((4096, 1024), (7, 2)):  # one part, several
        monkeypatch.setattr(pivots, "CELL_ROWS", rows)
        monkeypatch.setattr(pivots, "QUERY_ROWS", asked)
        for metric in ("dot", "l2"):
            batch = S.knn_batch(points, df, 7, metric).orderBy("qid", "rank").collect()
            single = [
                (qid, row.id, row.score, rank + 1)
                for qid, vec in queries
                for rank, row in enumerate(S.knn(points, vec, 7, metric).collect())
            ]
            assert [tuple(row) for row in batch] == single


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Clusters, one very common vector, ties, other widths, zeros, NULLs, NaN and infinity."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4)) * 0.3 + rng.integers(0, 3, size=(600, 1)) * 6.0 - 5.0
    x[100:300] = x[100]
    rows = [(i % 550, v.tolist()) for i, v in enumerate(x)]
    rows += [(700 + i, [float(i), 1.0]) for i in range(5)] + [(800, [0.0] * 4), (801, None), (802, [])]
    rows += [(803, [math.nan] * 4), (804, [math.inf] * 4), (805, [1.0, None, 2.0, 3.0]), (None, [1.0] * 4)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(4).cache()


def nearest(rows, q, k, metric, p):
    """(score, id) of the best ``k`` rows, in plain numpy."""
    kernel, larger = V.metric_kernel(metric, p)
    found = []
    for r in rows:
        if r.vec and q and len(r.vec) == len(q) and None not in r.vec and None not in q:
            with np.errstate(all="ignore"):
                score = float(kernel(np.array([r.vec]), np.array([q]))[0])
            if math.isfinite(score):
                found.append(((-score if larger else score), (r.id is not None, r.id or 0), score))
    return [(round(s, 9), key[1] if key[0] else None) for _, key, s in sorted(found)[:k]]


@pytest.mark.parametrize("metric, p", [("l2", 2), ("cosine", 2), ("dot", 2), ("minkowski", 3), ("minkowski", 0.5)])
def test_knn_join_against_numpy(spark, odd_vectors, monkeypatch, metric, p):
    for name, value in (("CELL_ROWS", 50), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(pivots, name, value)
    rows = odd_vectors.collect()
    asked = [(i, r.vec) for i, r in enumerate(rows) if i % 23 == 0 or i > 595]
    queries = spark.createDataFrame(asked, "qid bigint, qvec array<double>")
    got = {}
    for r in pivots.knn_join(odd_vectors, queries, 9, metric, p).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((round(r.score, 9), r.id))
    for qid, vec in asked:
        assert [s for s, _ in got.get(qid, [])] == pytest.approx([s for s, _ in nearest(rows, vec, 9, metric, p)])
    # Far from ties the ids are the same too.
    assert sum(got.get(q) == nearest(rows, v, 9, metric, p) for q, v in asked if got.get(q)) > 0.6 * len(got)


def test_knn_join_sends_few_copies_at_a_time(spark, monkeypatch):
    """Queries are dealt, and sent to their cells, in parts; the answer is the same."""
    rows = [(i, [float((i * 7 + j * 13) % 31) for j in range(4)]) for i in range(300)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>").coalesce(1)
    queries = df.selectExpr("id AS qid", "vec AS qvec")
    whole = sorted(pivots.knn_join(df, queries, 4, "l2").collect())
    monkeypatch.setattr(pivots, "DEAL_ROWS", 7)
    monkeypatch.setattr(pivots, "SENT_CELLS", 9)
    assert sorted(pivots.knn_join(df, queries, 4, "l2").collect()) == whole and len(whole) == 300 * 4 + 1


@pytest.mark.parametrize("cells", [1 << 23, 150])
def test_knn_join_writes_a_query_once(spark, monkeypatch, cells):
    """Where every query meets nearly every cell, its vector isn't written for each of them."""
    for name, value in (("CELL_ROWS", 20), ("QUERY_ROWS", 20), ("LANE_CELLS", cells), ("BAND_CELLS", cells)):
        monkeypatch.setattr(pivots, name, value, raising=False)
    x = np.random.default_rng(6).normal(size=(500, 12)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(4)
    written = []
    join = pivots.durable
    monkeypatch.setattr(pivots, "durable", lambda t: written.append(join(t)) or written[-1])
    found = pivots.knn_join(df, df.selectExpr("id AS qid", "vec AS qvec"), 3, "l2").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert {(r.qid, r["rank"]): r.id for r in found} == {(q, i + 1): near[q, i] for q in range(500) for i in range(3)}
    assert written[0].select("cell").distinct().count() > 4
    assert [t.count() for t in written] == [500, 500]


def test_knn_join_skips_cells(spark, monkeypatch):
    """Rows in clusters far apart: a query meets the cells of its own."""
    monkeypatch.setattr(pivots, "CELL_ROWS", 100)
    df = spark.range(2000).selectExpr("id", "array(double(id % 10 * 1000 + id % 7), double(id % 3)) AS vec")
    asked = []
    join = pivots.durable
    monkeypatch.setattr(pivots, "durable", lambda x: asked.append(join(x)) or asked[-1])
    found = pivots.knn_join(df, df.selectExpr("id AS qid", "vec AS qvec"), 3, "l2")
    assert found.count() == 6000
    cells = asked[0].select("cell").distinct().count()
    assert cells >= 10 and asked[1].count() <= 0.5 * 2000 * cells


@pytest.mark.parametrize("metric, p", [("l2", 2), ("cosine", 2), ("minkowski", 1), ("minkowski", 3)])
def test_index_against_scan(spark, odd_vectors, metric, p):
    index = pivots.build_index(odd_vectors, scratch_path(spark, "index"), metric, p)
    for query, k in (([1.0, 2.0, 0.5, 1.0], 7), ([-5.0] * 4, 250), ([7.0] * 4, 1000), ([1.0, 1.0], 3)):
        got = [(r.id, round(r.score, 9)) for r in index.knn(query, k).collect()]
        want = [(r.id, round(r.score, 9)) for r in S.knn(odd_vectors, query, k, metric, p).collect()]
        if len(query) == 4:
            assert [s for _, s in got] == [s for _, s in want]


def test_index_skips_rows_and_row_groups(spark):
    df = spark.range(4000).selectExpr("id", "array(double(id % 40 * 100), double(id % 13)) AS vec")
    index = pivots.build_index(df, scratch_path(spark, "index"), "l2")
    seen = index.skipped([500.0, 3.0], 10).first()
    assert seen.rows == 4000 and seen.skipped > 3000
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = index.near([500.0, 3.0], 10.0)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(d0" in plan.split("PushedFilters:")[1]


def test_index_needs_a_metric(spark, odd_vectors):
    for metric, p in (("dot", 2.0), ("minkowski", 0.5)):
        with pytest.raises(ValueError):
            pivots.build_index(odd_vectors, "unused", metric, p)


def test_hydrate_keeps_ids_without_text(spark, points):
    texts = spark.createDataFrame([(3, "three")], "id bigint, text string")
    found = S.knn_hydrated(points, texts, [3.0, 1.0, 0.0], 5)
    assert found.count() == 5
    assert {row.id: row.text for row in found.collect()}[3] == "three"


def test_hydrate_every_row(spark, points):
    texts = spark.range(50).selectExpr("id", "CAST(id AS STRING) AS text")
    found = S.knn_hydrated(points, texts, [3.0, 1.0, 0.0], 60).collect()
    assert all((row.text == str(row.id)) if row.id < 50 else row.text is None for row in found)


def test_batch_search_of_text_ids(spark, points):
    named = points.select(F.concat(F.lit("v"), "id").alias("id"), "vec")
    asked = spark.createDataFrame([("a", [3.0, 1.0, 0.0])], "qid string, qvec array<double>")
    found = S.knn_batch(named, asked, 2).collect()
    one = S.knn(named, [3.0, 1.0, 0.0], 2).collect()
    assert sorted((r.id, round(r.score, 9)) for r in found) == sorted((r.id, round(r.score, 9)) for r in one)
    assert {r.qid for r in found} == {"a"}


def test_no_queries(spark, points):
    none = spark.createDataFrame([], "qid bigint, qvec array<double>")
    assert S.knn_batch(points, none, 3).collect() == []


def test_query_vector(points):
    assert S.query_vector(points, 3) == [3.0, 1.0, 0.0]
    for key in (102, 999):
        with pytest.raises(KeyError):
            S.query_vector(points, key)


def test_blank_search_finds_nothing(spark, points):
    def embed(df, column, out):
        return df.withColumn(out, F.array(F.length(column).cast("double"), F.lit(1.0), F.lit(0.0)))

    texts = spark.createDataFrame([(3, "three")], "id bigint, text string")
    assert S.text_search(points, " \n ", embed, 5, attach=[texts]).collect() == []
    assert S.text_search(points, "Abc", embed, 5, attach=[texts]).count() == 5
    assert S.text_search(points, "Abc", embed, 5).columns == ["id", "score"]
