import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.operators import aggregates as A
from codequarry.operators import joins, rows, sampling


def pairs(df):
    return sorted(tuple(row) for row in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share their first order column; some have none."""
    g = F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 50 != 1, F.col("id") % 11)
    return spark.range(3000).select("id", g.alias("g"), F.md5(F.col("id").cast("string")).alias("t"))


def test_row_index_over_a_hot_value(skewed):
    numbered = rows.with_row_index(skewed.repartition(7), ["g", "t"]).select("g", "t", "row")
    found = sorted(numbered.collect(), key=lambda r: r.row)
    assert [r.row for r in found] == list(range(3000))
    keys = [(r.g is not None, r.g or 0, r.t) for r in found]
    assert keys == sorted(keys)


def test_row_index_spreads_the_hot_value(skewed):
    placed = rows._numbered(skewed, ["g", "t"])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert sum(sizes) == 3000 and (len(sizes) == 1 or max(sizes) < 3000 / len(sizes) * 1.5)


@pytest.mark.parametrize("partitions", [1, 2, 40])
def test_cumulative(spark, skewed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = rows.cumulative(skewed, ["id"], "id", "upto").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert [r.upto for r in found] == [i * (i + 1) // 2 for i in range(3000)]


def test_empty_and_single(spark):
    empty = spark.range(0)
    assert rows.with_row_index(empty, ["id"]).collect() == []
    assert rows.with_row_index(spark.range(1), ["id"]).first().row == 0
    assert sampling.sample_n(empty, 5, "id").collect() == []
    assert A.histogram(empty, "id", 3).collect() == []


def test_slices_keep_their_order(skewed):
    every = [row.t for row in rows.head_rows(skewed, ["t"], 3000).collect()]
    assert every == sorted(every) and len(every) == 3000
    assert [row.t for row in rows.slice_rows(skewed, ["t"], 10, 25).collect()] == every[10:25]


def test_dedup_first(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (None, 3), (None, 4)], "k int, id int")
    assert sorted(row.id for row in A.dedup_first(df, ["k"], ["id"]).collect()) == [1, 3]
    texts = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(900)], "id int, t string")
    assert A.dedup_first(texts.repartition(6), ["t"], ["id"]).count() == 301


def test_changed_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", "a"), (2, "a", "b"), (3, None, "b"), (4, None, None)], "id int, a string, b string"
    )
    assert [row.id for row in rows.changed_rows(df, "a", "b").orderBy("id").collect()] == [2, 3]


def test_not_in_is_safe_for_null(spark):
    kept = spark.createDataFrame([(1,), (None,)], "id bigint")
    assert pairs(joins.not_in(spark.range(3), kept, "id")) == [(0,), (2,)]


def test_lookup_join_keeps_all_facts(spark, skewed):
    table = spark.createDataFrame([(5, "five"), (6, "six")], "g bigint, name string")
    facts = skewed.withColumn("g", F.col("g").cast("bigint"))
    found = joins.lookup_join(facts, table, "g").select("id", "g", "name")
    assert found.count() == 3000
    assert found.where("name IS DISTINCT FROM CASE g WHEN 5 THEN 'five' WHEN 6 THEN 'six' END").count() == 0


@pytest.mark.parametrize("n", [1, 10, 999, 3000, 5000])
def test_sample_n_is_exact_and_stable(skewed, n):
    found = pairs(sampling.sample_n(skewed.repartition(1), n, "id").select("id"))
    assert len(set(found)) == min(n, 3000)
    assert found == pairs(sampling.sample_n(skewed.repartition(9), n, "id").select("id"))


def test_sample_n_of_null_and_repeated_keys(spark, skewed):
    odd = spark.range(100).selectExpr("id", "IF(id < 30, NULL, id % 7) AS k")
    for n in (1, 5, 29, 64, 100, 200):
        found = pairs(sampling.sample_n(odd.repartition(3), n, "k"))
        assert len(set(found)) == min(n, 100)
        assert found == pairs(sampling.sample_n(odd.repartition(5), n, "k"))
    assert sampling.sample_n_repl(odd, 70, "k").count() == 70
    train, test = sampling.split(odd, "k")
    assert train.count() + test.count() == 100
    assert sampling.sample_n(skewed, 0, "id").count() == 0


def test_split_is_disjoint_and_complete(skewed):
    train, test = sampling.split(skewed, "id")
    assert train.count() + test.count() == 3000
    assert train.join(test, "id").count() == 0
    assert 0.12 < test.count() / 3000 < 0.18


def test_sample_with_replacement_repeats(spark):
    found = sampling.sample_n_repl(spark.range(10), 200, "id")
    assert found.count() == 200 and found.select("draw").distinct().count() == 200
    assert found.select("id").distinct().count() == 10


def bins(df):
    return [row.n for row in df.orderBy("bin").collect()]


@pytest.mark.parametrize(
    "values, count, out",
    [
        ([0.0, 1.0, 2.0, 2.0, 10.0], 5, [2, 2, 0, 0, 1]),
        ([3.0, 3.0], 2, [0, 2]),
        ([1.0, None, 2.0], 2, [1, 1]),
        ([None, None], 2, []),
    ],
)
def test_histogram(spark, values, count, out):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert bins(A.histogram(df, "x", count)) == out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=60), st.integers(1, 20))
def test_histogram_agrees_with_numpy(spark, values, count):
    import numpy as np

    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = bins(A.histogram(df, "x", count))
    assert sum(found) == len(values) and len(found) == count
    lo, hi = min(values), max(values)
    if hi > lo and all(((v - lo) * count) % (hi - lo) for v in values if v not in (lo, hi)):
        assert found == np.histogram(values, count)[0].tolist()


def test_densities_add_up_to_one(spark):
    a = spark.range(50).selectExpr("CAST(id * id AS DOUBLE) AS x")
    b = spark.range(30).selectExpr("CAST(id AS DOUBLE) AS x")
    found = A.histogram_compare({"a": a, "b": b}, "x", 7)
    area = found.groupBy("label").agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo"))))
    assert [round(row[1], 9) for row in area.collect()] == [1.0, 1.0]


def test_tag_counts_add_up_hyphens(spark):
    df = spark.createDataFrame([("['a-b', 'c']",), ("['a-b']",), ("[' a-b ']",)], "topics string")
    assert pairs(A.tag_counts(df)) == [("a\nb", 3)]
    lists = spark.createDataFrame([(["a"], 3), (["a", "b"], 4)], "topics array<string>, size int")
    assert pairs(A.tag_weights(lists)) == [("a", 7), ("b", 4)]


def test_count_by_drops_null_keys(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (None, "y")], "k int, v string")
    assert pairs(A.count_by(df, "k", "v")) == [("1", 1)]


def test_raster_edges(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1), (1.0, 1.0, 1), (0.5, 0.5, 2), (None, 1.0, 2)], "x double, y double, c int"
    )
    assert pairs(A.raster_counts(df, "x", "y", "c", 4, 2)) == [(0, 0, 1, 1), (2, 1, 2, 1), (3, 1, 1, 1)]
    flat = df.where("x = 0.0")
    assert pairs(A.raster_counts(flat, "x", "y", "c", 4, 2)) == [(0, 0, 1, 1)]


# Two byte strings with one MD5, published in 2004.
COLLIDING = (
    "d131dd02c5e6eec4693d9a0698aff95c2fcab58712467eab4004583eb8fb7f8955ad340609f4b30283e488832571415a085125e8f7cdc99f"
    "d91dbdf280373c5bd8823e3156348f5bae6dacd436c919c6dd53e2b487da03fd02396306d248cda0e99f33420f577ee8ce54b67080a80d1e"
    "c69821bcb6a8839396f9652b6ff72a70",
    "d131dd02c5e6eec4693d9a0698aff95c2fcab50712467eab4004583eb8fb7f8955ad340609f4b30283e4888325f1415a085125e8f7cdc99f"
    "d91dbd7280373c5bd8823e3156348f5bae6dacd436c919c6dd53e23487da03fd02396306d248cda0e99f33420f577ee8ce54b67080280d1e"
    "c69821bcb6a8839396f965ab6ff72a70",
)


def test_texts_of_one_digest_stay_two(spark):
    rows = spark.createDataFrame([(i, COLLIDING[i % 2]) for i in range(40)], "id int, h string").repartition(5)
    texts = rows.select("id", F.unhex("h").cast("string").alias("text"))
    assert texts.select(F.md5("text")).distinct().count() == 1
    kept = A.dedup_first(texts, ["text"], ["id"])
    assert sorted(r.id for r in kept.select("id").collect()) == [0, 1]
    both = A.dedup_first(texts.withColumn("k", F.col("id") % 4), ["k", "text"], ["id"])
    assert sorted(r.id for r in both.select("id").collect()) == [0, 1, 2, 3]


def test_draws_with_replacement_of_equal_rows(spark):
    """Equal rows, NULL keys and maps: every draw is a row, in proportion, the same however rows lie."""
    rows = [(None, {"a": 1})] * 300 + [(7, {"b": 2})] * 100 + [(7, {"c": 3})] * 100
    df = spark.createDataFrame(rows, "k int, m map<string,int>")
    one = sampling.sample_n_repl(df, 2000, "k").collect()
    assert sorted(r.draw for r in one) == list(range(2000))
    shares = [sum(r.k is None for r in one), sum("b" in r.m for r in one), sum("c" in r.m for r in one)]
    assert all(abs(n - want) < 120 for n, want in zip(shares, (1200, 400, 400)))
    other = sampling.sample_n_repl(df.repartition(7), 2000, "k").collect()
    plain = lambda found: sorted((r.draw, r.k is None, str(r.m)) for r in found)
    assert plain(one) == plain(other)
    assert sampling.sample_n_repl(df.limit(0), 5, "k").collect() == []


@pytest.mark.parametrize("bins", [1, 7, 100])
def test_histograms_of_one_scan(spark, bins):
    """Counts are exact for every kind of numbers, whole or not, near zero or far, by group or not."""
    rng = np.random.default_rng(bins)
    sets = {
        "normal": rng.normal(size=900), "whole": rng.integers(-40, 4000, 900).astype(float),
        "wide": rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), "one": np.full(5, 3.5),
        "near": 1e9 + rng.random(900) * 1e-3, "tiny": np.array([5e-324, 0.0, -5e-324, 1e-310]), None: np.array([1.0, 2.0, 2.0]),
    }
    rows = [(name, float(x)) for name, values in sets.items() for x in values] + [("one", None), ("empty", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)

    def plain(values):
        lo, hi = values.min(), values.max()
        lo, width = (lo - 0.5, 1.0 / bins) if lo == hi else (lo, (hi - lo) / bins)
        at = np.minimum(np.floor((values - lo) / width).astype(int) + 1, bins)
        return np.bincount(at, minlength=bins + 1)[1:].tolist()

    found = {}
    for r in A.histogram_by(df, "g", "x", bins).collect():
        found.setdefault(r.g, {})[r.bin] = r.n
    assert found.keys() == sets.keys()
    for name, values in sets.items():
        assert [found[name][b] for b in range(1, bins + 1)] == plain(values), name
        own = df.where(F.col("g").eqNullSafe(F.lit(name)))
        assert [r.n for r in A.histogram(own, "x", bins).orderBy("bin").collect()] == plain(values), name
    assert A.histogram(df.limit(0), "x", bins).count() == 0
