import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from codequarry import session
from codequarry.operators import clustering as C
from codequarry.operators import impacts, lloyd, moments, sketch_svd
from codequarry.operators import reduction as R
from codequarry.operators import silhouettes
from codequarry.operators import tfidf as M
from codequarry.operators.scoring import score_batches
from codequarry.session import scratch_path


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0, 0, 5], [9, 0, 0, 0, 5], [0, 9, 0, 0, 5]])
    x = centres[np.arange(240) % 3] + rng.normal(size=(240, 5)) * [1.0, 0.8, 0.5, 0.2, 0.1]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(4).cache(), x


def matrix(df, column="vec"):
    return np.array([row[column] for row in df.orderBy("id").collect()])


def test_pca(cloud):
    df, x = cloud
    model = R.fit_pca(df, 3)
    scores = matrix(model.transform(df))
    assert np.allclose(scores.mean(axis=0), 0)
    cov = np.cov(scores.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-9)
    spectrum = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(model.ratios, spectrum[:3] / spectrum.sum())
    assert all(c[np.abs(c).argmax()] > 0 for c in model.components.T)
    sampled = R.fit_pca(df, 2, frac=0.5)
    assert len(sampled.ratios) == 2 and sampled.mean.shape == (5,)


def test_pca_of_a_ragged_row_is_null(spark, cloud):
    df, _ = cloud
    odd = spark.createDataFrame([(1, [1.0]), (2, None), (3, [0.0] * 5)], "id bigint, vec array<double>")
    found = R.fit_pca(df, 2).transform(odd).orderBy("id").collect()
    assert [row.vec is None for row in found] == [True, True, False]


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_incremental_pca(spark, cloud, far):
    """Parts stored, extended and merged in any order equal the whole, also far from the origin."""
    df, x = cloud
    df, x = df.withColumn("vec", F.transform("vec", lambda v: v + far)), x + far
    path = scratch_path(spark, "moments")
    moments.moments(df.where("id < 30")).write(spark, path)
    state = moments.Moments.read(spark, path).extend(df.where("id >= 30 AND id < 100"))
    other = moments.nothing().extend(df.where("id >= 100"))
    for both in (state.merge(other), other.merge(state), moments.moments(df)):
        assert both.n == 240 and np.allclose(both.mean, x.mean(axis=0), rtol=1e-12)
        assert np.allclose(both.covariance(), np.cov(x.T), atol=1e-9 * max(1.0, far))
    if not far:
        whole, model = R.fit_pca(df, 3), state.merge(other).model(3)
        assert np.allclose(model.ratios, whole.ratios, atol=1e-9)
        assert np.allclose(model.components, whole.components, atol=1e-9)
        assert np.allclose(matrix(model.transform(df)), matrix(whole.transform(df)), atol=1e-9)


def test_moments_of_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, None), (3, [3.0]), (4, [5.0, None]), (5, [3.0, 6.0]), (6, [])], "id int, vec array<double>"
    )
    state = moments.moments(odd)
    assert state.n == 2 and state.mean.tolist() == [2.0, 4.0]
    assert state.extend(odd.limit(0)).n == 2 and moments.moments(odd.limit(0)).n == 0
    path = scratch_path(spark, "moments")
    moments.nothing().write(spark, path)
    assert moments.Moments.read(spark, path).n == 0
    with pytest.raises(ValueError):
        state.merge(moments.moments(odd.where("id = 3")))


def test_variance_table(spark):
    rows = R.variance_table(spark, [0.5, 0.3, 0.1]).orderBy("component").collect()
    assert [round(r.cumulative, 9) for r in rows] == [0.5, 0.8, 0.9]


def test_covariance(cloud):
    df, x = cloud
    found = {(r.i, r.j): r.cov for r in R.covariance(df).collect()}
    expected = np.cov(x.T)
    assert len(found) == 25
    assert all(np.isclose(found[i, j], expected[i, j]) for i, j in found)


@pytest.mark.parametrize("solver", ["gram", "steps"])
def test_svd(cloud, solver):
    df, x = cloud
    rows = df.select("id", array_to_vector("vec").alias("features"))
    model, scored = R.fit_svd(rows, 3, solver=solver)
    assert np.allclose(model.singular_values, np.linalg.svd(x, compute_uv=False)[:3])
    assert np.allclose(model.components.T @ model.components, np.eye(3), atol=1e-9)
    scores = matrix(scored)
    assert np.allclose(scores, x @ model.components)
    assert np.allclose(model.ratios, scores.var(axis=0) / x.var(axis=0).sum())


def test_svd_of_sparse_rows(spark):
    texts = [(i, f"alpha beta{i % 4} gamma{i % 3}" if i else "") for i in range(30)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    features = M.fit_hashed_tfidf(df, "text", 64).transform(df, "text")
    x = np.array([row.features.toArray() for row in features.orderBy("id").collect()])
    model, scored = R.fit_svd(features.select("id", "features"), 4)
    assert np.allclose(matrix(scored), x @ model.components)


@pytest.mark.parametrize("cells", [1, 50])
def test_sparse_products_in_parts(spark, monkeypatch, cells):
    """Products hold few numbers at a time; empty rows, and rows longer than that, are whole."""
    monkeypatch.setattr(R, "GATHER_CELLS", cells)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((60, 30)) < 0.3, rng.normal(size=(60, 30)), 0.0)
    x[0], x[17], x[59] = 0.0, 0.0, 0.0
    v = rng.normal(size=(30, 4))
    scored = sparse_rows(spark, x).withColumn("vec", R.project_sparse(F.col("features"), v)).drop("features")
    assert np.allclose(matrix(scored), x @ v)


def test_steps_keep_components_in_a_table(spark):
    """The driver gets no component of a wide matrix, and other columns stay with their rows."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((50, 400)) < 0.05, rng.normal(size=(50, 400)), 0.0)
    x[3] = 0.0
    df = sparse_rows(spark, x).withColumn("a b", F.col("id") * 2)
    model, scored = R.fit_svd(df, 5, solver="steps")
    assert "components" not in vars(model) and scored.columns == ["id", "a b", "vec"]
    assert all(r["a b"] == 2 * r.id for r in scored.collect())
    assert model.table.count() == 400
    assert np.allclose(model.singular_values, np.linalg.svd(x, compute_uv=False)[:5], rtol=1e-8)
    assert np.allclose(matrix(scored.select("id", "vec")), x @ model.components, atol=1e-9)


@pytest.mark.parametrize("cells", [1 << 23, 64 * 15])
def test_steps_leave_little_on_disk(spark, monkeypatch, tmp_path, cells):
    """Files do not add up with the steps, in one part of columns or in many."""
    for name, value in (("PART_CELLS", cells), ("BLOCK_ROWS", 30), ("TOLERANCE", 0.0)):
        monkeypatch.setattr(sketch_svd, name, value, raising=False)
    rng = np.random.default_rng(9)
    x = np.where(rng.random((200, 300)) < 0.1, rng.normal(size=(200, 300)), 0.0)
    x[5], x[:, 2] = 0.0, 0.0
    df = session.durable(sparse_rows(spark, x))
    sizes = []
    for most in (3, 9):
        monkeypatch.setattr(sketch_svd, "MOST_STEPS", most)
        monkeypatch.setattr(session, "checkpoint_dir", lambda _, most=most: str(tmp_path / str(most)))
        spark.sparkContext.setCheckpointDir(str(tmp_path / str(most)))
        model, scored = sketch_svd.fit_svd_steps(df, 5)
        assert [len(r.vec) for r in scored.collect()] == [5] * 200
        sizes.append(sum(f.stat().st_size for f in (tmp_path / str(most)).rglob("*") if f.is_file()))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert sizes[1] < 1.2 * sizes[0]
    v = np.array([r.vec for r in model.components.orderBy("column").collect()])
    assert v.shape == (300, 5) and np.allclose(v.T @ v, np.eye(5), atol=1e-9)
    assert np.allclose(matrix(scored), x @ v, atol=1e-9) and all(c[np.abs(c).argmax()] > 0 for c in v.T)
    assert np.allclose(model.ratios, matrix(scored).var(axis=0) / x.var(axis=0).sum())


def test_steps_of_nothing(spark):
    empty = sparse_rows(spark, np.zeros((3, 5)))
    for rows in (empty, empty.limit(0)):
        model, scored = sketch_svd.fit_svd_steps(rows, 2)
        assert len(model.singular_values) == 0 and [r.vec for r in scored.collect()] == [[]] * rows.count()
        assert model.components.count() == (5 if rows.count() else 0)


def sparse_rows(spark, x):
    rows = [(i, Vectors.sparse(len(r), [(j, float(v)) for j, v in enumerate(r) if v])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(3)


@pytest.mark.parametrize(("k", "power"), [(4, 5), (40, 0)])
def test_sketch_svd(spark, monkeypatch, k, power):
    """Tiles, bands and triangles of any size; a fast falling spectrum, or the whole of one."""
    for name, value in (("BLOCK_ROWS", 30), ("COLUMN_CELLS", 64 * 14), ("BAND_BLOCKS", 2), ("FAN", 1)):
        monkeypatch.setattr(sketch_svd, name, value)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((200, 150)) < 0.1, rng.normal(size=(200, 150)), 0.0)
    if k < 40:
        x = x @ np.diag(0.5 ** np.arange(150))  # sparse still
    else:
        x[:, 40:] = 0.0
    x[7], x[:, 3] = 0.0, 0.0
    model, scored = sketch_svd.fit_svd_sketch(sparse_rows(spark, x), k, power=power)
    rank = len(model.singular_values)
    assert rank == min(k, 39)
    assert np.allclose(model.singular_values, np.linalg.svd(x, compute_uv=False)[:rank], rtol=1e-6)
    v = np.array([r.vec for r in model.components.orderBy("column").collect()])
    assert v.shape == (150, rank) and np.allclose(v.T @ v, np.eye(rank), atol=1e-9)
    scores = matrix(scored)
    assert scores.shape == (200, rank) and np.allclose(scores, x @ v, atol=1e-4)
    assert np.allclose(model.ratios, scores.var(axis=0) / x.var(axis=0).sum(), atol=1e-6)
    assert all(c[np.abs(c).argmax()] > 0 for c in v.T)


def test_sketch_svd_of_text_vectors(spark):
    texts = [(i, f"alpha beta{i % 4} gamma{i % 3} delta{i % 7}" if i else "") for i in range(60)]
    features, _ = M.tfidf_vectors(spark.createDataFrame(texts, "id bigint, text string"))
    x = np.array([row.features.toArray() for row in features.orderBy("id").collect()])
    model, scored = sketch_svd.fit_svd_sketch(features, 500)
    full = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.singular_values, full[full > 1e-9])
    assert np.allclose((matrix(scored) ** 2).sum(axis=0), model.singular_values**2)


def test_sketch_svd_of_nothing(spark):
    empty = sparse_rows(spark, np.zeros((3, 5)))
    model, scored = sketch_svd.fit_svd_sketch(empty, 2)
    assert len(model.singular_values) == 0 and scored.count() == 3
    model, scored = sketch_svd.fit_svd_sketch(empty.limit(0), 2)
    assert len(model.singular_values) == 0 and scored.count() == 0


@pytest.mark.parametrize("postings", [1 << 27, 5000])
def test_impacts_leave_their_tables_alone(spark, monkeypatch, tmp_path, postings):
    """Of all that is written on the way the index stays; equal texts have equal scores, and the lowest ids win."""
    monkeypatch.setattr(impacts, "SLICE_POSTINGS", postings, raising=False)
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    rng = np.random.default_rng(12)
    same = " ".join(f"w{int(v)}" for v in rng.integers(0, 5000, 300))
    texts = [(i, same if i % 3 else f"{same} x{i}") for i in range(90)]
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(7)
    index = impacts.build_impacts(df, str(tmp_path / "index"))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["index"]
    assert index.rows.count() == 90 and index.rows.select(F.sum(F.size("columns"))).first()[0] == index.postings.select(
        F.sum(F.size("ids"))
    ).first()[0]
    assert [r.id for r in index.search(same, 20).collect()] == [i for i in range(90) if i % 3][:20]


def test_impacts_against_every_cosine(spark, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK_POSTINGS", 8)
    rng = np.random.default_rng(3)
    words = [f"w{int(v)}" for v in np.minimum(rng.pareto(0.8, 6000), 300)]
    texts = [(i, " ".join(words[i * 15 : i * 15 + int(rng.integers(1, 15))])) for i in range(400)]
    texts += [(400, ""), (401, None), (402, "? !"), (403, texts[5][1]), (404, texts[5][1])]
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(5)
    index = impacts.build_impacts(df, scratch_path(spark, "impacts"))
    weights = {}
    for r in M.tfidf(df).collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    for text, k in (("w1 w2 w50", 5), ("w0 w0 w3", 10), ("w7", 500), (texts[5][1], 3), ("w1 unheard", 4)):
        query = index.weigh(text)
        assert sum(w * w for w in query.values()) == pytest.approx(1.0)
        scores = {i: sum(query.get(t, 0) * w for t, w in own.items()) for i, own in weights.items()}
        want = sorted((-round(s, 9), i) for i, s in scores.items() if s > 0)[:k]
        assert [(-round(r.score, 9), r.id) for r in index.search(text, k).collect()] == want
    assert index.search("unheard", 5).collect() == [] and index.search("", 5).collect() == []
    seen = index.skipped("w0 w150", 3).first()
    assert 0 < seen.skipped < seen.blocks


def test_blocks_of_postings():
    """Blocks are cut in batches, not one by one, and are the same however the postings come."""
    rng = np.random.default_rng(5)
    columns = np.sort(np.minimum(rng.pareto(0.5, 300).astype(np.int64), 60))
    weights, ids = rng.random(300), [None if i % 7 == 0 else f"t{i}" for i in range(300)]
    rows = pa.record_batch(
        [pa.array((columns << 32) + rng.integers(0, 1 << 32, 300)), pa.array(weights), pa.array(ids)],
        names=["place", "weight", "id"],
    )
    want = []
    for column in np.unique(columns).tolist():
        own = np.flatnonzero(columns == column).tolist()
        for block in (own[i : i + 4] for i in range(0, len(own), 4)):
            held = [weights[i] for i in block]
            want.append((column, max(held), [ids[i] for i in block], held))
    for size in (1, 5, 64, 300):
        parts = [rows.slice(i, size) for i in range(0, 300, size)] + [rows.slice(0, 0)]
        found = list(impacts.posting_blocks(iter(parts), 4))
        assert [tuple(r.values()) for b in found for r in b.to_pylist()] == want
        assert len(found) <= len(parts)


@pytest.mark.parametrize("common", [0, 2, 1 << 16])
def test_tfidf_of_common_and_rare_terms(spark, monkeypatch, common):
    """Common terms stay with their texts, rare ones move: the same weights, and columns in the order of the terms."""
    monkeypatch.setattr(M, "COMMON_TERMS", common)
    long = "x" * (M.COMMON_LENGTH + 1)
    texts = [(1, f"the cat the {long}"), (2, "the dog"), (2, f"a bird {long}"), (None, "the cat"), (3, ""), (4, None)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    tf = {}
    for at, text in texts:
        for word in (w for w in (text or "").split() if len(w) > 1):
            tf.setdefault(at, {}).setdefault((text, word), 0)
            tf[at][text, word] += 1
    terms = sorted({word for own in tf.values() for _, word in own})
    found = [word for own in tf.values() for _, word in own]
    idf = {t: np.log((1 + len(texts)) / (1 + found.count(t))) + 1 for t in terms}
    want = {}
    for at, own in tf.items():
        raw = sorted((word, n * idf[word]) for (_, word), n in own.items())
        size = sum(x * x for _, x in raw) ** 0.5
        want[at] = [(word, pytest.approx(x / size)) for word, x in raw]
    long_form = {}
    for r in M.tfidf(df).orderBy("term").collect():
        long_form.setdefault(r.id, []).append((r.term, r.weight))
    assert long_form == want
    vectors, vocabulary = M.tfidf_vectors(df)
    assert [(r.term, r.column) for r in vocabulary.orderBy("column").collect()] == [(t, i) for i, t in enumerate(terms)]
    seen = [(r.id, [(terms[i], x) for i, x in zip(r.features.indices, r.features.values)]) for r in vectors.collect()]
    assert sorted(seen, key=str) == sorted(((at, want.get(at, []) if at else []) for at, _ in texts), key=str)


def test_common_terms_stay_with_their_texts(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog")], "id bigint, text string")
    plan = M.tfidf(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "shard" not in plan


def test_tfidf_weights(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc I"), (3, "?")], "id bigint, text string")
    two = df.where("id < 3")
    found = {(r.id, r.term): round(r.weight, 6) for r in M.tfidf(two).collect()}
    assert found == {
        (1, "aa"): 0.942156,
        (1, "bb"): 0.335176,
        (2, "bb"): 0.579739,
        (2, "cc"): 0.814802,
    }
    assert {r.id for r in M.tfidf(df).collect()} == {1, 2}


def test_tfidf_with_hot_terms(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "concat('the the word', id % 40, ' x', id) AS text")
    plain = {(r.id, r.term): r.weight for r in M.tfidf(df).collect()}
    monkeypatch.setattr(M, "SHARD_POSTINGS", 100)  # 'the' is in three hundred
    salted = {(r.id, r.term): r.weight for r in M.tfidf(df.repartition(5)).collect()}
    assert plain.keys() == salted.keys()
    assert all(abs(plain[k] - salted[k]) < 1e-12 for k in plain)


def test_hashed_weights_equal_long_form(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc I")], "id bigint, text string")
    model = M.fit_hashed_tfidf(df, "text", 1 << 14)
    vectors = M.hash_embed(model, df).collect()
    got = {row.id: sorted(round(x, 5) for x in row.vec if x) for row in vectors}
    assert got == {1: [0.33518, 0.94216], 2: [0.57974, 0.8148]}


def test_kmeans_restarts_never_cost_more(cloud):
    df, x = cloud
    one = C.kmeans(df, 3, n_init=1, seed=7)
    five = C.kmeans(df, 3, n_init=5, seed=7)
    assert five.cost == min(five.costs) <= one.cost and five.costs[0] == pytest.approx(one.cost)
    labels = {r.id: r.cluster for r in five.labels.collect()}
    assert len(labels) == 240
    assert len({(i % 3, labels[i]) for i in range(240)}) == 3


def test_cluster_profile(spark, cloud):
    df, x = cloud
    labelled = df.withColumn("cluster", (F.col("id") % 3).cast("int"))
    profile = {r.cluster: r for r in C.cluster_profile(labelled).collect()}
    for c in range(3):
        assert profile[c].n == 80 and np.allclose(profile[c].vec, x[c::3].mean(axis=0))
    sparse = labelled.withColumn("cluster", F.when(F.col("id") > 2, F.lit("b")))
    assert [(r.cluster, r.n) for r in C.cluster_profile(sparse).collect()] == [("b", 237)]


@pytest.mark.parametrize("cells", [1 << 20, 2])
def test_assign_breaks_ties_by_id(spark, monkeypatch, cells):
    monkeypatch.setattr(C, "CENTRE_BLOCK_CELLS", cells)  # 2: a block per centre
    centres = spark.createDataFrame(
        [(9, [0.0, 0.0]), (4, [2.0, 0.0]), (7, [2.0, 0.0]), (5, [5.0, 5.0])],
        "cluster int, vec array<double>",
    )
    points = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [9.0, 9.0]), (4, None)], "id bigint, vec array<double>"
    )
    found = {r.id: (r.cluster, r.distance) for r in C.assign(points, centres).collect()}
    assert found[1] == (4, 1.0) and found[2][0] == 4 and found[3][0] == 5
    assert found[4] == (None, None)


def brute_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize(("rows", "lane"), [(512, 16), (7, 2), (100, 1)])
def test_silhouette(spark, cloud, rows, lane, monkeypatch):
    monkeypatch.setattr(silhouettes, "BLOCK_ROWS", rows)
    monkeypatch.setattr(silhouettes, "LANE_BLOCKS", lane)
    df, x = cloud
    labels = np.arange(240) % 3
    labels[5] = 8  # a cluster of one
    cluster = F.when(F.col("id") == 5, 8).otherwise(F.col("id") % 3)
    labelled = df.withColumn("cluster", cluster)
    found = C.silhouette_samples(labelled)
    scores = {r.id: r.silhouette for r in found.collect()}
    assert len(scores) == 240 and scores[5] == 0.0
    assert np.allclose([scores[i] for i in range(240)], brute_silhouette(x, labels))
    mean = C.silhouette(labelled, None).first()[0]
    assert mean == pytest.approx(np.mean(list(scores.values())))


def plain_lloyd(x, centres, max_iter, tolerance):
    for _ in range(max_iter):
        label = np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(axis=1)
        fresh = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        moved = ((fresh - centres) ** 2).sum()
        centres = fresh
        if moved <= tolerance:
            break
    return centres, (np.linalg.norm(x[:, None] - centres[None], axis=2).min(axis=1) ** 2).sum()


@pytest.mark.parametrize(("slab", "cells", "fan"), [(1 << 20, 1 << 22, 8), (35, 1 << 22, 1), (200, 20, 8)])
def test_lloyd_against_numpy(spark, cloud, monkeypatch, slab, cells, fan):
    """The same starts give the same centres and costs, whatever the slabs, the groups and the way sums go."""
    for name, value in (("SLAB_CELLS", slab), ("CENTRE_CELLS", cells), ("FAN", fan), ("CUT_EVERY", 3)):
        monkeypatch.setattr(lloyd, name, value)
    df, x = cloud
    rng = np.random.default_rng(4)
    begin = [x[rng.permutation(240)[:k]] for k in (1, 2, 7, 7, 40)]
    begin.append(np.vstack([x[:3], x[:1], [[900.0] * 5]]))  # two alike, and one that no row is near
    fits = lloyd.fit_all(df, begin, 60, 1e-12)
    assert max(fit.passes for fit in fits) > 4
    for start, fit in zip(begin, fits):
        centres, cost = plain_lloyd(x, start, 60, 1e-12)
        assert np.allclose(fit.centres, centres) and fit.cost == pytest.approx(cost)


def test_bounds_skip_most_distances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4)) + np.repeat(np.eye(4) * 40, 750, axis=0)
    centres, own, measured = x[[0, 800, 1600, 2400]], lloyd._Bounds(3000, None), []
    move = np.zeros(4)
    for _ in range(6):
        gaps = lloyd._gaps(centres, centres) + np.diag([np.inf] * 4)
        own.measured = 0
        own.update(x, move, centres, gaps.min(axis=1) / 2)
        measured.append(own.measured)
        label = own.state[0].astype(int)
        assert (label == lloyd._gaps(x, centres).argmin(axis=1)).all()
        fresh = np.array([x[label == c].mean(axis=0) for c in range(4)])
        move, centres = np.sqrt(((fresh - centres) ** 2).sum(axis=1)), fresh
    assert measured[0] == 3000 and sum(measured[1:]) < 300


def test_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [5.0, 5.0])], "id bigint, vec array<double>")
    fit = C.kmeans(df, 10, n_init=2)
    assert fit.centres.count() == 3 and fit.cost == 0.0 and fit.labels.count() == 3
    empty = C.kmeans(df.limit(0), 4, n_init=2)
    assert empty.labels.count() == 0 and empty.centres.count() == 0


def test_rejected_rows_are_counted(spark, cloud):
    df, _ = cloud
    odd = spark.createDataFrame(
        [(900, [1.0]), (901, None), (902, []), (903, [1.0, None, 2.0, 3.0, 4.0])], "id bigint, vec array<double>"
    )
    fit = C.kmeans(df.select("id", "vec").union(odd), 3, n_init=1)
    assert {tuple(r) for r in fit.rejected.collect()} == {("another width", 2), ("no vector", 1), ("gap", 1)}


def test_lanes_meet_once(spark):
    """Every two lanes have one task, whichever side a pair is seen from; ids are sent to one of them."""
    blocks = spark.range(40).selectExpr("id AS block", "1 AS rows", "array(id) AS ids", "array(id) AS labels", "X'00' AS x")
    here, there = silhouettes._meetings(blocks, 4)
    met = here.drop("labels").join(there.select("here", "there", F.col("block").alias("other")), ["here", "there"]).collect()
    lanes = {r.block: r.here for r in met if r.here == r.there}
    pairs = sorted((r.block, r.other) for r in met)
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((i, j)) for i in range(40) for j in range(40)}
    assert all(lanes[i] <= lanes[j] for i, j in pairs) and all((r.ids is not None) == (r.here == r.there) for r in met)


def test_sweep_of_repeated_and_null_ids(spark, cloud):
    """Scores and costs of a numpy sweep from the same starts; ids do not matter."""
    df, x = cloud
    ks, seeds = (2, 3, 4), 2
    for ids in (F.col("id") % 20, F.when(F.col("id") % 2 > 0, F.col("id")), F.lit(None).cast("bigint")):
        rows = df.select(ids.alias("id"), "vec").cache()
        found = {r.k: r for r in C.sweep(rows, ks=ks, n_init=seeds).collect()}
        every = [(k, 42 + i) for k in ks for i in range(seeds)]
        begin = lloyd.starts(rows, [k for k, _ in every], [s for _, s in every], "id", "vec")
        tolerance = C.TOLERANCE * x.var(axis=0, ddof=1).mean()
        for i, k in enumerate(ks):
            runs = [plain_lloyd(x, begin[i * seeds + j], 300, tolerance) for j in range(seeds)]
            centres, cost = min(runs, key=lambda run: run[1])
            label = np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(axis=1)
            assert found[k].cost == pytest.approx(cost)
            assert found[k].score == pytest.approx(brute_silhouette(x, label).mean())


def test_sweep_chooses_the_true_number(cloud):
    df, _ = cloud
    scores = C.sweep(df, ks=(2, 3, 5), sample_n=150, silhouette_n=100, n_init=3)
    assert C.choose_k(scores) == 3
    _, fit, score = C.best_clustering(df, ks=(2, 3), n_init=2)
    assert score == pytest.approx(C.silhouette(fit.labelled).first()[0])
    assert C.silhouette_squared(df.withColumn("cluster", (F.col("id") % 3).cast("int"))) > 0.5


def test_odd_vectors_end_no_fit(spark, cloud):
    df, _ = cloud
    odd = spark.createDataFrame([(900, [1.0]), (901, None), (902, [])], "id bigint, vec array<double>")
    fit = C.kmeans(df.select("id", "vec").union(odd), 3, n_init=1)
    assert fit.labels.count() == 240
    labelled = df.select("id", "vec").union(odd).withColumn("cluster", F.col("id") % 3)
    assert C.silhouette_samples(labelled).count() == 240


def test_score_batches_keeps_ids(spark):
    def factory():
        sizes = []

        def model(batch):
            sizes.append(len(batch))
            return [(len(text), max(sizes)) for text in batch]

        return model

    df = spark.range(100).selectExpr("id", "repeat('x', CAST(id AS INT)) AS t", "id AS u").repartition(3)
    found = score_batches(df, factory, "t", "out struct<size: int, batch: int>", 16, ("id", "u"))
    rows = found.select("id", "u", "out.*").collect()
    assert len(rows) == 100
    assert all(r.id == r.u == r.size and r.batch <= 16 for r in rows)
