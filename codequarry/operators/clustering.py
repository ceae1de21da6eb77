"""KMeans with restarts, assignment, profiles, silhouette, choice of k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.vectors import lengths, matrix
from codequarry.operators import lloyd
from codequarry.operators.rows import argmax_row
from codequarry.operators.sampling import sample_n as take_sample
from codequarry.operators.silhouettes import labelled_silhouettes
from codequarry.session import durable

# Clusters and restarts of the main fit, its iteration limit,
# the centre movement, relative to the variance, at which a fit is done,
# restarts where none are stated, and the cluster numbers that are tried.
CLUSTERS = 150
RESTARTS = 5
MAX_ITER = 300
TOLERANCE = 1e-4
SWEEP_RESTARTS = 10
SWEEP_KS = (*range(10, 150, 10), *range(150, 300, 10))
FINE_SWEEP_KS = tuple(range(75, 120, 5))

# Numbers in a block of centres, as sent to executors.
CENTRE_BLOCK_CELLS = 1 << 20


@dataclass
class KMeansResult:
    labelled: DataFrame  # the input with its cluster
    labels: DataFrame  # (id, cluster)
    centres: DataFrame  # (cluster, vec)
    cost: float
    costs: list[float]  # one per restart
    rejected: DataFrame  # (reason, n): rows that took no part


def kmeans(
    df: DataFrame,
    k: int = CLUSTERS,
    n_init: int = RESTARTS,
    seed: int = 42,
    max_iter: int = MAX_ITER,
    id_col: str = "id",
    vec: str = "vec",
) -> KMeansResult:
    """Best of ``n_init`` fits from random starts, by the summed squared distance.

    All fits share every pass over the rows (see ``lloyd``), and starts depend
    on the seed only. A fit ends when the centres together move less than a
    share of the data's variance. Vectors of another than the usual width, or
    with gaps, are left out, and counted in ``rejected``. With fewer rows than
    ``k`` every row is a centre.
    """
    points = usual_width(df, vec)
    begin = lloyd.starts(points, [k] * n_init, range(seed, seed + n_init), id_col, vec)
    fits = lloyd.fit_all(points, begin, max_iter, TOLERANCE * _mean_variance(points, vec), vec)
    best = min(fits, key=lambda fit: fit.cost)
    labelled = points.withColumn("cluster", F.get(_labels(F.col(vec), [best.centres]), F.lit(0)).cast("int"))
    centres = df.sparkSession.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(best.centres)], "cluster int, vec array<double>"
    )
    costs = [fit.cost for fit in fits]
    return KMeansResult(
        labelled, labelled.select(id_col, "cluster"), centres, best.cost, costs, width_rejects(df, vec)
    )


def _mean_variance(points: DataFrame, vec: str) -> float:
    if points.isEmpty():
        return 0.0
    return float(points.select(Summarizer.variance(array_to_vector(vec))).first()[0].toArray().mean())


def _labels(vec: Column, ways: list[np.ndarray]) -> Column:
    """The nearest of each set of centres, the lowest number among equals: one pass over the rows."""
    blocks: list[list[np.ndarray]] = [[]]
    for centres in ways:
        if blocks[-1] and sum(c.size for c in blocks[-1]) + centres.size > CENTRE_BLOCK_CELLS:
            blocks.append([])
        blocks[-1].append(centres)

    def of(block: list[np.ndarray]) -> Column:
        @F.arrow_udf("array<bigint>")
        def nearest(vectors: pa.Array) -> pa.Array:
            x = matrix(vectors, block[0].shape[1])
            found = [_nearest(np.arange(len(c)), c, x)[1] for c in block]
            ends = pa.array(np.arange(len(x) + 1) * len(block), pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(np.stack(found, axis=1).ravel(), pa.int64()))

        return nearest(vec)

    parts = [of(block) for block in blocks]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def usual_width(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows whose vector has the width that most have (the least of equals) and no gaps."""
    widths = df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("width")).count()
    width = widths.orderBy(F.desc("count"), "width").limit(1).select("width").scalar()
    return df.where((F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull()))


def width_rejects(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(reason, n): the rows that :func:`usual_width` leaves out."""
    widths = df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("width")).count()
    width = widths.orderBy(F.desc("count"), "width").limit(1).select("width").scalar()
    reason = (
        F.when(F.col(vec).isNull(), "no vector")
        .when(F.size(vec) != width, "another width")
        .when(F.exists(vec, lambda x: x.isNull()), "gap")
    )
    return df.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def cluster_profile(df: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """(cluster, n, vec): size and centre of every cluster.

    Each Arrow batch is summed per cluster before anything moves, so the
    shuffle carries one vector per batch and cluster, however large a cluster.
    """
    kind = df.schema[cluster].dataType.simpleString()

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            sizes = lengths(batch.column(1))
            for width in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == width)
                rows = rows[np.argsort(codes[rows], kind="stable")]
                found, starts = np.unique(codes[rows], return_index=True)
                block = matrix(batch.column(1).take(pa.array(rows)), width)
                sums = np.add.reduceat(block, starts, axis=0)
                ends = pa.array(np.arange(len(found) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        coded.dictionary.take(pa.array(found)),
                        pa.array(np.diff(np.append(starts, len(rows)))),
                        pa.ListArray.from_arrays(ends, pa.array(sums.ravel())),
                    ],
                    [cluster, "n", "total"],
                )

    usable = df.where(F.col(cluster).isNotNull() & F.col(vec).isNotNull()).select(cluster, vec)
    sums = usable.mapInArrow(batch_sums, f"`{cluster}` {kind}, n bigint, total array<double>")
    cells = sums.select(cluster, "n", F.posexplode("total").alias("i", "x"))
    totals = cells.groupBy(cluster, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    parts = F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x"))))
    return totals.groupBy(cluster).agg(
        F.max("n").alias("n"), F.transform(parts, lambda part: part["x"]).alias("vec")
    )


def _nearest(ids: np.ndarray, centres: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, id) of the nearest centre, the lowest id among equals.

    A matrix product ranks the centres; the few rows where it cannot tell two
    apart are measured again by differences.
    """
    squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres)
    rough = squares - 2.0 * (x @ centres.T)
    best = rough.argmin(axis=1)
    slack = 1e-10 * squares.max(axis=1)
    close = rough <= rough[np.arange(len(x)), best][:, None] + slack[:, None]
    for row in np.flatnonzero(close.sum(axis=1) > 1):
        near = np.flatnonzero(close[row])
        gaps = centres[near] - x[row]
        best[row] = near[np.einsum("ij,ij->i", gaps, gaps).argmin()]
    gaps = x - centres[best]
    return np.sqrt(np.einsum("ij,ij->i", gaps, gaps)), ids[best]


def _nearest_of(vec: Column, block: list[tuple[int, list[float]]]) -> Column:
    ids = np.array([cluster for cluster, _ in block], dtype=np.int32)
    centres = np.array([centre for _, centre in block], dtype=np.float64)

    @F.arrow_udf("distance double, cluster int")
    def nearest(vectors: pa.Array) -> pa.Array:
        fits = lengths(vectors) == centres.shape[1]
        rows = np.flatnonzero(fits)
        distance = np.full(len(vectors), np.nan)
        cluster = np.zeros(len(vectors), dtype=np.int32)
        if len(rows):
            block_x = matrix(vectors.take(pa.array(rows)), centres.shape[1])
            distance[rows], cluster[rows] = _nearest(ids, centres, block_x)
        return pa.StructArray.from_arrays(
            [pa.array(distance, mask=~fits), pa.array(cluster, mask=~fits)],
            ["distance", "cluster"],
        )

    return nearest(vec)


def assign(
    df: DataFrame, centres: DataFrame, id_col: str = "id", vec: str = "vec"
) -> DataFrame:
    """(id, cluster, distance) of the nearest given centre; no shuffle.

    ``centres`` is (cluster, vec). It is sent in blocks of a fixed size; more
    centres mean more blocks, and the least of the blocks' answers is the answer.
    """
    blocks: list[list[tuple[int, list[float]]]] = [[]]
    cells = 0
    for row in centres.select("cluster", "vec").orderBy("cluster").toLocalIterator():
        if cells + len(row.vec) > CENTRE_BLOCK_CELLS and blocks[-1]:
            blocks.append([])
            cells = 0
        blocks[-1].append((int(row.cluster), list(row.vec)))
        cells += len(row.vec)
    answers = [_nearest_of(F.col(vec), block) for block in blocks]
    best = answers[0] if len(answers) == 1 else F.least(*answers)
    return df.select(id_col, best.alias("_best")).select(
        id_col, F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance")
    )


def silhouette_samples(
    df: DataFrame, id_col: str = "id", vec: str = "vec", cluster: str = "cluster"
) -> DataFrame:
    """(id, cluster, silhouette) by Euclidean distance, exact over the rows given.

    The work grows with the square of the rows: name a sample, or use
    :func:`silhouette_squared`. A single cluster scores 0. Rows without a
    cluster, and vectors of another than the usual width, have no row.
    """
    points = usual_width(df.where(F.col(cluster).isNotNull()), vec).select(
        F.col(id_col), F.col(vec).alias("vec"), F.array(F.col(cluster).cast("bigint")).alias("labels")
    )
    return labelled_silhouettes(points, id_col).select(
        id_col, F.get("labels", F.lit(0)).alias("cluster"), F.get("scores", F.lit(0)).alias("silhouette")
    )


def silhouette(
    df: DataFrame,
    sample_n: int | None = None,
    seed: int = 42,
    id_col: str = "id",
    vec: str = "vec",
    cluster: str = "cluster",
) -> DataFrame:
    """One row: the mean silhouette of ``sample_n`` rows, or of all, among themselves."""
    rows = df if sample_n is None else take_sample(df, sample_n, id_col, seed)
    return silhouette_samples(rows, id_col, vec, cluster).agg(
        F.avg("silhouette").alias("silhouette")
    )


def silhouette_squared(df: DataFrame, vec: str = "vec", cluster: str = "cluster") -> float:
    """Spark's own silhouette, on squared distances, over all rows.

    Linear in the rows; not the same number as :func:`silhouette`.
    """
    rows = df.select(array_to_vector(vec).alias("features"), F.col(cluster).alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette").evaluate(rows)


def sweep(
    df: DataFrame,
    ks: Sequence[int] = SWEEP_KS,
    sample_n: int | None = None,
    silhouette_n: int | None = None,
    n_init: int = SWEEP_RESTARTS,
    seed: int = 42,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """(k, score, cost) for every k, fitted on ``sample_n`` of the rows, or on all.

    The fits of all k share their passes over the rows, one pass labels the
    rows by the best fit of every k, and scores are silhouettes among
    ``silhouette_n`` of those rows, for which each distance is measured once.
    Rows are told apart by their place, so ids may repeat or be NULL.
    """
    rows = df if sample_n is None else take_sample(df, sample_n, id_col, seed)
    held = durable(usual_width(rows.select(id_col, vec), vec))
    every = [(k, seed + i) for k in ks for i in range(n_init)]
    begin = lloyd.starts(held, [k for k, _ in every], [s for _, s in every], id_col, vec)
    fits = lloyd.fit_all(held, begin, MAX_ITER, TOLERANCE * _mean_variance(held, vec), vec)
    best = [min(fits[i * n_init : (i + 1) * n_init], key=lambda fit: fit.cost) for i in range(len(ks))]
    scored = held if silhouette_n is None else take_sample(held, silhouette_n, id_col, seed)
    labels = _labels(F.col(vec), [fit.centres for fit in best])
    points = scored.select(F.col(id_col), F.col(vec).alias("vec"), labels.alias("labels"))
    scores = labelled_silhouettes(points, id_col)
    means = scores.agg(*[F.avg(F.get("scores", F.lit(i))).alias(f"s{i}") for i in range(len(ks))]).first()
    results = [(int(k), means[i], best[i].cost) for i, k in enumerate(ks)]
    return df.sparkSession.createDataFrame(results, "k int, score double, cost double")


def choose_k(scores: DataFrame) -> int:
    """The k with the highest score, the lowest k among equals."""
    return argmax_row(scores, "score", "k").first().k


def best_clustering(
    df: DataFrame,
    ks: Sequence[int] = FINE_SWEEP_KS,
    sample_n: int | None = None,
    silhouette_n: int | None = None,
    n_init: int = SWEEP_RESTARTS,
    seed: int = 42,
    id_col: str = "id",
    vec: str = "vec",
) -> tuple[DataFrame, KMeansResult, float]:
    """Choose k on a sample, then fit all rows with it: (scores, fit, score of the fit)."""
    scores = sweep(df, ks, sample_n, silhouette_n, n_init, seed, id_col, vec)
    fit = kmeans(df, choose_k(scores), n_init, seed, id_col=id_col, vec=vec)
    final = silhouette(fit.labelled, silhouette_n, seed, id_col, vec).first()[0]
    return scores, fit, final


def cluster_subset(df: DataFrame, start: int, end: int, cluster: str = "cluster") -> DataFrame:
    """Rows of clusters ``start`` to ``end - 1``."""
    return df.where((F.col(cluster) >= start) & (F.col(cluster) < end))
