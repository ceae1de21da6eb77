"""Quality scores learned from preference pairs (Bradley-Terry), thresholded by quantile."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import texts
from codequarry.operators.rows import with_row_index
from codequarry.session import durable

# Labelled rows that meet in a group, about, and times that each row of the
# larger class is paired there.
GROUP_ROWS = 4096
PARTNERS = 16
# Newton steps at most, the step at which they end, and the penalty on weights.
ROUNDS = 50
SETTLED = 1e-8
PENALTY = 1e-3
SLOPES = np.geomspace(0.05, 20, 60)

_KIND = np.zeros(256, np.int64)  # of a byte: 0 letter, 1 upper case, 2 digit, 3 space, 4 line, 5 .,;: 6 other
_KIND[:128] = 6
_KIND[65:91], _KIND[97:123] = 1, 0
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[[44, 46, 58, 59, 39, 45]] = 5
_CHARACTER = np.ones(256, bool)
_CHARACTER[128:192] = False  # inside a character
MARKS = re.compile(r"([^\w\s])\1")
NAMES = (
    "characters words word_length upper digits spaces lines stops others distinct_words most_frequent_word "
    "repeated_next repeated_lines doubled_marks shouted short_words long_words line_length"
).split()


def features(text: str | None) -> list[float]:
    """What a whole text looks like, as numbers: see NAMES. An empty text has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(text)
    kinds = np.bincount(_KIND[raw], _CHARACTER[raw], minlength=7) / n
    words = text.split()
    count = len(words) or 1
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        min(lengths.mean(), 30.0),
        kinds[1],
        kinds[2],
        kinds[3],
        kinds[4],
        kinds[5],
        kinds[6],
        (len(seen) / count) * np.log1p(count) ** 0.5,
        max(seen.values(), default=0) / count,
        sum(map(str.__eq__, words, words[1:])) / count,
        1 - len(set(lines)) / len(lines),
        min(len(MARKS.findall(text)) / count, 2.0),
        sum(map(str.isupper, words)) / count,
        float((lengths <= 2).mean()),
        float((lengths >= 15).mean()),
        np.log1p(n / len(lines)),
    ]


@dataclass
class QualityModel:
    """``weights`` of standardised features; a score of 1/2 stands at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry worth of each row, on the log scale."""
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.worth(x) - self.threshold), -500, 500)))


def expand(z: np.ndarray) -> np.ndarray:
    """Features, bounded, and how far they are from usual in either direction."""
    z = np.clip(z, -6, 6)
    return np.concatenate((z, np.abs(z)), axis=1)


def fit(x: np.ndarray, good: np.ndarray) -> QualityModel:
    """What ``learn`` does, on rows at hand: all of them are one group."""
    n, yes = len(x), int(good.sum())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    if not 0 < yes < n:
        return _one_class(mean, scale, yes > 0)
    z = expand((np.concatenate((x[good], x[~good])) - mean) / scale)
    weights = _weights(lambda w: _pair_totals(z, yes, w), z.shape[1])
    worth = expand((x - mean) / scale) @ weights
    threshold = float(_threshold(worth, good))
    return QualityModel(mean, scale, weights, threshold, _slope(_slope_losses(worth - threshold, good)))


def _one_class(mean: np.ndarray, scale: np.ndarray, good: bool) -> QualityModel:
    """Rows of one class only teach nothing: every score is 1/2 or more for good, below it for bad."""
    return QualityModel(mean, scale, np.zeros(2 * len(mean)), -1.0 if good else 1.0, 1.0)


def _pair_totals(z: np.ndarray, yes: int, weights: np.ndarray) -> np.ndarray:
    """Pairs of a group, their loss, its gradient and its curvature, added up.

    The first ``yes`` rows are good. In each of some rounds every row of the
    larger class meets one of the smaller, further on each time.
    """
    no, width = len(z) - yes, z.shape[1]
    turns, rounds = max(yes, no), min(PARTNERS, yes, no)
    total = np.zeros(2 + width + width * width)
    for r in range(rounds):
        t = np.arange(turns) + r * (min(yes, no) // rounds) * np.array([[yes <= no], [yes > no]])
        d = z[t[0] % yes] - z[yes + t[1] % no]
        margin = np.clip(d @ weights, -500, 500)
        lost = 1 / (1 + np.exp(margin))
        curved = (d * (lost * (1 - lost))[:, None]).T @ d
        total += np.concatenate(([turns, np.logaddexp(0, -margin).sum()], -(lost @ d), curved.ravel()))
    return total


def _weights(totals: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The weights of least penalised loss, by Newton steps; one that raises the loss is halved."""
    weights, step, least = np.zeros(width), np.zeros(width), np.inf
    for _ in range(ROUNDS):
        pairs, loss, *rest = totals(weights + step)
        trial = weights + step
        value = loss / pairs + PENALTY / 2 * trial @ trial
        if value > least + 1e-12:
            step = step / 2
            continue
        weights, least = trial, value
        gradient = np.array(rest[:width]) / pairs + PENALTY * weights
        curved = np.array(rest[width:]).reshape(width, width) / pairs + PENALTY * np.eye(width)
        step = -np.linalg.solve(curved, gradient)
        if np.abs(step).max() < SETTLED:
            break
    return weights


def _slope_losses(above: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The logistic loss of every slope, added up over rows."""
    signed = np.where(good, -above, above)
    return np.array([np.logaddexp(0, s * signed).sum() for s in SLOPES])


def _slope(losses: np.ndarray) -> float:
    return float(SLOPES[int(np.argmin(losses))])


def _threshold(worth: np.ndarray, good: np.ndarray) -> float:
    """The middle between the two worths that the quantile of the bad share parts."""
    ordered = np.sort(worth)
    bad = int((~good).sum())
    return (ordered[bad - 1] + ordered[min(bad, len(ordered) - 1)]) / 2


def _added(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of what ``make`` gives for every batch: added up in tasks, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = make(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = [np.frombuffer(row.total) for row in rows.mapInArrow(run, "total binary").collect()]
    return np.sum(parts, axis=0) if parts else None


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def labelled_features(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(h, good, x) of every row labelled 0 or 1, written once; ``h`` is a hash that orders them.

    Features, not texts, meet the labels.
    """
    named = docs.where(F.col(key).isNotNull())
    hashed = named.select(F.struct(F.col(key).alias("key"), F.xxhash64(key, text).alias("h")).alias("row"), text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.column(0).flatten(), pa.array(rows, pa.list_(pa.float64()))], names=["key", "h", "x"]
            )

    found = texts(hashed, "row", text).mapInArrow(run, f"key {kind}, h long, x array<double>")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), (F.col(label) == 1).alias("good"))
    return durable(found.join(known, "key").select("h", "good", "x"))


def groups(rows: DataFrame, yes: int, no: int) -> DataFrame:
    """(yes, x): every row in a group of about GROUP_ROWS with rows of both classes, the good ones first.

    Rows of a class are numbered in the order of their hashes and dealt in
    turn. A class with fewer rows than there are groups is dealt again.
    """
    count = max(1, -(-(yes + no) // GROUP_ROWS))

    def dealt(good: bool, size: int) -> DataFrame:
        numbered = with_row_index(rows.where("good" if good else "NOT good"), ["h", "x"], "i")
        if size >= count:
            return numbered.withColumn("group", F.col("i") % count)
        return numbered.withColumn("group", F.explode(F.sequence("i", F.lit(count - 1).cast("long"), F.lit(size).cast("long"))))

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by([("good", "descending"), ("h", "ascending")]).combine_chunks()
        x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        own = sum(group["good"].to_pylist())
        return pa.table([pa.array([own], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["yes", "x"])

    every = dealt(True, yes).unionByName(dealt(False, no)).select("group", "good", "h", "x")
    return durable(every.groupBy("group").applyInArrow(gather, "yes int, x binary"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learn worths such that of a good and a bad row the good one is likely preferred.

    All rows of ``docs`` that ``labels`` names are learned from; without any,
    all scores are 1/2. Logistic loss on the difference of a pair's features,
    by Newton steps; pairs are made in groups, and every row is in some. The
    threshold is the quantile of the rows' worths that leaves below it the
    share of bad rows; the slope makes scores follow the labels. The driver
    sees sums only.
    """
    rows = labelled_features(docs, labels, key, text, label)
    width = len(NAMES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.concatenate(([len(x), sum(batch.column("good").to_pylist())], x.sum(axis=0), (x * x).sum(axis=0)))

    seen = _added(rows, moments)
    if seen is None:
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0, 1.0)
    n, yes = int(seen[0]), int(seen[1])
    mean = seen[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(seen[2 + width :] / n - mean * mean, 0.0)) + 1e-6
    if not 0 < yes < n:
        return _one_class(mean, scale, yes > 0)
    met = groups(rows, yes, n - yes)

    def totals(weights: np.ndarray) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            total = 0.0
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer()).reshape(-1, width)
                total = total + _pair_totals(expand((x - mean) / scale), own, weights)
            return total

        return _added(met, of)

    model = QualityModel(mean, scale, _weights(totals, 2 * width), 0.0, 1.0)

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.worth(_matrix(batch)))], names=["worth"])

    ordered = with_row_index(rows.select("x").mapInArrow(worths, "worth double"), ["worth"], "at")
    bad = n - yes
    middle = ordered.where(F.col("at").isin(bad - 1, bad)).select("worth").collect()  # two rows
    threshold = sum(row.worth for row in middle) / 2
    losses = _added(rows, lambda batch: _slope_losses(model.worth(_matrix(batch)) - threshold, np.array(batch.column("good").to_pylist())))
    return QualityModel(mean, scale, model.weights, threshold, _slope(losses))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of whole texts: 0 to 1, from 1/2 on as good as the threshold.

    One row for each row. NULL and empty texts have the features of no text.
    """
    source = texts(docs, key, text)
    kind = source.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=[key, "score"]
            )

    return source.mapInArrow(run, f"`{key}` {kind}, score double")


def keep(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is 1/2 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    texts(docs, text, text)  # small batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(place).to_pylist()]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(shared.value.score(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
