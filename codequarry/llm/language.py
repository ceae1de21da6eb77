"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import texts

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
WIDTH = 16
SIZES = (1, 2, 3, 4)  # bytes of a subword
# Training rows of each language, in expectation.
SAMPLE_PER_LANGUAGE = 800
EPOCHS = 6
RATE = 0.5
UNKNOWN = "und"
# Share of held-back rows, right ones, that rejection may cost.
REJECTED = 0.01
BLOCK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # not a letter: a boundary


def subwords(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: buckets of the texts' subwords, and where each text's begin.

    A subword is a run of bytes of one word, which may begin or end with one
    boundary; bytes that are not ASCII letters, nor part of a character beyond
    ASCII, are boundaries.
    """
    raw = _FOLD[np.frombuffer(b" ".join([b"", *values, b""]), np.uint8)]
    # A text owns its bytes and the boundary before it.
    starts = np.concatenate(([0], np.cumsum([len(v) + 1 for v in values])))
    wide = raw.astype(np.uint32)
    edge = raw == 32
    h = np.zeros(len(raw), np.uint32)
    clean = ~edge
    for size in range(1, max(SIZES) + 1):
        n = max(0, len(raw) - size + 1)
        h = (h[:n] * np.uint32(0x01000193)) ^ wide[size - 1 :]
        if size == 2:
            clean = ~(edge[:n] & edge[1:])
        elif size == 3:
            clean = ~edge[1 : 1 + n]
        elif size > 3:
            clean = clean[:n] & ~edge[size - 2 : size - 2 + n]
        if size in SIZES:
            keep = np.flatnonzero(clean)
            mixed = (h[keep] + np.uint32(size)) * np.uint32(0x9E3779B1)
            yield mixed >> np.uint32(32 - BUCKET_BITS), np.searchsorted(keep, starts)


@dataclass
class LanguageModel:
    """Scores of each bucket for each language, and the calibration.

    ``table`` is the product of embeddings and softmax weights: the average
    embedding times the weights is the average of its rows.
    """

    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, values: list[bytes]) -> np.ndarray:
        sums = np.zeros((len(values), len(self.languages)))
        counts = np.zeros(len(values), np.int64)
        for buckets, cuts in subwords(values):
            own = np.diff(cuts)
            some = np.flatnonzero(own)
            if len(some):
                sums[some] += np.add.reduceat(self.table[buckets], cuts[:-1][some], axis=0)
            counts += own
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, values: list[bytes]) -> np.ndarray:
        return softmax(self.logits(values) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([buckets for buckets, _ in subwords([(text or "").encode()])])
    buckets, counts = np.unique(every, return_counts=True)
    return buckets.astype(np.int32), counts.astype(np.float32)


def train(rows: list[tuple[str, str]], seed: int = 0) -> LanguageModel:
    """Learn from (text, language) by stochastic gradient descent.

    A fifth of the rows is held back: on it the temperature is chosen by
    log-loss, and the threshold as the probability that all but REJECTED of
    its right answers reach. Without rows no language is known, and every text
    is ``und``.
    """
    if not rows:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 2.0)
    rng = np.random.default_rng(seed)
    rows = sorted(rows)  # tasks return them in any order
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    rows = [rows[i] for i in rng.permutation(len(rows))]
    features = [_counts(t) for t, _ in rows]
    answers = np.array([number[lang] for _, lang in rows])
    back = max(1, len(rows) // 5) if len(rows) > 4 else 0
    embedding = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages))
    fitted = [i for i in range(back, len(rows)) if len(features[i][0])]
    steps = max(1, EPOCHS * len(fitted))
    for step in range(EPOCHS * len(fitted)):
        if step % len(fitted) == 0:
            order = rng.permutation(fitted)
        i = order[step % len(fitted)]
        buckets, counts = features[i]
        share = counts / counts.sum()
        mean = share @ embedding[buckets]
        error = softmax((mean @ weights + bias)[None])[0]
        error[answers[i]] -= 1
        rate = RATE * (1 - step / steps)
        back_gradient = weights @ error.astype(np.float32)
        weights -= np.float32(rate) * np.outer(mean, error).astype(np.float32)
        bias -= rate * 0.1 * error
        embedding[buckets] -= np.float32(rate) * share[:, None] * back_gradient * np.float32(WIDTH)
    model = LanguageModel(languages, (embedding @ weights).astype(np.float32), bias, 1.0, 0.0)
    check = range(back) if back else range(len(rows))
    logits = np.concatenate([model.logits([(rows[i][0] or "").encode()]) for i in check])
    truth = answers[list(check)]
    losses = {
        t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        for t in np.geomspace(0.05, 5, 40)
    }
    model.temperature = float(min(losses, key=losses.get))
    sure = softmax(logits / model.temperature)
    right = sure.argmax(axis=1) == truth
    model.threshold = float(np.quantile(sure.max(axis=1)[right], REJECTED)) if right.any() else 1.0
    return model


def sample(labelled: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """About SAMPLE_PER_LANGUAGE rows of each language, drawn by the hash of their keys.

    Their whole texts come to the driver.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row[0]: row[1] for row in known.groupBy(lang).count().collect()}
    if not counts:
        return []
    share = F.create_map(
        *(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, SAMPLE_PER_LANGUAGE / n)))
    )
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    return [(r[0], r[1]) for r in known.where(draw < share[F.col(lang)]).select(text, lang).collect()]


def predict(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, lang_pred, score, accepted) of whole texts.

    A NULL text and one without a letter are ``und`` with score 0 and not
    accepted. Any other gets the likeliest language and its calibrated
    probability; ``accepted`` says whether that reaches the model's threshold.
    """
    letter = F.coalesce(F.col("__t").rlike("\\p{L}"), F.lit(False))
    source = texts(docs, key, text).toDF(key, "__t").withColumn("letter", letter)
    kind = source.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            letters = batch.column(2).to_pylist()
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            blocks, held, size = [], [], 0
            for value in raw:
                held.append(value)
                size += len(value)
                if size >= BLOCK_BYTES:
                    blocks.append(own.probabilities(held))
                    held, size = [], 0
            if held:
                blocks.append(own.probabilities(held))
            sure = np.concatenate(blocks) if blocks else np.zeros((0, 1))
            best = sure.argmax(axis=1)
            score = np.where(letters, sure.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([own.languages[i] if x else UNKNOWN for i, x in zip(best, letters)], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([bool(x and s >= own.threshold) for x, s in zip(letters, score)], pa.bool_()),
                ],
                names=[key, "lang_pred", "score", "accepted"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, accepted boolean")
