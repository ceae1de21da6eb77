"""Held-out accuracy of what is learned, and estimates of the sketches against exact figures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from codequarry.llm import language, quality, sketches
from codequarry.llm.common import load

FOLDER = "/root/testdata/sf0.01"
QUERIES = {name: entry.run for name, entry in load().items()}


def auc(scores, good):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    for value in np.unique(scores):
        at = np.flatnonzero(scores == value)
        ranks[at] = np.mean(np.flatnonzero(scores[order] == value)) + 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = [r for r in QUERIES["op4_language_id"](spark, FOLDER).collect() if r.held_out]
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert len(right) > 200 and np.mean(right) >= 0.95


def test_language_rejection(spark):
    """What is of no learned language is accepted less often than what is."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.train(language.sample(rows, "doc_id", "text", "lang"))
    rng = random.Random(2)
    noise = ["".join(rng.choices("qxzjkwvfbgp ", k=300)) for _ in range(80)] + ["漢字かな" * 40, "привет мир " * 20]
    frame = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    odd = [r.accepted for r in language.predict(frame, model).collect()]
    own = [r.accepted for r in language.predict(rows.select("doc_id", "text"), model).collect()]
    assert np.mean(own) > 0.9 and np.mean(odd) < 0.5


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = [r for r in QUERIES["op8_quality"](spark, FOLDER).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good = np.array([labels[r.doc_id] == 1 for r in got])
    assert len(got) > 50 and auc(np.array([r.score for r in got]), good) >= 0.9
    assert np.mean([r.predicted == g for r, g in zip(got, good)]) >= 0.9


def exact_likeness(a, b, size=sketches.SHINGLE_BYTES):
    x, y = ({t[i : i + size] for i in range(max(1, len(t) - size + 1))} for t in (a.encode(), b.encode()))
    return len(x & y) / len(x | y), len(x & y) / len(x)


def test_likeness_estimates(spark):
    """Errors beside the exact figures of the same shingles: small on average, larger for short texts."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op10_sketches"](spark, FOLDER).collect()}
    errors, short = [], []
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        if text:
            error = abs(got[key].near_edited - exact_likeness(text, sketches.edited(text, after))[0])
            (errors if len(text) >= 300 else short).append(error)
    assert np.mean(errors) < 0.05 and np.percentile(errors, 95) < 0.15
    assert not short or np.mean(short) < 0.25


def test_merged_sketches_of_unequal_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(30_000)]
    long = [" ".join(words[i : i + 3000]) for i in range(0, 30_000, 3000)]
    small = " ".join(words[4000:4300])
    mixed = " ".join(words[4000:4150]) + " " + "".join(rng.choices("xyz ", k=900))
    rows = [("corpus", t) for t in long] + [("small", small), ("mixed", mixed), ("tiny", "a b"), ("tiny", "c"), (None, "x y")]
    frame = spark.createDataFrame(rows, "g string, text string").repartition(3)
    prints = sketches.fingerprints(frame, "g")
    merged = sketches.merge(prints, "g")
    by = {}
    for r in merged.collect():
        by.setdefault(r.g, set()).add(r.hash)
    parts = {}
    for r in prints.collect():
        parts.setdefault(r.g, set()).update(r.fingerprint)
    low = lambda h: 0 <= h < 2**64 * sketches.KEPT
    for g, found in by.items():
        kept = {h for h in parts[g] if low(h)}
        assert found == (kept or {min(parts[g], key=lambda h: h % 2**64)})
    found = {r.part: r for r in sketches.contained(
        merged.withColumnRenamed("g", "part"), merged.withColumnRenamed("g", "whole"), "part", "whole"
    ).where("whole = 'corpus'").collect()}
    whole = " ".join(long)
    for name, text in (("small", small), ("mixed", mixed)):
        assert found[name].share == pytest.approx(exact_likeness(text, whole)[1], abs=4 / math.sqrt(found[name].n_hashes) / 2)
    assert found["small"].share > 0.98 and found["small"].n_hashes * 50 < found["corpus"].n_hashes


def plain_fit(x, good, margin=0.0, steps=4000, rate=0.5):
    """Bradley-Terry by whole-gradient descent over all pairs."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(sd > 0, sd, 1.0)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        d = z[good][:, None] - z[~good][None]
        p = 1 / (1 + np.exp(d @ w))
        w += rate * ((p[..., None] * d).mean(axis=(0, 1)) - 1e-3 * w)
    return z @ w


def test_quality_against_a_plain_fit():
    """The ranking learned from drawn pairs is that of a fit on all pairs."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, len(quality.NAMES)))
    good = x[:, 0] + 0.5 * x[:, 1] + 0.8 * rng.normal(size=120) > 0
    model = quality.fit(x, good)
    own = model.score(x)
    assert abs(auc(own, good) - auc(plain_fit(x, good, steps=400), good)) < 0.05


def test_quality_learns_from_every_label(spark, monkeypatch):
    """Far more rows than a group holds: sums, threshold and pairs are of all of them, few good ones are dealt again."""
    monkeypatch.setattr(quality, "GROUP_ROWS", 40)
    n = 6000
    good = [i % 700 == 3 for i in range(n)]
    texts = [("One sentence, then more words of it. " if g else "buy!! NOW ") * (1 + i % 5) + str(i % 11) for i, g in enumerate(good)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    rows = quality.labelled_features(docs, labels, "doc_id", "text", "quality")
    met = quality.groups(rows, sum(good), n - sum(good)).collect()
    assert len(met) == n // 40 and all(r.yes > 0 for r in met)
    assert sum(len(r.x) // 8 // len(quality.NAMES) - r.yes for r in met) == n - sum(good)
    model = quality.learn(docs, labels)
    x = np.array([quality.features(t) for t in texts])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6, atol=1e-6)
    worth = model.worth(x)
    assert np.isclose(model.threshold, quality._threshold(worth, np.array(good)))
    assert auc(model.score(x), np.array(good)) > 0.99
    again = quality.learn(docs.repartition(3), labels)
    assert np.allclose(again.weights, model.weights, atol=1e-6)
