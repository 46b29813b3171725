"""The generative ratios, weights and sampling against plain versions; which rows stay on corpora with a known answer."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def plain_features(text: str) -> set:
    data = text.encode().lower()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    found: dict = {}

    def add(kind: str, x) -> None:
        found[kind, x] = found.get((kind, x), 0) + 1

    for w in words:
        add("word", w)
        for k in range(len(w) - 4):
            add("chars", w[k : k + 5])
    for a, b in itertools.pairwise(words):
        add("pair", (a, b) if a != b else "twice")
    for x in re.findall(rb"[^0-9a-z\x80-\xff\x09-\x0d ]+", data):
        add("signs", x)
    return {*found, *(("often", x) for x, n in found.items() if n >= 3)}


def test_features():
    rng = random.Random(1)
    texts = ["", " \n", "a", "a a", "??! a--b", "été réeux 3.14 l'eau"] + [" ".join(rng.choice(["one", "two", "three3", "fourteen", "é", "!!", "a.b", "longerword"]) for _ in range(n)) for n in range(1, 40)]
    owner, bucket = quality.feature_buckets([t.encode() for t in texts])
    sets = [set(bucket[owner == k].tolist()) for k in range(len(texts))]
    plain = [plain_features(t) for t in texts]
    for a, b in itertools.combinations_with_replacement(range(len(texts)), 2):
        assert len(sets[a] & sets[b]) == len(plain[a] & plain[b])


def corpus(n: int = 1500, seed: int = 8) -> tuple[list, list]:
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(2000)}" for _ in range(80)]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(80)] = rng.choice(["awful", "nasty"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(i % 10 != 0 or i % 20 == 0), int(bad and i % 20 == 0)))
    rows += [(5000, None), (5001, "")]
    labels += [(1, 1, 0), (1, None, None), (None, 1, 1), (5001, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, LABELS).cache()


def test_weights_are_sums_of_log_ratios(spark, tables):
    docs, labels = tables
    rows, told = corpus()
    good = {i: q == 1 and t == 0 for i, q, t in told if i is not None and q is not None and i < 5000}
    good[1] = True
    buckets = {i: set(quality.feature_buckets([(t or "").encode()])[1].tolist()) for i, t in rows}
    model = quality.fit(quality.labelled_sample(docs, labels))
    n_good, n = sum(good.values()), len(good)

    def ratio(f: int, p: int, c: float) -> float:
        held = [good[i] for i in good if f in buckets[i]]
        expected = len(held) * n_good / n
        z = abs(sum(held) - expected) / math.sqrt(expected * (1 - n_good / n))
        return math.log((sum(held) + quality.SMOOTHING) / (expected + quality.SMOOTHING)) * z**p / (z**p + c)

    seen = sorted(set().union(*(buckets[i] for i in good)))
    fits = []
    for s in quality.SHRINKAGES:
        want = np.zeros(1 << quality.BITS)
        for f in seen[::7]:
            want[f] = ratio(f, *s)
        fits.append(np.abs(want[seen[::7]] - model.ratios[seen[::7]]).max() < 1e-4)
    assert sum(fits) == 1 and not model.ratios[sorted(set(range(1 << quality.BITS)) - set(seen))].any()
    got = {r.doc_id: r.log_weight for r in quality.log_weights(docs, model.ratios).collect()}
    for i, _ in rows:
        assert math.isclose(got[i], sum(float(model.ratios[f]) for f in buckets[i]), abs_tol=1e-3)


def test_folds_leave_their_own_documents_out(spark, tables):
    docs, counts = quality.count_features(quality.labelled_sample(*tables))
    assert docs.sum() == 751 and (docs > 100).sum() >= 3 and counts.shape == (quality.FOLDS, 2, 1 << quality.BITS)
    assert (counts <= docs[:, :, None]).all()


def test_sampling(spark, tables):
    docs, labels = tables
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    bad = {i for i in range(0, 1500, 5)}
    assert len(kept & bad) <= 15 and len(kept - bad) >= 0.98 * 1202
    assert quality.resample(docs, labels, k=100).count() == 100 and quality.resample(docs, labels, k=0).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() == 1502
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_noise_decides_who_stays(spark, tables):
    """A draw isn't the best k by weight, another seed is another draw, and heavier documents are drawn more often."""
    docs, labels = tables
    model = quality.fit(quality.labelled_sample(docs, labels))
    draws = [{r.doc_id for r in quality.resample(docs, labels, k=300, seed=s).collect()} for s in (1, 2)]
    weights = {r.doc_id: r.log_weight for r in quality.log_weights(docs, model.ratios).collect()}
    best = set(sorted(weights, key=lambda i: -weights[i])[:300])
    assert draws[0] != draws[1] and best not in draws
    mean = sum(weights.values()) / len(weights)
    assert all(sum(weights[i] for i in d) / 300 > mean for d in draws)


def test_draws_follow_weights(spark):
    """Gumbel keys with log weights 0 and log 3: the first of two is drawn three times as often."""
    rows = [(i, float(math.log(3) if i % 2 else 0.0)) for i in range(6000)]
    keyed = spark.createDataFrame(rows, "doc_id long, w double").withColumn("key", F.col("w") + quality.gumbel(5))
    key = {r.doc_id: r.key for r in keyed.collect()}
    wins = sum(key[i + 1] > key[i] for i in range(0, 6000, 2)) / 3000
    assert abs(wins - 0.75) < 0.03


def test_parts_of_words(spark):
    """Toxic documents share a part of words only, never a whole one."""
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(1200):
        w = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
        bad = i % 8 == 0
        for _ in range(5 if bad else 0):
            w[rng.randrange(60)] = w[0][:3] + "réeux" + "".join(rng.choice("abcdefgh") for _ in range(3))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    kept = {r.doc_id for r in quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()}
    assert len([i for i in kept if i % 8 == 0]) <= 6
    assert len([i for i in kept if i % 8]) >= 0.98 * 1050
