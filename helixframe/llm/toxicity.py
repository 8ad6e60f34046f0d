"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the rates of words and of word beginnings (`PREFIXES` letters). One weight per
feature serves every threshold: P(grade > k) = logistic(w.x - threshold_k) with thresholds
in ascending order. The score is the expected severity, the sum of these probabilities over
k; a document whose P(grade > 0) is at least a half is toxic. Grades come from the labels:
0 not toxic, 1 toxic, 2 toxic and of low quality.

The model is fitted on at most `fit_rows` labelled documents (those with the smallest hash
of doc_id), a documented bound, until its loss settles; whole texts are scored, everywhere
alike. As rates are sums over words, a word's share of the score is one number, which workers
remember.

Defined results: a null or empty text has only the thresholds' own score and isn't toxic; a
very long text is scored whole; a score just at a threshold is of the higher grade; without
labels, or with labels of one class, nothing is toxic; null labels are left out, of several
labels of a document the gravest counts; equal rows score alike; an empty table gives an
empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, materialize, sized, without, worker_cache

FIT_ROWS = 4_000
PREFIXES = (4, 5)
LEAST_DOCUMENTS = 5
CACHED = 300_000


def feature(name: str) -> int:
    """Features go by a 32-bit hash, so that the driver holds numbers only."""
    return xxhash.xxh32_intdigest(name)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rates of the text's words and word beginnings."""
    words = Counter(re.findall(r"\w+", (text or "").lower()))
    found: Counter = Counter()
    for word, n in words.items():
        found[feature(word)] += n
        for k in PREFIXES:
            if len(word) > k:
                found[feature(word[:k] + "*")] += n
    names = np.fromiter(found, np.uint32, len(found))
    return names, np.fromiter(found.values(), np.float32, len(found)) * np.float32(rate(words.total()))


def rate(n_words):
    return 100 / (n_words + 20)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], graded: list[int], grades: int = 3, rounds: int = 100, steps: int = 50, sparse: float = 0.001, settled: float = 1e-4) -> tuple[dict[int, float], list[float]]:
    """Weights by feature and ascending thresholds, by proximal adaptive gradient steps over
    all samples. A round looks at all features' gradients and takes `steps` steps on those
    that are in use or would be; rounds end when the loss falls by less than `settled` of
    itself. Features of fewer than LEAST_DOCUMENTS samples are left out."""
    names, spread = np.unique(np.concatenate([ids for ids, _ in samples]), return_counts=True)
    names = names[spread >= LEAST_DOCUMENTS]
    row, column, value = [], [], []
    for i, (ids, rates) in enumerate(samples):
        at = np.searchsorted(names, ids).clip(max=max(len(names) - 1, 0))
        known = names[at] == ids if len(names) else np.zeros(len(ids), bool)
        column.append(at[known].astype(np.int32))
        value.append(rates[known])
        row.append(np.full(int(known.sum()), i, np.int32))
    row, column, value = np.concatenate(row), np.concatenate(column), np.concatenate(value).astype(float)
    y, m, cuts = np.array(graded), len(samples), grades - 1
    above = y[:, None] > np.arange(cuts)
    if not above[:, 0].any() or above[:, 0].all():
        return {}, [30.0 + k for k in range(cuts)]
    start = above.mean(0).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - start) / start)
    w, seen, seen_theta = np.zeros(len(names)), np.full(len(names), 1e-8), np.full(cuts, 1e-8)
    k = np.arange(m)

    def slopes(z: np.ndarray):
        """Loss, and how it changes with a sample's sum and with the thresholds: the
        likelihood is that of the grade's interval between two neighbouring thresholds."""
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))
        up = np.concatenate([np.ones((m, 1)), p], axis=1)[k, y]
        low = np.concatenate([p, np.zeros((m, 1))], axis=1)[k, y]
        width = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / width, low * (1 - low) / width
        by_theta = np.array([(d_up * (y == j + 1) - d_low * (y == j)).sum() / m for j in range(cuts)])
        return -np.log(width).mean(), -(d_up - d_low) / m, by_theta

    last = np.inf
    for _ in range(rounds):
        loss, by_sum, _ = slopes(np.bincount(row, w[column] * value, m))
        loss += sparse * np.abs(w).sum()
        if last - loss < settled * loss:
            break
        last = loss
        used = np.flatnonzero((w != 0) | (np.abs(np.bincount(column, by_sum[row] * value, len(names))) > sparse))
        place = np.full(len(names), -1)
        place[used] = np.arange(len(used))
        own = place[column] >= 0
        r, c, v = row[own], place[column[own]], value[own]
        for _ in range(steps):
            _, by_sum, by_theta = slopes(np.bincount(r, w[used][c] * v, m))
            g = np.bincount(c, by_sum[r] * v, len(used))
            seen[used] += g**2
            step = 0.5 / np.sqrt(seen[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * sparse)
            seen_theta += by_theta**2
            theta = np.maximum.accumulate(theta - 0.3 / np.sqrt(seen_theta) * by_theta)
            theta += 1e-6 * np.arange(cuts)
    return {int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, [float(t) for t in theta]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[int, float], list[float]]:
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())], names=["doc_id", "grade", "ids", "rates"])

    rows = docs.select("doc_id", "text").join(sized(chosen, fit_rows), "doc_id").select("doc_id", "grade", "text")
    rows = rows.mapInArrow(count, "doc_id long, grade int, ids binary, rates binary").groupBy("doc_id").agg(F.max(F.struct("grade", "ids", "rates")).alias("x"))
    found = rows.select("doc_id", "x.*").toArrow().sort_by("doc_id")
    samples = [(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.float32)) for a, b in zip(found.column("ids"), found.column("rates"), strict=True)]
    return fit(samples, found.column("grade").to_pylist()) if samples else ({}, [30.0, 31.0])


def _score(rows: DataFrame, text: str, weights: dict[int, float], thresholds: list[float]) -> DataFrame:
    """rows with severity, p_toxic and grade."""
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast((weights, thresholds))  # as many weights as the bounded sample has features
    names = [f.name for f in rows.schema.fields]
    at = names.index(text)

    def run(batches):
        weights, thresholds = model.value
        cache = worker_cache(("toxicity", hash(tuple(sorted(weights.items())))), dict)

        def own(word: str) -> float:
            w = weights.get(feature(word), 0.0) + sum(weights.get(feature(word[:k] + "*"), 0.0) for k in PREFIXES if len(word) > k)
            if len(cache) < CACHED and len(word) <= LONGEST:
                cache[word] = w
            return w

        for batch in batches:
            severity, first, grades = [], [], []
            for x in batch.column(at):
                words = re.findall(r"\w+", (x.as_py() or "").lower())
                z = sum(cache[w] if w in cache else own(w) for w in words) * rate(len(words))
                p = [1 / (1 + np.exp(-np.clip(z - t, -30, 30))) for t in thresholds]
                severity.append(float(sum(p)))
                first.append(float(p[0]))
                grades.append(sum(v >= 0.5 for v in p))
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(severity), pa.array(first), pa.array(grades, pa.int32())], names=[*[n for n in names if n != text], "severity", "p_toxic", "grade"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    return rows.mapInArrow(run, f"{schema}, severity double, p_toxic double, grade int")


def severity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade, toxic."""
    out = _score(docs.select("doc_id", "text"), "text", *train(docs, labels, fit_rows))
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


def clean_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that aren't toxic, with their own columns."""
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    out = _score(rows, "text", *train(docs, labels, fit_rows))
    drop = materialize(out.filter("p_toxic >= 0.5").select("doc_id", "sha").distinct(), "toxic-drop")
    return without(docs, drop, drop.limit(0))
