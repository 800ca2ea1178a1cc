"""A model for the window seam: softmax regression on hashed features of a token and its neighbours."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.labels import LABELS
from maskloom.operators.scores import score_windows
from maskloom.sources.io import written

#: Buckets of hashed features, passes over the sample, and the step.
BUCKETS, PASSES, STEP = 1 << 15, 25, 1.0
#: Windows whose gradients are computed at once, and files that the features are dealt to.
CHUNK, FILES = 64, 32
#: Feature ids of a token: four of its own, two that it gives the token after it and two for the one before.
OWN, AFTER, BEFORE = slice(0, 4), slice(4, 6), slice(6, 8)
WIDTH = 9


def shape(token: str) -> str:
    """Kinds of characters, runs cut to two: `Ana-12345` to `Aaa-00`."""
    kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(?s)(.)\1+", r"\1\1", kinds)


def _ids(token: str, buckets: int) -> tuple[int, ...]:
    word, kinds = token.lower(), shape(token)
    parts = ("w" + word, "s" + kinds, "e" + word[-3:], f"n{min(len(token), 12)}", "<w" + word, "<s" + kinds, ">w" + word, ">s" + kinds)
    return tuple(zlib.crc32(p.encode()) % buckets for p in parts)


_short_ids = lru_cache(maxsize=1 << 16)(_ids)


def window_features(tokens: list[str], buckets: int) -> np.ndarray:
    """A row of feature ids per token. Id `buckets` is always there; `buckets + 1` stands for a missing neighbour."""
    ids = np.array([(_short_ids if len(t) <= 64 else _ids)(t, buckets) for t in tokens], dtype=np.int32).reshape(-1, 8)
    out = np.full((len(ids), WIDTH), buckets + 1, dtype=np.int32)
    out[:, OWN] = ids[:, OWN]
    out[1:, 4:6] = ids[:-1, AFTER]
    out[:-1, 6:8] = ids[1:, BEFORE]
    out[:, 8] = buckets
    return out


def probabilities(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    margin = weights[features].sum(axis=1)
    power = np.exp(margin - margin.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


def document_fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("document"), F.lit(folds)).cast("int")


def sample_documents(docs: DataFrame, n: int) -> DataFrame:
    """The `n` documents of least hash, so the same ones in every run.

    Their keys are found without the texts, since every partition gives its own `n` to a last one.
    """
    least = [F.xxhash64("document"), F.col("document")]
    keys = docs.select(F.col("document").alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(n).distinct()
    picked = docs.join(F.broadcast(keys), F.col("document").eqNullSafe(F.col("_key")), "left_semi")
    return picked.orderBy(*least).limit(n)  # a document may be there twice


def fit(
    windows: DataFrame, labels=LABELS, folds: int = 2, buckets: int = BUCKETS, passes: int = PASSES, step: float = STEP
) -> np.ndarray:
    """Weights (fold, feature, label); those of a fold come from the windows of all other folds.

    `windows` (document, tokens, labels) are the sample to learn from: features are written once, and every
    pass adds up the gradients of all folds. Labels that are null or not among `labels` count as the last one,
    `O`. Steps shrink per weight by the root of its summed squared gradients; without windows all weights are 0.
    The driver holds the weights, which the parameters bound.
    """
    n_labels, places = len(labels), {name: i for i, name in enumerate(labels)}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [window_features(t, buckets).ravel() for t in batch.column("tokens").to_pylist()]
            y = [[places.get(v, n_labels - 1) for v in row] for row in batch.column("labels").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))], ["fold", "x", "y"]
            )

    rows = windows.filter(F.size("tokens") > 0).select(document_fold(folds).alias("fold"), "tokens", "labels")
    table = written(rows.repartition(FILES).mapInArrow(encoded, "fold int, x array<int>, y array<int>"))
    sizes = {r.fold: r.n for r in table.groupBy("fold").agg(F.sum(F.size("y")).alias("n")).collect()}
    n = np.array([sum(c for g, c in sizes.items() if g != f) for f in range(folds)])
    n_features, sums = buckets + 2, [f"g{c}" for c in range(n_labels)]
    weights, squares = (np.zeros((folds, n_features, n_labels)) for _ in range(2))

    for _ in range(passes if sizes else 0):
        now = weights

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, n_features, n_labels))
            for batch in batches:
                for k in range(0, len(batch), CHUNK):
                    part = batch.slice(k, CHUNK)
                    y = part.column("y").flatten().to_numpy()
                    x = part.column("x").flatten().to_numpy().reshape(-1, WIDTH)
                    fold = np.repeat(part.column("fold").to_numpy(), part.column("y").value_lengths().to_numpy())
                    for f in range(folds):
                        others = fold != f
                        error = probabilities(now[f], x[others])
                        error[np.arange(len(error)), y[others]] -= 1
                        at = x[others].ravel()
                        for c in range(n_labels):
                            total[f, :, c] += np.bincount(at, np.repeat(error[:, c], WIDTH), n_features)
            by_feature = total.reshape(-1, n_labels)
            at = np.flatnonzero(by_feature.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v) for v in by_feature[at].T)], ["at", *sums])

        found = table.mapInArrow(gradient, "at long, " + ", ".join(f"{c} double" for c in sums)).groupBy("at").agg(*(F.sum(c).alias(c) for c in sums))
        found, g = found.toArrow(), np.zeros((folds * n_features, n_labels))
        g[found["at"].to_numpy()] = np.stack([found[c].to_numpy() for c in sums], axis=1)  # at most folds x features rows
        g = g.reshape(weights.shape) / np.maximum(n, 1)[:, None, None]
        squares = squares + g * g
        weights = weights - step * g / np.sqrt(squares + 1e-12)
    return weights


def model(weights: np.ndarray) -> Callable[[list[str]], np.ndarray | list]:
    """The fitted weights of one fold as a model for `score_windows`."""
    return lambda tokens: probabilities(weights, window_features(tokens, len(weights) - 2)) if tokens else []


def cross_scored(windows: DataFrame, weights: np.ndarray, labels=LABELS) -> DataFrame:
    """Scores of all tokens of `windows` (document, window, first, tokens), each by the model that did not see its document."""
    return score_windows(windows, [model(w) for w in weights], labels, document_fold(len(weights)))
