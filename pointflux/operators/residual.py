"""Residual vector quantization: codebooks fitted on a bounded sample, every row coded against them.

Training runs on the driver over ``SAMPLE`` rows at most, those smallest by hash,
which is what the method fits on; coding reads all rows where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codebooks import seed_index
from .stats import quantiles

#: Rows that codebooks are fitted on, at most.
SAMPLE = 32_768
#: Branches of both levels of a tree and the rounds that fit them; batches of the shared codebooks.
BRANCHES, COARSE_ROUNDS, FINE_ROUNDS = 16, 8, 6
BATCH, BATCH_ROUNDS = 4_096, 60
BLOCK = 4_096


def sample(rows: DataFrame, vector: str, n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` vectors, smallest by hash, in that order; the same on every run."""
    found = rows.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector), vector).limit(n).toPandas()[vector]
    return np.stack(found.to_numpy()).astype(np.float64) if len(found) else np.zeros((0, 0))


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float16).astype(np.float64)


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The nearest code of each row, the first of equals."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        out[at : at + BLOCK] = ((part[:, None, :] - codes[None]) ** 2).sum(2).argmin(1) if codes.shape[1] * len(codes) < 4096 else ((codes * codes).sum(1) - 2 * part @ codes.T).argmin(1)
    return out


def lloyd(x: np.ndarray, clusters: int, rounds: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels after fixed rounds from fixed rows; an empty cluster keeps its centre."""
    codes = x[seed_index(clusters, len(x), seed)].copy()
    labels = nearest(x, codes)
    for _ in range(rounds):
        sums, n = np.zeros_like(codes), np.bincount(labels, minlength=clusters)
        np.add.at(sums, labels, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
        labels = nearest(x, codes)
    return codes, labels


@dataclass
class Tree:
    """16 coarse centres, each with 16 fine ones in half precision; a label is coarse * 16 + fine."""

    coarse: np.ndarray
    fine: np.ndarray

    @property
    def codes(self) -> np.ndarray:
        return self.fine

    def label(self, x: np.ndarray) -> np.ndarray:
        """The nearest of the fine centres below the nearest coarse one."""
        top = nearest(x, self.coarse)
        below = self.fine.reshape(BRANCHES, BRANCHES, -1)[top]
        return top * BRANCHES + ((x[:, None, :] - below) ** 2).sum(2).argmin(1)


@dataclass
class Flat:
    """One list of centres."""

    centres: np.ndarray

    @property
    def codes(self) -> np.ndarray:
        return self.centres

    def label(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centres)


def train_tree(x: np.ndarray) -> Tree:
    """A two-level tree; a branch without rows is fitted on all."""
    coarse, labels = lloyd(x, BRANCHES, COARSE_ROUNDS)
    fine = [lloyd(x[labels == g] if (labels == g).any() else x, BRANCHES, FINE_ROUNDS, g + 1)[0] for g in range(BRANCHES)]
    return Tree(coarse, _half(np.concatenate(fine)))


def train_flat(x: np.ndarray, clusters: int, seed: int, keep_zero: bool = False) -> Flat:
    """Mini-batch k-means: each batch pulls its centres by one over the rows they have had; ``keep_zero`` makes code 0 the zero vector."""
    k = min(clusters - keep_zero, len(x))
    rng = np.random.default_rng(seed)
    codes, had = x[rng.choice(len(x), k, replace=False)].copy(), np.zeros(k)
    for _ in range(BATCH_ROUNDS):
        batch = x[rng.integers(0, len(x), min(BATCH, len(x)))]
        labels = nearest(batch, codes)
        n, sums = np.bincount(labels, minlength=k), np.zeros_like(codes)
        np.add.at(sums, labels, batch)
        had += n
        codes += np.where(n[:, None] > 0, (sums - n[:, None] * codes) / np.maximum(had, 1)[:, None], 0.0)
    codes = _half(codes)
    return Flat(np.concatenate([np.zeros((1, x.shape[1])), codes]) if keep_zero else codes)


def train_levels(x: np.ndarray, fit, levels: int) -> list[Tree | Flat]:  # noqa: ANN001
    """``levels`` codebooks, each by ``fit(residuals, level)`` on what those before leave over."""
    models = []
    for level in range(levels):
        models.append(fit(x, level))
        x = x - models[-1].codes[models[-1].label(x)]
    return models


def encode(rows: DataFrame, vector: str, models: Sequence[Tree | Flat], keep: Sequence[str]) -> DataFrame:
    """``(*keep, labels, decoded, error)``: a label for each level, their sum of codes, and its distance from the vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            left, labels = x.copy(), []
            for m in models:
                labels.append(m.label(left))
                left -= m.codes[labels[-1]]
            out = pdf[list(keep)].copy()
            out["labels"], out["decoded"], out["error"] = list(np.stack(labels, 1).astype(np.int32)), list(x - left), np.sqrt((left * left).sum(1))
            yield out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.where(F.col(vector).isNotNull()).select(*dict.fromkeys([*keep, vector])).mapInPandas(run, f"{kinds}, labels array<int>, decoded array<double>, error double")


def tree_levels(rows: DataFrame, vector: str, keep: Sequence[str], levels: int = 2) -> DataFrame:
    """All rows coded by residual trees of 256 codes a level."""
    return encode(rows, vector, train_levels(sample(rows, vector), lambda x, _: train_tree(x), levels), keep)


def shared_levels(rows: DataFrame, vector: str, keep: Sequence[str], segment: str, clusters: int, levels: int, seed: int = 1) -> DataFrame:
    """All segments' rows coded by codebooks they share, fitted on a sample that holds each segment's share of the rows, code 0 being zero."""
    sizes = {r[segment]: r["n"] for r in rows.where(F.col(vector).isNotNull()).groupBy(segment).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each segment
    whole = sum(sizes.values())
    parts = [sample(rows.where(F.col(segment).eqNullSafe(F.lit(s))), vector, max(1, round(min(SAMPLE, whole) * n / whole))) for s, n in sorted(sizes.items(), key=lambda kv: (kv[0] is None, kv[0]))]
    models = train_levels(np.concatenate(parts), lambda x, level: train_flat(x, clusters, seed + level, keep_zero=True), levels)
    return encode(rows, vector, models, [*keep, segment])


def curve_bank(tracks: DataFrame, curve: str, importance: str, keep: Sequence[str], clusters: int = 256, levels: int = 2, share: float = 0.1, sparse_clusters: int = 64, seed: int = 1) -> DataFrame:
    """Tracks' displacements from their first key coded by residual levels, and the most important ones by a level more.

    ``curve`` is an array of x, y, z for each key; ``labels`` has a code for each
    level and a last one that is 0, the zero vector, but for the ``share`` of most
    important tracks (those at or above that quantile). ``error`` is what is left over.
    """
    first = F.slice(curve, 1, 3)
    moved = F.transform(F.slice(curve, 4, F.size(curve) - 3), lambda v, i: v - F.get(first, i % 3))
    rows = tracks.select(*keep, importance, moved.alias("moved"))
    models = train_levels(sample(rows, "moved"), lambda x, level: train_flat(x, clusters, seed + level, keep_zero=True), levels)
    coded = encode(rows, "moved", models, [*keep, importance, "moved"])
    cut = (quantiles(rows, importance, [1 - share]) or [0.0])[0]
    left = coded.withColumn("_left", F.zip_with("moved", "decoded", lambda a, b: a - b)).withColumnRenamed("labels", "_labels").withColumnRenamed("decoded", "_decoded").drop("error")
    top = left.where(F.col(importance) >= cut)
    last = train_flat(sample(top, "_left"), sparse_clusters, seed + levels, keep_zero=True)
    kept = [*keep, "_labels", "_decoded"]
    done = encode(top, "_left", [last], kept)
    zero = F.array(F.lit(0))
    rest = left.where(~(F.coalesce(F.col(importance) >= cut, F.lit(False))))
    norm = F.sqrt(F.aggregate("_left", F.lit(0.0), lambda s, v: s + v * v))
    rest = rest.select(*kept, zero.alias("labels"), F.transform("_left", lambda v: v * 0).alias("decoded"), norm.alias("error"))
    both = done.unionByName(rest)
    return both.select(*keep, F.concat("_labels", "labels").alias("labels"), F.zip_with("_decoded", "decoded", lambda a, b: a + b).alias("decoded"), "error")
