"""Quality scores from naive Bayes support vectors.

A text becomes a set of n-gram indicators: its lower-cased words, and n-grams of
word shapes, in which letters and digits fold to classes and a word that repeats
the one before it is marked, so that junk made of words never seen is known by
its pattern. Indicators are scaled by the class log-count ratios of naive Bayes
and a linear hinge-loss model is fitted on them by dual coordinate descent.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 20
#: At most so many labelled rows are fitted on; the bound of the training sample.
MAX_ROWS = 8_000
#: At most so many gram ids of them reach the driver: 64 MB.
MAX_GRAMS = 16_000_000
SHAPES = ((re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))
RUN = re.compile(r"(.)\1+")
REPEAT = "="
#: Entries after which a worker's cache of known grams starts anew.
CACHE = 1_000_000


def shape(word: str) -> str:
    """``Word,`` is ``Aa,``, ``HERE!!`` is ``A!!``, ``x12`` is ``a0``."""
    for pattern, code in SHAPES:
        word = pattern.sub(code, word)
    return RUN.sub(r"\1\1", word)


class _Shapes(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = shape(word)
        return found


def grams(text: str | None, shapes: dict[str, str]) -> set:
    """The indicators of a text: words, and uni-, bi- and trigrams of shapes."""
    words = (text or "").split()
    low = (text or "").lower().split()
    kinds = [shapes[w] for w in words]
    kinds[1:] = [REPEAT if a == b else k for a, b, k in zip(low, low[1:], kinds[1:])]
    found = set(low)
    found.update(zip(kinds), zip(kinds, kinds[1:]), zip(kinds, kinds[1:], kinds[2:]))
    return found


def gram_id(gram: str | tuple) -> int:
    name = gram if isinstance(gram, str) else "\x1f".join(("", *gram))
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - BITS)


@dataclass
class Model:
    """``margin = bias + sum(weights[g] for g in grams) / sqrt(number of grams)``."""

    weights: np.ndarray
    bias: float
    slope: float

    def probability(self, margin: float) -> float:
        z = self.slope * margin
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> Model:
    """Fit on each row's gram ids and 0/1 labels.

    The log-count ratio of gram g is ln((alpha + good texts with g) / their
    total) - the same for bad ones. Dual coordinate descent then solves the
    L1-loss support vector machine over the ratio-scaled indicators, with costs
    inverse to class sizes so that neither class is neglected. No rows or one
    class only give the constant model of the share of good rows, +-1 in margin.
    """
    size, y = 1 << BITS, np.where(labels == 1, 1.0, -1.0)
    if not len(rows) or len(set(y)) < 2:
        return Model(np.zeros(size, np.float32), 1.0 if len(rows) == 0 or y[0] > 0 else -1.0, 2.0)
    good = np.full(size, alpha)
    bad = np.full(size, alpha)
    for r, v in zip(rows, y, strict=True):
        (good if v > 0 else bad)[r] += 1
    seen = (good + bad) > 2 * alpha + 1.5  # a gram of one text says nothing about another
    ratio = np.where(seen, np.log(good / good.sum()) - np.log(bad / bad.sum()), 0.0)
    xs = [ratio[r] / math.sqrt(max(1, len(r))) for r in rows]
    norms = np.array([x @ x + 1.0 for x in xs])
    share = (y > 0).mean()
    upper = cost * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias, dual = np.zeros(size), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ xs[i] + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), upper[i])
            if step := new - dual[i]:
                w[rows[i]] += step * y[i] * xs[i]
                bias += step * y[i]
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model((w * ratio).astype(np.float32), float(bias), 2.0)


def _gram_ids(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in batches:
            ids = [sorted({gram_id(g) for g in grams(t.as_py(), shapes)}) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "label", "ids"])

    return docs.select("id", "label", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, label int, ids array<int>")


def learnable(doc_id: Column) -> Column:
    """Whether a document's label may be learnt from; the others are held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_grams: int = MAX_GRAMS) -> Model:
    """Fit on at most ``max_rows`` labelled rows that may be learnt from.

    The sample is the ``max_rows`` labelled ids of ``docs`` smallest by hash, the
    same on every run. Labels that are null or neither 0 nor 1, or of absent
    documents, and rows with a null id are left out; repeated labels count once,
    an id with both labels counts for each. Of an id that repeats in ``docs`` the
    text smallest by hash is learnt from, the whole of it. The driver gets
    ``max_grams`` gram ids at most, whole texts in the order of the sample.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & learnable(F.col("id")))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    present = known.distinct().join(texts.select("id").distinct(), "id", "left_semi")
    place = [F.xxhash64("id"), F.col("id"), F.col("label")]
    sample = present.orderBy(*place).limit(max_rows)
    # A row for each sampled id and label, however often the id repeats.
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    grams_of = stage(_gram_ids(one), "grams")
    upto = F.sum(F.size("ids")).over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    kept = grams_of.select("id", "label", upto.alias("upto")).where(F.col("upto") <= max_grams).select("id", "label")  # max_rows rows at most
    found = grams_of.join(F.broadcast(kept), ["id", "label"]).toArrow()
    ids, ends = found.column("ids").combine_chunks(), found.column("label").to_numpy()
    rows = [np.asarray(x.values, np.int64) if len(x) else np.empty(0, np.int64) for x in ids]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), int(ends[i])))
    return fit([rows[i] for i in order], np.array([ends[i] for i in order]))


class Scorer:
    """Scores texts one by one; keeps what it learnt about shapes and grams, within bounds."""

    def __init__(self, model: Model) -> None:
        self.model, self.shapes, self.known = model, _Shapes(), {}

    def __call__(self, text: str | None) -> float:
        found = grams(text, self.shapes)
        if not found:
            return self.model.probability(self.model.bias)
        known, weights = self.known, self.model.weights
        if len(known) > CACHE:
            known.clear()
        parts = []
        for g in found:
            w = known.get(g)
            if w is None:
                w = known[g] = float(weights[gram_id(g)])
            parts.append(w)
        return self.model.probability(self.model.bias + math.fsum(parts) / math.sqrt(len(found)))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    ``score`` is in 0 to 1, higher where label 1 is likelier, and depends on the
    whole text alone; null, empty and white-space texts all get the score of no
    indicators. ``predicted`` is 1 from 0.5 on. ``held_out`` is false for a null
    id. Repeated rows stay; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    held = F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns unchanged.

    Scores are made in the tasks that read the rows; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) >= least for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
