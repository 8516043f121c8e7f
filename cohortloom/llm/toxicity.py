"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features (whole words and word beginnings
of 3 to 7 bytes, present or not) is trained in numpy from confirmed toxic texts
and unlabelled ones. With class prior p, positives P and unlabelled U the risk is

    p * mean_P(loss as toxic) + max(0, mean_U(loss as clean) - p * mean_P(loss as clean))

whose second part estimates the risk on clean texts; when it falls below zero
the model has started to fit the unlabelled texts one by one, and the step goes
against that part instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortloom.llm.blocks import (
    LOWER,
    PUNCTUATION,
    blocks,
    bounded_batches,
    mix,
    slices,
    span_hashes,
    word_spans,
)

BITS = 20
BEGINNINGS = (3, 4, 5, 6, 7)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one per hashed feature, float32
    bias: float
    scale: float
    shift: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of every text, and the text of each, ascending."""
    low = LOWER[data]
    starts, ends = word_spans(low, PUNCTUATION)
    owner = np.searchsorted(offsets, starts, "right") - 1
    # Words are made distinct per text first, then cut into beginnings.
    words = span_hashes(low, starts, ends)
    key = mix(words ^ mix(owner.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    starts, ends, owner, words = starts[first], ends[first], owner[first], words[first]
    numbers = [words >> np.uint64(64 - BITS)]
    owners = [owner]
    for n in BEGINNINGS:
        long = ends - starts > n
        part = span_hashes(low, starts[long], starts[long] + n)
        numbers.append(mix(part + np.uint64(n)) >> np.uint64(64 - BITS))
        owners.append(owner[long])
    both = np.concatenate(owners).astype(np.int64) << BITS | np.concatenate(numbers).astype(np.int64)
    both = np.unique(both)
    return both & ((1 << BITS) - 1), both >> BITS


def sample_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`features` of a sample, made a few texts at a time."""
    numbers, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for start, data, offsets in slices(texts):
        number, owner = features(data, offsets)
        numbers.append(number.astype(np.int32))
        owners.append((owner + start).astype(np.int32))
    return np.concatenate(numbers), np.concatenate(owners)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _logits(weights, bias, numbers, owners, n):
    return np.bincount(owners, weights[numbers], minlength=n) + bias


def screened(p_num: np.ndarray, u_num: np.ndarray, n_p: int, n_u: int, least: float) -> np.ndarray:
    """Features whose share of texts differs between the two sets by `least` standard errors."""
    in_p = np.bincount(p_num, minlength=1 << BITS)
    in_u = np.bincount(u_num, minlength=1 << BITS)
    share = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    away = np.abs(in_p / n_p - in_u / n_u) / np.maximum(error, 1e-12)
    return np.flatnonzero((in_p + in_u >= 3) & (away >= least))


def train(
    positive: pa.Array,
    unlabelled: pa.Array,
    prior: float,
    checked: tuple[pa.Array, np.ndarray] | None = None,
    steps: int = 400,
    rate: float = 0.1,
    decay: float = 1e-4,
    least: float = 5.0,
) -> ToxicityModel:
    """Fit on texts known to be toxic and on unlabelled texts.

    Only features that pass `screened` get a weight. `checked` are texts with
    known labels on which the logit is mapped to a probability (two parameters,
    weighted to the prior). Without positives or unlabelled texts every text
    scores the prior.
    """
    start = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return ToxicityModel(np.zeros(1 << BITS, np.float32), start, 1.0, 0.0)
    n_p, n_u = len(positive), len(unlabelled)
    p_num, p_own = sample_features(positive)
    u_num, u_own = sample_features(unlabelled)
    used = screened(p_num, u_num, n_p, n_u, least)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))

    def narrowed(num, own):
        at = place[num]
        return at[at >= 0], own[at >= 0]

    p_num, p_own = narrowed(p_num, p_own)
    u_num, u_own = narrowed(u_num, u_own)
    w, b = np.zeros(len(used)), start
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        g_p = _logits(w, b, p_num, p_own, n_p)
        g_u = _logits(w, b, u_num, u_own, n_u)
        s_p, s_u = _sigmoid(g_p), _sigmoid(g_u)
        clean_risk = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        if clean_risk >= 0:
            d_p = prior * (s_p - 1) / n_p - prior * s_p / n_p
            d_u = s_u / n_u
        else:
            d_p, d_u = prior * s_p / n_p, -s_u / n_u
        grad = np.bincount(p_num, d_p[p_own], minlength=len(used))
        grad += np.bincount(u_num, d_u[u_own], minlength=len(used))
        grad = np.append(grad + decay * w, d_p.sum() + d_u.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        pace = rate * (1 - t / (steps + 1))
        move = pace * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    scale, shift = 1.0, 0.0
    if checked is not None and len(checked[0]) and 0 < checked[1].sum() < len(checked[1]):
        num, own = sample_features(checked[0])
        logit = _logits(weights, b, num, own, len(checked[0]))
        scale, shift = _calibrate(logit, checked[1], prior)
    return ToxicityModel(weights, float(b), scale, shift)


def _calibrate(logit: np.ndarray, truth: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of the logit by Newton steps on a smoothed, weighted logistic loss."""
    n1, n0 = truth.sum(), (1 - truth).sum()
    goal = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = len(truth) * np.where(truth == 1, prior / n1, (1 - prior) / n0)
    centre, spread = logit.mean(), logit.std() + 1e-9
    x = np.stack(((logit - centre) / spread, np.ones_like(logit)))
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        s = _sigmoid(theta @ x)
        grad = x @ (weight * (s - goal)) + 1e-3 * theta
        hess = (x * (weight * s * (1 - s))) @ x.T + 1e-3 * np.eye(2)
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        theta = theta - move
        if np.abs(move).max() < 1e-6:
            break
    scale = max(theta[0] / spread, 1e-6)
    return float(scale), float(theta[1] - scale * centre)


def toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    text: str = "text",
    keep: Sequence[str] | None = None,
    name: str = "score",
) -> DataFrame:
    """The columns `keep` of docs (all by default) with the toxicity of the whole text, 0 to 1.

    NULL and empty texts get the score of a text without features. A column of
    docs with the result's name is replaced. Repeated rows stay. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    taken = docs.select(*kept, F.col(text).alias("__text"))
    schema = StructType([*(taken.schema[c] for c in kept), StructField(name, DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for block in blocks(batches, "__text"):
            numbers, owners = features(block.data, block.offsets)
            logit = _logits(model.weights, model.bias, numbers, owners, len(block))
            found = _sigmoid(model.scale * logit + model.shift)
            yield pa.RecordBatch.from_arrays(
                [*(block.rows.column(i) for i in range(len(kept))), pa.array(found)],
                [*kept, name],
            )

    return taken.mapInArrow(score, schema)
