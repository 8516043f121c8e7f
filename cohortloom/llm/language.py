"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its features, which are hashed: the
three-byte piece around every letter byte (with the word's borders as blanks)
and every whole word. Embeddings and the softmax layer are trained together by
stochastic gradient descent in numpy on a bounded sample. As the model is
linear in the average, scoring adds one row of class weights per feature.

A temperature is fitted on held-back rows of the sample so that the score is a
probability; the rejection threshold is the confidence that all but a share
`alpha` of the correctly labelled held-back rows reach.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from cohortloom.llm.blocks import (
    LOWER,
    PUNCTUATION,
    Block,
    blocks,
    bounded_batches,
    counts_per_text,
    slices,
    span_hashes,
    word_spans,
)

UNKNOWN = "und"
PIECE_BITS = 15
WORD_BITS = 16
_ROWS = (1 << PIECE_BITS) + (1 << WORD_BITS)
_NOT_LETTER = PUNCTUATION.copy()
_NOT_LETTER[48:58] = True


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # class weights of every hashed feature
    bias: np.ndarray
    temperature: float
    threshold: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts: pieces and words, with the counts of each per text."""
    low = LOWER[data]
    apart = _NOT_LETTER[low]
    low[apart] = 32
    at = np.flatnonzero(~apart)
    padded = np.concatenate(([np.uint8(32)], low)).astype(np.uint32)
    piece = padded[at] | padded[at + 1] << np.uint32(8)
    piece |= (padded[np.minimum(at + 2, len(low))] << np.uint32(16))
    pieces = (piece * np.uint32(2654435761)) >> np.uint32(32 - PIECE_BITS)
    starts, ends = word_spans(low)
    words = (span_hashes(low, starts, ends) >> np.uint64(64 - WORD_BITS)) + np.uint64(1 << PIECE_BITS)
    return (
        np.concatenate((pieces.astype(np.int64), words.astype(np.int64))),
        counts_per_text(offsets, at),
        counts_per_text(offsets, starts),
    )


def _summed(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of none is zero."""
    out = np.zeros((len(counts), rows.shape[1]))
    full = counts > 0
    if full.any():
        begins = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(rows, begins, axis=0)
    return out


def _averages(table: np.ndarray, found, n_pieces: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    cut = int(n_pieces.sum())
    total = _summed(table[found[:cut]], n_pieces) + _summed(table[found[cut:]], n_words)
    return total / np.maximum(n_pieces + n_words, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    sample: pa.Table,
    dim: int = 16,
    epochs: int = 12,
    rate: float = 8.0,
    batch: int = 16,
    held_back: float = 0.2,
    alpha: float = 0.002,
    max_threshold: float = 0.5,
    seed: int = 11,
) -> LanguageModel:
    """Fit a model on a sample with the columns label and text.

    An empty sample gives a model without labels, which answers `und` for all.
    With one label every text with letters gets it.
    """
    names = sample.column("label").to_pylist()
    labels = sorted(set(names))
    if not labels:
        return LanguageModel([], np.zeros((_ROWS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    wanted = np.array([labels.index(x) for x in names])
    bags = []
    for _, data, offsets in slices(sample.column("text").combine_chunks()):
        found, n_pieces, n_words = features(data, offsets)
        pieces = np.split(found[: n_pieces.sum()], np.cumsum(n_pieces)[:-1])
        words = np.split(found[n_pieces.sum() :], np.cumsum(n_words)[:-1])
        for own in map(np.concatenate, zip(pieces, words, strict=True)):
            ids, n = np.unique(own, return_counts=True)
            bags.append((ids.astype(np.int32), (n / max(len(own), 1)).astype(np.float32)))
    order = rng.permutation(len(names))
    n_back = int(len(names) * held_back) if len(names) >= 10 else 0
    back, fit = order[:n_back], order[n_back:]
    emb = rng.normal(0, 0.1, (_ROWS, dim)).astype(np.float32)
    out = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)

    def average(rows):
        n = np.array([len(bags[i][0]) for i in rows])
        ids = np.concatenate([bags[i][0] for i in rows])
        weight = np.concatenate([bags[i][1] for i in rows])
        return ids, weight, n, _summed(emb[ids] * weight[:, None], n).astype(np.float32)

    steps = max(1, epochs * ((len(fit) + batch - 1) // batch))
    step = 0
    for _ in range(epochs):
        for start in range(0, len(fit), batch):
            rows = rng.permutation(fit)[:batch] if start == 0 else fit[start : start + batch]
            pace = rate * (1 - step / steps)
            step += 1
            ids, weight, n, hidden = average(rows)
            error = _softmax(hidden @ out + bias).astype(np.float32)
            error[np.arange(len(rows)), wanted[rows]] -= 1
            error /= len(rows)
            back_to = error @ out.T
            out -= pace * hidden.T @ error
            bias -= 0.1 * pace * error.sum(axis=0)
            np.subtract.at(emb, ids, pace * weight[:, None] * np.repeat(back_to, n, axis=0))
        rng.shuffle(fit)

    temperature, threshold = 1.0, 0.0
    if n_back:
        logits = average(back)[3] @ out + bias
        true = wanted[back]
        grid = np.geomspace(0.1, 10, 41)
        loss = [-np.log(_softmax(logits / t)[np.arange(n_back), true] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        sure = _softmax(logits / temperature)
        right = sure.argmax(axis=1) == true
        if right.any():
            threshold = min(max_threshold, float(np.quantile(sure.max(axis=1)[right], alpha)))
    return LanguageModel(labels, (emb @ out).astype(np.float32), bias, temperature, threshold)


def probabilities(model: LanguageModel, block: Block) -> np.ndarray:
    """Calibrated class probabilities of every text of a block."""
    found, n_pieces, n_words = features(block.data, block.offsets)
    logits = _averages(model.table, found, n_pieces, n_words) + model.bias
    return _softmax(logits / model.temperature)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    keep: Sequence[str] | None = None,
    names: tuple[str, str, str] = ("lang_pred", "score", "accepted"),
) -> DataFrame:
    """The columns `keep` of docs (all by default) with the predicted language.

    `names` are the result columns: the label, its probability, and whether the
    probability reaches the model's threshold. A NULL text or one without a
    letter gets `und`, 0.0 and false. Columns of docs with the names of the
    results are replaced. Repeated rows stay; an empty table gives none. No
    shuffle; texts are read whole, in blocks.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    taken = docs.select(
        *kept,
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__lettered"),
        F.col(text).alias("__text"),
    )
    fields = [taken.schema[c] for c in kept] + [
        StructField(names[0], StringType()),
        StructField(names[1], DoubleType()),
        StructField(names[2], BooleanType()),
    ]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        labels = np.array([*model.labels, UNKNOWN], dtype=object)
        for block in blocks(batches, "__text"):
            rows = block.rows
            known = rows.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            known &= bool(model.labels)
            best = np.full(len(block), len(model.labels))
            score = np.zeros(len(block))
            if known.any():
                sure = probabilities(model, block)
                best = np.where(known, sure.argmax(axis=1), best)
                score = np.where(known, sure.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(i) for i in range(len(kept))),
                    pa.array(labels[best], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(known & (score >= model.threshold)),
                ],
                [*kept, *names],
            )

    return taken.mapInArrow(predict, StructType(fields))
