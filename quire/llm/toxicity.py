"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of ASCII letters and digits and of all other characters beyond ASCII, in lower case for A-Z. The labels
are of documents, so token labels come first: a token form, or a word beginning of 3 to 6 bytes, that training documents
marked toxic have far more often than the others marks its tokens in toxic documents. On these labelled tokens a
conditional random field with two states learns weights for hashed token features (the form and its beginnings), for
the state and for the transitions, by gradient ascent on the likelihood with forward-backward expectations.

Scoring runs forward-backward over whole texts: long ones are cut into chunks whose transfer matrices are chained, so the
marginals are those of the whole sequence. Tokens with a marginal of at least one half make the spans; a document's score is a
logistic function of its largest marginal and of the summed ones, fitted on the training documents.

Fitting takes up to ``sample`` labelled documents of each label, those with the least hashes of doc_id; of them the texts of at
most ``longest`` bytes mark forms, and ``fitted`` of each label train the field. Nothing but texts and labels goes in.

Defined results: a null or empty text has no tokens and the score of that; labels that are null or other than 0 and 1 are
left out, repeated ones count once with the largest; with no usable label of either kind every score is 0; a null doc_id is
not held out; repeated rows are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import arrowtools
from quire.llm.words import words
from quire.session import ship

#: Toxic and other documents of the sample, the part of each that trains the field, and the longest text among them. Defaults of ``sample``, ``fitted`` and ``longest``.
SAMPLE, FITTED, SAMPLE_BYTES = (1500, 4500), 800, 1 << 14
HEADS = (3, 4, 5, 6)
TABLE_BITS = 18
#: A form marks tokens if this share of the documents that have it are toxic (sample sizes evened out) and the log-likelihood ratio against chance is this large.
LEAST_SHARE, LEAST_RATIO = 0.95, 16.0
CHUNK, STEPS = 4 << 20, 256

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


class Tokens(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # where each text's tokens begin
    features: np.ndarray  # (tokens, 5) hashes: the form, then its beginnings


def tokens(column: pa.Array) -> Tokens:
    data, at = arrowtools.flat_utf8(column)
    w, heads = words(data, at, _GAP, HEADS)
    return Tokens(w.start, w.end, w.first, np.column_stack([w.hash, *heads]))


def slots(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Model(NamedTuple):
    weights: np.ndarray  # of the toxic state; the other's are 0
    bias: float
    move: np.ndarray  # (2, 2) weights of transitions
    score: np.ndarray  # bias, weight of the largest marginal's logit, weight of the marginals' sum (log1p)


def _spread(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of up to STEPS tokens: (first token, length, text)."""
    n = np.diff(first)
    parts = -(-n // STEPS)
    text = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)
    begin = first[:-1][text] + k * STEPS
    return begin, np.minimum(STEPS, first[1:][text] - begin), text


def marginals(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the probability of the toxic state, and the forward and backward ratios of its states.

    odds: exp of the tokens' weights; move: exp of the transitions'. Every chunk's 2x2 transfer matrix is computed at once, step by
    step; then the texts' chunks are chained, and each chunk is run again from its true beginning and end.
    """
    forward, backward = np.empty(len(odds)), np.empty(len(odds))
    if not len(odds):
        return forward, forward, backward
    begin, length, text = _spread(odds, first)
    order = np.argsort(-length, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    size = length[order]
    active = [int(np.searchsorted(-size, -s, "left")) for s in range(STEPS)]  # chunks with over s tokens
    base = begin[order]
    (a, b), (c, d) = move
    # rows: the state before the chunk; columns: the state at its last token
    m = np.zeros((2, 2, len(base)))
    m[0, 0] = m[1, 1] = 1
    for s in range(STEPS):
        k = active[s]
        if not k:
            break
        e = odds[base[:k] + s]
        x, y = m[:, 0, :k], m[:, 1, :k]
        new = x * b + y * d
        m[:, 0, :k], m[:, 1, :k] = x * a + y * c, new * e
        if s % 8 == 7:
            m[:, :, :k] /= m[:, :, :k].sum((0, 1))
    m /= m.sum((0, 1))
    # chain the chunks of each text, all texts at once; the state before a text is 0
    new_text = np.concatenate(([True], text[1:] != text[:-1]))
    position = np.arange(len(text)) - np.maximum.accumulate(np.where(new_text, np.arange(len(text)), 0))
    by_position = np.argsort(position, kind="stable")
    cuts = np.searchsorted(position[by_position], np.arange(position.max() + 2))
    before = np.zeros((2, len(text)))
    before[0] = 1
    after = np.ones((2, len(text)))
    after /= 2
    for p in range(1, len(cuts) - 1):
        k = by_position[cuts[p] : cuts[p + 1]]
        t = m[:, :, rank[k - 1]]
        v = (before[:, None, k - 1] * t).sum(0)
        before[:, k] = v / v.sum(0)
    for p in range(len(cuts) - 2, 0, -1):
        k = by_position[cuts[p] : cuts[p + 1]]
        t = m[:, :, rank[k]]
        v = (t * after[None, :, k]).sum(1)
        after[:, k - 1] = v / v.sum(0)
    v0, v1 = before[:, order].copy()
    for s in range(STEPS):
        k = active[s]
        if not k:
            break
        at = base[:k] + s
        x, y = v0[:k] * a + v1[:k] * c, (v0[:k] * b + v1[:k] * d) * odds[at]
        total = x + y
        v0[:k], v1[:k] = x / total, y / total
        forward[at] = y / x
    v0, v1 = after[:, order].copy()
    for s in range(STEPS - 1, -1, -1):
        k = active[s]
        if not k:
            continue
        at = base[:k] + s
        backward[at] = v1[:k] / v0[:k]
        e = v1[:k] * odds[at]
        x, y = v0[:k] * a + e * b, v0[:k] * c + e * d
        total = x + y
        v0[:k], v1[:k] = x / total, y / total
    ratio = forward * backward
    return ratio / (1 + ratio), forward, backward


def weak_labels(found: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of the sample are labelled toxic."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    doc = np.repeat(np.arange(len(toxic)), np.diff(found.first))
    marked = np.zeros(len(doc), bool)
    for column in found.features.T:
        value, number = np.unique(column, return_inverse=True)
        pairs = np.unique(number.astype(np.int64) * len(toxic) + doc)
        in_toxic = toxic[pairs % len(toxic)]
        df1 = np.bincount(pairs // len(toxic), weights=in_toxic, minlength=len(value))
        df0 = np.bincount(pairs // len(toxic), weights=~in_toxic, minlength=len(value))
        share = (df1 / n1) / (df1 / n1 + df0 / n0 + 1e-12)
        part = n1 / (n1 + n0)
        ratio = 2 * (df1 * np.log(np.maximum(df1, 1e-9) / ((df1 + df0) * part)) + df0 * np.log(np.maximum(df0, 1e-9) / ((df1 + df0) * (1 - part))))
        marked |= ((share >= LEAST_SHARE) & (ratio >= LEAST_RATIO))[number]
    return marked & toxic[doc]


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 3): 1, the logit of the largest marginal, log1p of the summed marginals."""
    n = len(first) - 1
    out = np.ones((n, 3))
    some = np.diff(first) > 0
    top = np.zeros(n)
    if some.any():
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    total = np.concatenate(([0.0], np.cumsum(p)))
    top = np.clip(top, 1e-4, 1 - 1e-4)
    out[:, 1], out[:, 2] = np.log(top / (1 - top)), np.log1p(total[first[1:]] - total[first[:-1]])
    return out


def fit(column: pa.Array, toxic: np.ndarray, rounds: int = 40, rate: float = 0.5, *, fitted: int = FITTED) -> Model:
    """The model for a sample of texts and their labels."""
    found = tokens(column)
    marked = weak_labels(found, toxic)
    chosen = np.sort(np.concatenate([np.flatnonzero(toxic)[:fitted], np.flatnonzero(~toxic)[:fitted]]))
    toxic = toxic[chosen]
    own = np.concatenate([np.arange(found.first[d], found.first[d + 1]) for d in chosen])
    count = np.diff(found.first)[chosen]
    found = Tokens(found.start[own], found.end[own], np.concatenate(([0], np.cumsum(count))), found.features[own])
    slot, target = slots(found.features), marked[own].astype(float)
    size = 1 << TABLE_BITS
    weights, bias, move = np.zeros(size), -3.0, np.zeros((2, 2))
    state = [np.zeros(size), np.zeros(size), np.zeros(5), np.zeros(5)]
    inner = np.ones(len(target), bool)  # tokens with one before them
    inner[found.first[:-1][np.diff(found.first) > 0]] = False
    two = np.flatnonzero(inner)
    # the state before a text counts as 0
    seen = np.array([[((1 - target[two - 1]) * (1 - target[two])).sum(), ((1 - target[two - 1]) * target[two]).sum()], [(target[two - 1] * (1 - target[two])).sum(), (target[two - 1] * target[two]).sum()]])
    n = max(len(target), 1)
    for t in range(1, rounds + 1):
        odds, steps = np.exp(np.clip(weights[slot].sum(1) + bias, -30, 30)), np.exp(move)
        p, forward, backward = marginals(odds, found.first, steps)
        x = odds[two] * backward[two]
        f = forward[two - 1]
        joint = np.array([[np.full(len(two), steps[0, 0]), steps[0, 1] * x], [f * steps[1, 0], f * steps[1, 1] * x]])
        expected = (joint / joint.sum((0, 1))).sum(2)
        gap = p - target
        grad = np.bincount(slot.ravel(), weights=np.repeat(gap, slot.shape[1]), minlength=size) / n + 1e-7 * weights
        rest = np.append(((expected - seen) / n).ravel(), gap.sum() / n)
        for k, g in ((0, grad), (2, rest)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            step = rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 1] / (1 - 0.99**t)) + 1e-10)
            if k == 0:
                weights -= step
            else:
                move -= 0.3 * step[:4].reshape(2, 2)
                bias -= 0.3 * step[4]
    p = marginals(np.exp(np.clip(weights[slot].sum(1) + bias, -30, 30)), found.first, np.exp(move))[0]
    x, score = summary(p, found.first), np.zeros(3)
    weigh = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    for _ in range(25):  # Newton's method, slightly regularised
        q = 1 / (1 + np.exp(-np.clip(x @ score, -30, 30)))
        hessian = (x * (weigh * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(3)
        score -= np.linalg.solve(hessian, x.T @ (weigh * (q - toxic)) + 1e-4 * score)
    return Model(weights.astype(np.float32), bias, move, score)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(documents: DataFrame, labels: DataFrame, label: str = "toxic", *, sample: tuple[int, int] = SAMPLE, fitted: int = FITTED, longest: int = SAMPLE_BYTES) -> Model | None:
    """The model from the rows that aren't held out; None without labels of both kinds."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_label"))
    near = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("_label") == k).orderBy(near, "doc_id").limit(n) for k, n in ((1, sample[0]), (0, sample[1]))]
    chosen = chosen[0].unionByName(chosen[1])  # as many rows as sample says at most
    rows = documents.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id").orderBy(near, "doc_id").limit(2 * sum(sample)).select("text", "_label").toArrow()
    toxic = np.asarray(rows.column("_label").combine_chunks() if rows.num_rows else [], dtype=np.int64) == 1
    if not toxic.any() or toxic.all():
        return None
    return fit(rows.column("text").combine_chunks(), toxic, fitted=fitted)


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, span_starts, span_ends (runs of toxic tokens, in bytes of the text)."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in arrowtools.slices(whole, "text", CHUNK):
                n = batch.num_rows
                starts, ends = [[] for _ in range(n)], [[] for _ in range(n)]
                score = np.zeros(n)
                if own is not None:
                    column = batch.column("text")
                    found = tokens(column)
                    slot = slots(found.features)
                    total = np.full(len(slot), own.bias)
                    for k in range(slot.shape[1]):
                        total += own.weights[slot[:, k]]
                    p = marginals(np.exp(np.clip(total, -30, 30)), found.first, np.exp(own.move))[0]
                    score = 1 / (1 + np.exp(-np.clip(summary(p, found.first) @ own.score, -30, 30)))
                    _, at = arrowtools.flat_utf8(column)
                    bad = np.flatnonzero(p >= 0.5)
                    doc = np.searchsorted(found.first, bad, "right") - 1
                    last = (-1, -1)
                    for t, d in zip(bad.tolist(), doc.tolist(), strict=True):
                        if last == (d, t - 1):
                            ends[d][-1] = int(found.end[t] - at[d])
                        else:
                            starts[d].append(int(found.start[t] - at[d]))
                            ends[d].append(int(found.end[t] - at[d]))
                        last = (d, t)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(starts, kind), pa.array(ends, kind)], ["doc_id", "score", "span_starts", "span_ends"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, span_starts array<long>, span_ends array<long>")


def judged(documents: DataFrame, labels: DataFrame, label: str = "toxic", *, least: float = 0.5, sample: tuple[int, int] = SAMPLE, fitted: int = FITTED, longest: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans of every document."""
    out = scored(documents, trained(documents, labels, label, sample=sample, fitted=fitted, longest=longest))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), F.size("span_starts").alias("n_spans"))
