"""Quality classifier from weak labels.

Eight heuristic labellers look at a text's bytes and words and each vote good, bad or nothing. All documents' vote
patterns are counted (a partial aggregate; there are at most 3**8 patterns), and expectation-maximisation estimates how
often each labeller votes what on good and on bad texts, and with that the posterior of each pattern, without
any given labels. Posterior labels of a bounded sample, ``sample`` documents with the least hashes of id and text, then train
a linear scorer over hashed features (byte trigrams, and word forms with repetition), which scores every whole text. Of a
sampled text longer than ``piece`` characters, a piece of that length from a place that its hash names is a training text
of its own, voted on as such, so long texts train the scorer too and the driver holds at most ``sample`` pieces.

Defined results: a null or empty text gets no votes and is scored by the scorer's bias; repeated rows are scored alike;
ids may be null; an empty table gives no rows; extra columns pass through ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import arrowtools
from quire.llm.words import mix, word_hash, words
from quire.session import ship, unused

#: Documents of the sample that trains the scorer, and the longest piece of each in characters. Defaults of ``sample`` and ``piece``.
SAMPLE, PIECE = 4000, 1 << 13
LABELLERS = 8
ABSTAIN, GOOD, BAD = 0, 1, 2
TABLE_BITS = 16  # features are 16-bit numbers
#: Features without weight that each text is held to have besides its own: a short text says little and stays near the bias.
SHRINK = 48
#: A document with a lower score is rejected: one must be four times as likely bad as good to go.
LEAST = 0.2
#: Bytes of text that are scored, and fitted, at once.
CHUNK, FITTED = 1 << 20, 1 << 18

#: Frequent words of four languages. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "der die das und ist von zu den mit für auf ein eine nicht sich des dem im als auch es an wie "
    "le la les de des et un une du en est que qui dans pour pas sur au par avec ce se sont plus "
    "el los las del y que en un una por con para su al lo como se no es más"
).split()

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*<>{}[]~^=+@\\_")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLASS = np.zeros(256, np.uint64)  # of a word's last byte: other, letter, symbol, !, . , digit
_CLASS[_LETTER] = 1
_CLASS[_SYMBOL] = 2
for _k, _c in enumerate(b"!.,|?;:"):
    _CLASS[_c] = 3 + _k
_CLASS[48:58] = 10
_stop: list[np.ndarray] = []


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many true values each text has."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def votes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, LABELLERS) votes."""
    if not _stop:
        _stop.append(np.sort(np.array([word_hash(w) for w in sorted(set(STOP_WORDS))], np.uint64)))
    w = words(data, at)
    n_bytes, n = np.diff(at), np.diff(w.first)
    letters, uppers = _per_text(_LETTER[data], at), _per_text(_UPPER[data], at)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    repeats = _per_text(again, w.first)
    own = np.unique(mix(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(w.doc[own], minlength=len(n))
    k = np.minimum(np.searchsorted(_stop[0], w.hash), len(_stop[0]) - 1)
    stops = _per_text(_stop[0][k] == w.hash, w.first)
    share = lambda x, y: x / np.maximum(y, 1)
    out = np.zeros((len(n), LABELLERS), np.int64)

    def vote(j: int, enough: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
        out[enough & good, j] = GOOD
        out[enough & bad, j] = BAD

    shout, symbols, again_share = share(uppers, letters), share(_per_text(_SYMBOL[data], at), n_bytes), share(repeats, n)
    rich, stop, pipes = share(distinct, np.sqrt(np.maximum(n, 1) * 60.0)), share(stops, n), share(_per_text(data == ord("|"), at), n)
    ends, calls = share(_per_text(data == ord("."), at), n), share(_per_text(data == ord("!"), at), n)
    # bad texts are bad in one way each: what looks for one fault says nothing where it finds none
    nothing = np.zeros(len(n), bool)
    vote(0, letters >= 20, nothing, shout > 0.5)
    vote(1, n_bytes >= 20, nothing, symbols > 0.04)
    vote(2, n >= 8, nothing, again_share > 0.2)
    vote(3, n >= 30, rich > 0.4, rich < 0.2)
    vote(4, n >= 25, stop > 0.15, stop < 0.04)
    vote(5, n >= 8, nothing, pipes > 0.1)
    vote(6, n >= 30, (ends > 0.02) & (ends < 0.35), (ends < 0.005) | (ends > 0.6))
    vote(7, n >= 8, nothing, calls > 0.2)
    return out


def pattern(votes_: np.ndarray) -> np.ndarray:
    """The votes as one number."""
    return votes_ @ (3 ** np.arange(LABELLERS))


def patterns(documents: DataFrame) -> DataFrame:
    """pattern of each document."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrowtools.slices(whole, "text", CHUNK):
                yield pa.RecordBatch.from_pydict({"pattern": pa.array(pattern(votes(*arrowtools.flat_utf8(batch.column("text")))), pa.int64())})

    return documents.select("text").mapInArrow(run, "pattern long")


def posteriors(seen: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(the probability that texts of each pattern are good, (2, LABELLERS, 3) chances of each vote on bad and good texts).

    Dawid and Skene's model: votes are independent given the class; it starts from most votes, with texts that nobody faults as good.
    """
    v = seen[:, None] // 3 ** np.arange(LABELLERS) % 3
    ayes, nays = (v == GOOD).sum(1), (v == BAD).sum(1)
    good = np.where(nays == 0, 0.9, np.where(nays >= np.maximum(ayes, 1), 0.1, 0.4))
    chance = np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        for c, p in enumerate((1 - good, good)):
            weight = p * counts
            for kind in (ABSTAIN, GOOD, BAD):
                chance[c, :, kind] = ((v == kind) * weight[:, None]).sum(0) + 0.5
            chance[c] /= chance[c].sum(1, keepdims=True)
        prior = np.clip((good * counts).sum() / max(counts.sum(), 1), 0.01, 0.99)
        log = [np.log(chance[c][np.arange(LABELLERS), v]).sum(1) for c in (0, 1)]
        before, good = good, 1 / (1 + np.exp(np.clip(np.log(1 - prior) + log[0] - np.log(prior) - log[1], -60, 60)))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good, chance


def posterior(pattern_: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """The probability that texts of these patterns are good, seen before or not."""
    v = pattern_[:, None] // 3 ** np.arange(LABELLERS) % 3
    bad, good = (np.log(chance[c][np.arange(LABELLERS), v]).sum(1) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(np.log(1 - prior) + bad - np.log(prior) - good, -60, 60)))


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two lists of hashed features, byte trigrams and word forms, each with where the texts' own begin."""
    wide = data.astype(np.uint32)
    grams = ((wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA6B + wide[2:] * 0xC2B2AE35) >> np.uint32(32 - TABLE_BITS)) if len(data) > 2 else np.zeros(0, np.uint32)
    count = np.maximum(np.diff(at) - 2, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    grams = grams[np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], count)]
    w = words(data, at)
    again = np.zeros(len(w.hash), np.uint64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    form = np.minimum(w.end - w.start, 15).astype(np.uint64) * 64 + _CLASS[data[w.end - 1]] * 4 + again * 2 + _UPPER[data[w.end - 1]] if len(w.hash) else np.zeros(0, np.uint64)
    return [(grams.astype(np.uint16), first), ((mix(form + np.uint64(7)) >> np.uint64(64 - TABLE_BITS)).astype(np.uint16), w.first)]


class Scorer:
    """Logistic regression on the mean weight of a text's features."""

    def __init__(self) -> None:
        self.weights = np.zeros((2, 1 << TABLE_BITS))
        self.bias = 0.0

    def margins(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(found[0][1]) - 1, self.bias)
        for table, (ids, first) in zip(self.weights, found, strict=True):
            total = np.concatenate(([0.0], np.cumsum(table[ids])))
            out += (total[first[1:]] - total[first[:-1]]) / (np.diff(first) + SHRINK)
        return out

    def fit(self, batches: list[list[tuple[np.ndarray, np.ndarray]]], target: np.ndarray, rounds: int = 60, rate: float = 0.3) -> None:
        """Adam on the cross entropy with the posteriors as targets; each batch of texts is small, so little is held at once."""
        n = max(len(target), 1)
        even = float(np.clip(target.mean(), 0.02, 0.98)) if len(target) else 0.5
        self.bias = np.log(even / (1 - even))  # what a text without features is held to be
        state = [np.zeros_like(self.weights), np.zeros_like(self.weights)]
        cuts = np.cumsum([0, *(len(found[0][1]) - 1 for found in batches)])
        for t in range(1, rounds + 1):
            grad = 1e-7 * self.weights
            for found, a, b in zip(batches, cuts[:-1], cuts[1:], strict=True):
                error = (1 / (1 + np.exp(-np.clip(self.margins(found), -30, 30))) - target[a:b]) / n
                for own, (ids, first) in zip(grad, found, strict=True):
                    own += np.bincount(ids, weights=np.repeat(error / (np.diff(first) + SHRINK), np.diff(first)), minlength=1 << TABLE_BITS)
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad * grad
            self.weights -= rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-12)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(features(*arrowtools.flat_utf8(column))), -30, 30)))


def trained(documents: DataFrame, *, sample: int = SAMPLE, piece: int = PIECE) -> Scorer:
    """The scorer for these documents; no labels are read."""
    counted = patterns(documents).groupBy("pattern").count().toPandas()  # 6,561 rows at most
    scorer = Scorer()
    if not len(counted):
        return scorer
    seen, counts = counted["pattern"].to_numpy(), counted["count"].to_numpy().astype(float)
    good, chance = posteriors(seen, counts)
    prior = float(np.clip((good * counts).sum() / counts.sum(), 0.01, 0.99))
    rows = documents.where(F.octet_length("text") > 0).select(F.xxhash64("doc_id", "text").alias("near"), "text")
    # hashes below this are at least twice the sample, but for chances of nothing, so the sort sees few rows
    rate = min(1.0, (2 * sample + 100) / counts.sum())
    rows = rows.where((F.col("near") / F.lit(2.0**64) + F.lit(0.5)) <= F.lit(rate)) if rate < 1 else rows
    start = F.pmod(F.xxhash64("near"), F.greatest(F.length("text") - (piece - 1), F.lit(1))).cast("int") + 1
    chosen = rows.select("near", F.substring("text", start, F.lit(piece)).alias("text")).orderBy("near", "text").limit(sample).select("text").toArrow()
    batches, target = [], []
    for whole in chosen.to_batches():
        for batch in arrowtools.slices(whole, "text", FITTED):
            data, at = arrowtools.flat_utf8(batch.column("text"))
            batches.append(features(data, at))
            target.append(posterior(pattern(votes(data, at)), prior, chance))
    if batches:  # else there is no text at all
        scorer.fit(batches, np.concatenate(target))
    return scorer


def scored(documents: DataFrame, scorer: Scorer, score: str = "score") -> DataFrame:
    """The documents' columns with ``score``, the probability that the text is good."""
    ship(documents.sparkSession)
    weights, bias = scorer.weights.astype(np.float32), scorer.bias
    shared = documents.sparkSession.sparkContext.broadcast((weights, bias))
    fields = [f for f in documents.schema.fields if f.name != score]
    names = [f.name for f in fields]
    kinds = type(documents.schema)(fields).add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer()
        own.weights, own.bias = shared.value
        for whole in batches:
            for batch in arrowtools.slices(whole, "text", CHUNK):
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(own.scores(batch.column("text")))], [*names, score])

    return documents.mapInArrow(run, kinds)


def judged(documents: DataFrame, *, least: float = LEAST, sample: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """doc_id, score, keep of every document."""
    thin = documents.select("doc_id", "text")
    return scored(thin, trained(thin, sample=sample, piece=piece)).select("doc_id", "score", (F.col("score") >= least).alias("keep"))


def accepted(documents: DataFrame, *, least: float = LEAST, sample: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """The documents that the scorer doesn't reject, with their columns."""
    name = unused("quality", documents)
    return scored(documents, trained(documents, sample=sample, piece=piece), name).where(F.col(name) >= least).drop(name)
