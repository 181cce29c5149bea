"""Toxicity by compression distance with two Zstandard dictionaries.

One dictionary is trained on windows of ordinary texts, one on windows of toxic texts;
of the second, the segments are kept that stand in a far larger share of toxic than of
ordinary training texts, and it is laid behind the first.  A window's gain is the number
of bytes by which the toxic dictionary compresses it better.  A document is described by
how many of its windows gain at least each of ``GAINS`` bytes, by its largest gain and by
its number of windows; weights that turn these into a probability are fitted on
training texts that the dictionaries have not seen.  How sure a segment must be
(``FALSE_RATES``, ``CONTRASTS``) is chosen on these texts as well, by the loss of each
third of them under weights fitted on the others; rows held out from training are never read.

Training uses a bounded sample: of each label at most ``TRAIN_DOCS`` labelled rows of at
most ``TRAIN_BYTES`` bytes, the ones with the smallest hashes; the dictionaries see all windows of two thirds of them.  The labels of all training rows
are counted, and the fit weighs the sampled rows so that each label has the share it has
among them all, whatever the size of the sample.  Scoring is row-wise over
every whole text with a broadcast model of a few kilobytes.

Defined cases: a null or empty text has no windows and gets the score of none; texts that
are labelled twice train twice; without labels of both kinds every score is the share of
toxic ones, or 0; further columns pass through, those named as an added column give way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import exp, lgamma, log

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrow import add_columns

TRAIN_DOCS, TRAIN_BYTES = 6000, 1 << 15
WINDOW_WORDS = 5
SHARED_BYTES, TOXIC_BYTES = 8192, 1 << 18
#: A toxic segment has so many different neighbourhoods in toxic texts at least (near copies of a text share theirs), for each
#: toxic text so many times as many as for each ordinary one, and with this rate of false ones among the kept it is no chance.
LEAST, CONTRASTS, FALSE_RATES = 3, (30, 10), (0.01, 0.05)
FOLDS = 3
SEGMENT = re.compile(rb"[^ ]{4,24}(?= )")
LEVEL, MIN_MATCH = 6, 6
#: Bytes known to both dictionaries that precede a window, so that the first match of its own counts in full.
PREAMBLE = 48
GAINS = (2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3
HELD_OUT = 2


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    words = (text or "").split()
    return [b" " + " ".join(words[i:i + WINDOW_WORDS]).encode() + b" " for i in range(0, len(words), WINDOW_WORDS)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; of few samples, themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0,
        write_dict_id=0)
    known.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None
    rate: float = 0.0
    _pair: tuple = field(default=(), repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_pair": ()}

    def features(self, text: str | None) -> list[float]:
        if not self._pair:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        one, other = (c.compress for c in self._pair)
        lead = self.ordinary[:PREAMBLE]
        gains = np.array([len(one(w)) - len(other(w)) for w in (lead + x for x in windows(text))] or [0])
        return [1.0, float(np.clip(gains.max(), 0, 16)), float(np.log1p(len(gains))),
                *(float(np.log1p((gains >= g).sum())) for g in GAINS)]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.rate
        return float(1 / (1 + np.exp(-np.dot(self.weights, self.features(text)))))


def _fit_weights(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (row_weights * (y - p)) - ridge * w
        curve = (x * (row_weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def _chance(toxic: int, ordinary: int, share: float) -> float:
    """Probability of so many toxic ones or more out of all, if each is toxic with probability ``share``."""
    n = toxic + ordinary
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)
            for k in range(toxic, n + 1)]
    return min(1.0, sum(map(exp, logs)))


def _bound(chances: list[float], tests: int, false_rate: float) -> float:
    """The largest of the ascending probabilities that keeps the rate of false ones (Benjamini and Hochberg)."""
    return max((p for i, p in enumerate(chances, 1) if p <= false_rate * i / tests), default=0.0)


def _loss(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray) -> float:
    """Logarithmic loss of each row under weights fitted on the folds without it."""
    fold, loss = np.arange(len(y)) % FOLDS, 0.0
    for k in range(FOLDS):
        out = fold == k
        p = 1 / (1 + np.exp(-np.clip(x[out] @ _fit_weights(x[~out], y[~out], row_weights[~out]), -30, 30)))
        loss -= float((row_weights[out] * np.log(np.where(y[out] > 0, p, 1 - p) + 1e-15)).sum())
    return loss


def fit(rows: list[tuple[str, int]], counts: tuple[int, int] | None = None) -> Model:
    """A model of (text, label) rows; every third row only fits the weights.  ``counts`` are
    the numbers of ordinary and toxic rows that the rows are drawn from, if not they themselves."""
    drawn = [sum(label == y for _, label in rows) for y in (0, 1)]
    true = counts if counts and all(counts) else drawn
    model = Model(rate=true[1] / sum(true) if all(drawn) else float(drawn[1] > 0))
    learn = [r for i, r in enumerate(rows) if i % 3]
    if len({y for _, y in learn}) < 2:
        return model
    parts = {y: [t for t, label in learn if label == y] for y in (0, 1)}
    model.ordinary = _dictionary([w for t in parts[0] for w in windows(t)], SHARED_BYTES * 4 // 3)[-SHARED_BYTES:]
    found = sorted(set(SEGMENT.findall(_dictionary([w for t in parts[1] for w in windows(t)], TOXIC_BYTES))))
    known, share = set(found), {}
    for y, texts in parts.items():
        places: dict[bytes, set] = {}
        for t in texts:
            words = [b"", *t.encode().split(), b""]
            for i in range(1, len(words) - 1):
                if words[i] in known:
                    places.setdefault(words[i], set()).add((words[i - 1], words[i + 1]))
        share[y] = {s: len(p) for s, p in places.items()}
    n1, n0 = len(parts[1]), len(parts[0])
    chance = {s: _chance(c, share[0].get(s, 0), n1 / (n1 + n0)) for s, c in share[1].items() if c >= LEAST}
    held = [r for i, r in enumerate(rows) if not i % 3]
    y = np.array([label for _, label in held], dtype=float)
    row_weights = np.array([true[label] / sum(true) * len(rows) / drawn[label] for _, label in held])
    tried: dict[bytes, tuple[float, np.ndarray]] = {}
    for false_rate in FALSE_RATES:
        bound = _bound(sorted(chance.values()), len(found), false_rate)
        for contrast in CONTRASTS:
            # the most frequent segments come last, where a match costs least
            kept = sorted((share[1][s], s) for s, p in chance.items()
                          if p <= bound and share[1][s] / n1 > contrast * share[0].get(s, 0) / n0)
            toxic = model.ordinary + b" " + b"".join(s + b" " for _, s in kept)
            if toxic not in tried:
                x = np.array([Model(model.ordinary, toxic, _pair=own).features(t) for own in [
                    (_compressor(model.ordinary), _compressor(toxic))] for t, _ in held])
                tried[toxic] = _loss(x, y, row_weights), x
    model.toxic = min(tried, key=lambda t: tried[t][0])  # of equal ones the strictest
    model.weights = _fit_weights(tried[model.toxic][1], y, row_weights)
    return model


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model of the labelled documents that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    found = dict(usable.filter(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect())
    picked = None
    for y in (0, 1):
        own = (usable.filter(F.col("toxic") == y).select("doc_id", F.lit(y).alias("label"), F.xxhash64("doc_id").alias("h"))
               .orderBy("h", "doc_id").limit(train_docs))
        picked = own if picked is None else picked.unionByName(own)
    # at most 2 * train_docs ids are sent, so no text is exchanged
    rows = (docs.select("doc_id", "text").filter(F.octet_length("text") <= train_bytes).join(F.broadcast(picked), "doc_id")
            .select("h", "text", "label").orderBy("h", "text", "label").limit(2 * train_docs).collect())
    return fit([(r.text, r.label) for r in rows], (found.get(0, 0), found.get(1, 0)))


SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, if given) with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def work(texts: list) -> dict:
            scores = [own.score(t) for t in texts]
            return {"score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}
        return work

    return add_columns(docs, SCHEMA, make, "text", keep)
