"""Importance resampling of documents towards a target distribution.

Features are runs of consecutive words, hashed into buckets.  An untrained ``Regex``
``Split`` of the tokenizers library cuts the ASCII-lowered text into words with their
offsets; each window of neighbouring offset pairs is a feature, and the CRC-32 of its
bytes gives its bucket.  Two histograms, of all documents and of all target texts, give
every bucket a gain (scaled log-ratio of smoothed shares); a document's weight is the
floored mean of its features' gains.  Gumbel noise from a digest of the id turns the
weights into a draw without replacement: the highest scores are taken.

Scale: one pass over the texts, which writes two bytes a feature; the second pass, with
the gains, reads those.  What is collected or broadcast are tables of ``buckets`` rows
and the histogram of the scores, whole numbers within about 70,000 of zero at any size
of the corpus.  The histogram gives the score from which rows can be drawn; only these
are exchanged, by ranges of score, id and row, so that equal scores are split too.

Defined cases: null, empty and wordless texts have no features, weight 0 and are never
drawn (``min_words`` permitting); a null id counts as the empty string in the digest and
comes last among equal scores; repeated rows are drawn as rows of their own; without any
documents or targets the gains follow from the smoothing alone; further columns pass
through, those named as an added column give way.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from tokenizers import Regex, pre_tokenizers

from ..operators.heads import ordered_index
from ..session import Scratch
from .arrow import slices

#: A word: digits, small letters and whatever is beyond ASCII, in a text without capital ASCII letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZES = (1, 1)
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
GAIN_SCALE = 1000
#: Characters that are split at once.
PIECE = 1 << 18
#: Features whose bucket a task remembers.
REMEMBERED = 1 << 19
ADDED = ["n_features", "weight", "score", "rank"]

_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def lowered(text: str) -> str:
    """The text with A-Z in lower case; all else stays."""
    return text.encode().lower().decode()


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that cut no word."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + size)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


class Buckets(dict):
    """feature -> bucket, computed when first asked for."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = crc32(feature.encode()) % self.n
        return bucket


class Features:
    """The words of a text and the buckets of its features."""

    def __init__(self, sizes: tuple[int, int], buckets: int):
        self.least, self.most = sizes
        self.bucket = Buckets(buckets)
        self.kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """How many words the text has, and the bucket of each of its features."""
        found, n_words = [np.zeros(0, self.kind)], 0
        before: deque[str] = deque(maxlen=max(self.most - 1, 1))  # words of the piece before
        for piece in pieces(lowered(text or ""), PIECE):
            spans = [offsets for _, offsets in self.split.pre_tokenize_str(piece)]
            n_words += len(spans)
            words = [piece[a:b] for a, b in spans]
            for size in range(self.least, self.most + 1):
                if size == 1:
                    runs = words
                else:
                    line = [*list(before)[-(size - 1):], *words]
                    runs = [" ".join(line[i:i + size]) for i in range(len(line) - size + 1)]
                found.append(np.fromiter(map(self.bucket.__getitem__, runs), self.kind, len(runs)))
            before.extend(words)
        return n_words, np.concatenate(found)


def _features(sizes: tuple[int, int], buckets: int, carried: list[str]):
    def run(batches):
        features = Features(sizes, buckets)
        for part in slices(batches):
            found = [features.of(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carried), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([f.tobytes() for _, f in found], pa.binary())], names=[*carried, "n_words", "features"])
    return run


def _kind(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def histogram(featured: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: how many ``features`` of all rows are in each bucket that has any."""

    def run(batches):
        counts, kind = np.zeros(buckets, dtype=np.int64), _kind(buckets)
        for part in slices(batches):
            rows = part.column("features").to_pylist()
            counts += np.bincount(np.frombuffer(b"".join(rows), kind), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    return featured.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the scaled logarithm of its share in the target over that in the source, smoothed by one each."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(GAIN_SCALE * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))))
        for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weigh(gain, buckets: int):
    def run(batches):
        kind, own = _kind(buckets), gain.value
        for part in slices(batches):
            found = [np.frombuffer(b, kind) for b in part.column("features").to_pylist()]
            weights = [int(own[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("own", "id", "n_words")] + [
                    pa.array([len(f) for f in found], pa.int64()), pa.array(weights, pa.int64())],
                names=["own", "id", "n_words", "n_features", "weight"])
    return run


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def resample(docs: DataFrame, target: DataFrame, sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS,
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, keep: list[str] | None = None,
             scratch: Scratch | None = None) -> DataFrame:
    """``docs (doc_id, text, ..)`` (of it the columns ``keep``, if given) with ``n_features``, ``weight``,
    ``score`` and ``rank``: 1, 2, 3.. for the rows drawn, which are ``percent`` of those with at least
    ``min_words`` words, null for the others.  ``target (text)``: texts of the wanted distribution."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    own = [c for c in docs.columns if c not in ADDED and (keep is None or c in keep)]
    rows = docs.select(F.struct(*own).alias("own"), F.col("doc_id").cast("long").alias("id"), "text")
    schema = T.StructType([rows.schema["own"], rows.schema["id"]]).add("n_words", "long").add("features", "binary")
    featured = scratch.save(rows.mapInArrow(_features(sizes, buckets, ["own", "id"]), schema), "features")
    wanted = target.select("text").mapInArrow(_features(sizes, buckets, []), "n_words long, features binary")
    gain = gains(_dense(histogram(featured, buckets), buckets), _dense(histogram(wanted, buckets), buckets))

    weighed = featured.mapInArrow(_weigh(spark.sparkContext.broadcast(gain), buckets), T.StructType(
        schema.fields[:3]).add("n_features", "long").add("weight", "long"))
    scored = scratch.save(weighed.select(
        "*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row")),
        "scored")

    # the score from which rows may be drawn; every score is a whole number of bounded size
    drawable = F.col("n_words") >= min_words
    counts = sorted(((r.score, r.n) for r in scored.filter(drawable).groupBy("score").agg(
        F.count("*").alias("n")).collect()), reverse=True)
    wanted_rows = sum(n for _, n in counts) * percent // 100
    least, reached = None, 0
    for score, n in counts:
        if reached >= wanted_rows:
            break
        least, reached = score, reached + n
    maybe = F.lit(False) if least is None else drawable & (F.col("score") >= least)
    placed = ordered_index(
        scored.filter(maybe).select("*", (-F.col("score")).alias("falling"),
                                    F.coalesce("id", F.lit((1 << 63) - 1)).alias("by_id")),
        ["falling", "by_id", "row"], "place", scratch, max(reached, 1))
    drawn = F.when(F.col("place") < wanted_rows, F.col("place") + 1).cast("long").alias("rank")
    columns = ["own.*", "n_features", "weight", "score"]
    return placed.select(*columns, drawn).unionByName(
        scored.filter(~maybe).select(*columns, F.lit(None).cast("long").alias("rank")))
