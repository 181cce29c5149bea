"""Similarity join of documents on the Jaccard index of their word shingles.

Equal texts are one text with a number of copies.  Texts whose MinHash values agree in
one of ``BANDS`` bands are candidates; a pair at the threshold escapes all bands with
probability 1.3e-7.  Candidates that hang together form a set, in which every pair is
compared once: MinHash values are read ``STEP`` at a time, and a pair is dropped as soon
as the posterior probability that its similarity reaches the threshold (uniform prior)
falls below ``TOLERANCE``.  The rest is verified exactly on the shingles.

Scale: a document is exchanged as its signature; bands are counted with map-side
combination and bands of one text leave there.  Sets larger than ``BLOCK`` texts are cut
into blocks, and each pair of blocks is a task of its own, so a set never meets in one
task.  Pairs stay inside their task: it returns for each text the copies it is linked
with and one edge of a spanning forest.

Defined cases: texts without words are like nothing, not even each other, and form
classes of their own; texts of fewer words than a shingle are one shingle; repeated rows
are copies; a class whose ids are all null has a null id.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .arrow import slices
from .common import digest_columns
from .components import components
from .rolling import shingle_hashes, spread, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
STEP, TOLERANCE = 20, 1e-9
BLOCK = 256
SEED = 20
#: Cells of the largest 0/1 matrix in which a block's shingles are counted at once.
MATRIX_CELLS = 1 << 24


def shingles_of(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes([(t or "").encode() for t in texts])
    hashes, out, at = shingle_hashes(words, size), [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(hashes[at:at + n - size + 1]))
        elif n:
            out.append(shingle_hashes(words[at:at + n], int(n)) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return (draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, dtype=np.uint32))


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each permutation."""
    low = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        low = np.minimum(low, (short[at:at + 1024, None] * factors + shifts).min(axis=0))
    return low


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = spread(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return keys.view(np.int64)


def _sign(batches):
    factors, shifts = _permutations()
    for part in slices(batches):
        sets = shingles_of(part.column("text").to_pylist())
        sigs = [signature(s, factors, shifts) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([
            *(part.column(c) for c in ("t1", "t2", "doc_id")), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
            pa.array([[] if s is None else _band_keys(s) for s in sigs], pa.list_(pa.int64()))],
            names=["t1", "t2", "doc_id", "n", "sig", "bands"])


def least_matches(steps: int, step: int, threshold: float, tolerance: float) -> list[int]:
    """After each step, the fewest agreements with which a pair stays: fewer make the
    posterior probability of ``threshold`` smaller than ``tolerance``."""
    out = []
    for k in range(1, steps + 1):
        n, tail, m = k * step, 0.0, 0
        # given m of n agreements, P(similarity >= t) = P(Binomial(n + 1, t) <= m)
        while m <= n:
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def likely_pairs(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int], step: int):
    """Pairs (left x right, each unordered pair once) that survive the comparison of all values."""
    first, second = [], []
    for i in left:
        js = right[right > i] if left is right else right
        seen = np.zeros(len(js), dtype=np.int32)
        for k, need in enumerate(least):
            at = slice(k * step, (k + 1) * step)
            seen += (sigs[js, at] == sigs[i, at]).sum(axis=1, dtype=np.int32)
            stay = seen >= need
            if not stay.all():
                js, seen = js[stay], seen[stay]
            if not len(js):
                break
        first.append(np.full(len(js), i))
        second.append(js)
    return np.concatenate(first), np.concatenate(second)


def verified(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    common = np.zeros(len(first), dtype=np.int64)
    if len(first) > 64:
        used = np.unique(np.concatenate([first, second]))
        words, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        if len(words) * len(used) <= MATRIX_CELLS:
            cells = np.zeros((len(used), len(words)), dtype=np.float32)
            cells[np.repeat(np.arange(len(used)), sizes[used]), place] = 1
            common = np.rint(cells @ cells.T).astype(np.int64)[np.searchsorted(used, first), np.searchsorted(used, second)]
            return common >= threshold * (sizes[first] + sizes[second] - common) - 1e-9
    for k, (i, j) in enumerate(zip(first, second)):
        if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) - 1e-9:
            common[k] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return common >= threshold * (sizes[first] + sizes[second] - common) - 1e-9


def _roots(n: int, first: np.ndarray, second: np.ndarray) -> list[int]:
    """The least member of each one's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(first.tolist(), second.tolist()):
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _groups(batches, keys: list[str]):
    """Consecutive rows with equal keys, as lists of columns."""
    held, key = [], None
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in keys]
        new = np.ones(batch.num_rows, dtype=bool)
        if batch.num_rows > 1:
            new[1:] = np.logical_or.reduce([r[1:] != r[:-1] for r in rows])
        starts = np.flatnonzero(new).tolist() + [batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            own = tuple(int(r[a]) for r in rows)
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _compare(threshold: float, tolerance: float):
    least = least_matches(BANDS * ROWS // STEP, STEP, threshold, tolerance)

    def run(batches):
        for (_, bi, bj), rows in _groups(batches, ["part", "bi", "bj"]):
            uids = rows.column("uid").to_numpy()
            uids, one = np.unique(uids, return_index=True)  # repeated rows with one id
            rows = rows.take(pa.array(one))
            block, copies = rows.column("block").to_numpy(), rows.column("copies").to_numpy()
            sigs = np.stack([np.frombuffer(s, dtype=np.uint32) for s in rows.column("sig").to_pylist()])
            sets = [np.frombuffer(s, dtype=np.uint64) for s in rows.column("shingles").to_pylist()]
            left = np.flatnonzero(block == bi)
            first, second = likely_pairs(sigs, left, left if bi == bj else np.flatnonzero(block == bj), least, STEP)
            if not len(first):
                continue
            same = verified(sets, first, second, threshold)
            first, second = first[same], second[same]
            links = np.bincount(first, copies[second], len(uids)) + np.bincount(second, copies[first], len(uids))
            roots = uids[_roots(len(uids), first, second)]
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids[some]), pa.array(links[some].astype(np.int64)), pa.array(roots[some])],
                names=["uid", "links", "root"])

    return run


def _with_shingles(batches):
    for part in slices(batches):
        sets = shingles_of(part.column("text").to_pylist())
        own = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in own), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*own, "shingles"])


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
               scratch: Scratch | None = None) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``t1, t2`` (the digest of its text), ``class_id`` (the
    least id among the documents it is linked with, directly or over others), ``n_links``
    (documents whose similarity with it reaches ``threshold``, copies included) and
    ``first`` (whether its text and id are the ones of the class; repeated rows share it)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*digest_columns(text), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    signed = scratch.save(rows.mapInArrow(_sign, "t1 long, t2 long, doc_id long, n long, sig binary, bands array<long>")
                          .withColumn("uid", F.monotonically_increasing_id()), "signatures")
    texts = scratch.save(signed.groupBy("t1", "t2").agg(
        F.min("uid").alias("uid"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
        F.max("n").alias("n")), "texts")

    # candidates: texts that share a band with another, and the sets they hang together in
    banded = signed.join(texts.select("uid"), "uid", "left_semi").select("uid", F.explode("bands").alias("band"))
    leaders = scratch.save(banded.groupBy("band").agg(F.min("uid").alias("leader"), F.count("*").alias("size"))
                           .filter("size > 1").select("band", "leader"), "bands")
    # of a text's leaders the least stands for it, and the others are tied to that one: members of one
    # large set repeat the ties among its few leaders, which leaves about one edge a text
    led = banded.join(leaders, "band").groupBy("uid").agg(F.sort_array(F.collect_set("leader")).alias("by"))
    ties = F.transform(F.array_append("by", F.col("uid")), lambda x: F.struct(x.alias("a"), F.get("by", F.lit(0)).alias("b")))
    near = scratch.save(led.select(F.explode(ties).alias("e")).select("e.a", "e.b").filter("a <> b").distinct(), "candidates")
    parts = components(near, scratch)
    sizes = scratch.save(parts.groupBy("label").agg(F.count("*").alias("size")), "sizes")

    # one row a text and pair of blocks of its set
    members = scratch.save(
        parts.join(sizes, "label").join(texts, F.col("node") == F.col("uid")).select(
            "uid", "t1", "t2", "first_id", "copies", F.col("label").alias("part"),
            F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")), "members")
    # merged at every size: a text with very many copies is split, and no plan depends on the sample at hand
    matched = members.hint("merge").join(rows, ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "uid", "copies", "part", "blocks", "block", "text")
    shingled = matched.mapInArrow(
        _with_shingles, "uid long, copies long, part long, blocks int, block int, shingles binary").join(
        signed.select("uid", "sig"), "uid")
    dealt = shingled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
        "uid", "block", "copies", "sig", "shingles")
    found = scratch.save(
        dealt.repartition("part", "bi", "bj").sortWithinPartitions("part", "bi", "bj", "uid")
        .mapInArrow(_compare(threshold, tolerance), "uid long, links long, root long"), "links")

    # classes of texts, then of documents
    links = scratch.save(found.groupBy("uid").agg(F.sum("links").alias("links")), "link-counts")
    classes = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
    known = scratch.save(
        texts.join(classes.select(F.col("node").alias("uid"), "label"), "uid", "left").join(links, "uid", "left")
        .select("t1", "t2", "first_id", "copies", "n", F.coalesce("label", "uid").alias("label"),
                F.coalesce("links", F.lit(0)).alias("links")), "text-classes")
    heads = scratch.save(known.groupBy("label").agg(
        F.min("first_id").alias("class_id"),
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "t1", "t2")).alias("head")), "classes")
    per_text = scratch.save(known.join(heads, "label").select(
        "t1", "t2", "first_id", "class_id", "n", (F.col("links") + F.col("copies") - 1).alias("links"),
        ((F.col("head.t1") == F.col("t1")) & (F.col("head.t2") == F.col("t2"))).alias("heads")), "text-results")
    worded = F.col("n") > 0
    return rows.select("t1", "t2", "doc_id").join(per_text, ["t1", "t2"]).select(
        "doc_id", "t1", "t2", F.when(worded, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("links")).otherwise(0).alias("n_links"),
        (~worded | (F.col("heads") & F.col("doc_id").eqNullSafe(F.col("first_id")))).alias("first"))
