"""Alignment of the tokens of two tokenizers over the bytes of each text.

Side A is a byte-level BPE of the tokenizers library, side B a sentencepiece model; both
read the text after one space.  The bytes of each token form a row of a token-byte
incidence matrix in CSR form.  Row by row (Gustavson), the product ``A * B^T`` adds up
the bytes that two tokens share: its entries are the overlap links.  Those whose tokens
end at the same byte are the end links, and their ends cut both sides into groups; the
product ``G_A^T * G_B`` of the group-token incidences has the shared-group links.

Neither side has a token across a space that follows a visible character, so texts are
cut there into units.  A task aligns each different unit once, many units as one
block-diagonal product, and keeps them in a table of bounded size; a document is the row
of its units.  Where a unit does not give back its bytes, the whole text is judged.

Scale: one pass over the texts, which writes four bytes an end link.  How often an id
pair is linked in the corpus is counted by units inside a task, then by pairs with
map-side combination.  The counts are laid beside the links in blocks of ``BLOCK_PAIRS``
id pairs, each broadcast in a pass of its own over the links, never over the texts; the
pairs are bounded by the two vocabularies, not by the corpus.

Defined cases: null and empty texts, and those whose tokens on one side do not give back
the bytes, have no tokens; special tokens' strings in a text are plain text; repeated
rows are counted again; further columns pass through, those named as an added column
give way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from ..session import Scratch
from .arrow import slices

#: Units and their characters that a worker remembers, about 300 bytes a unit.
UNITS, UNIT_CHARS = 300_000, 1 << 23
#: Characters of new units that are encoded and aligned at once.
LINE_CHARS = 1 << 16
#: Characters of a text that are cut into units at once.
SEGMENT = 1 << 19
#: Id pairs whose counts are broadcast at once, 17 bytes each.
BLOCK_PAIRS = 2_000_000
#: Where both sides begin a token: before a space, after what is no white space.
CUT = re.compile("(?<=[^\\s᠎])(?= )")
MARK = "▁"
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_group_links", "groups", "n_best", "count_sum"]


# --- incidence matrices ---

@dataclass
class Csr:
    """A 0/1 matrix: row ``i`` has ones in the columns ``indices[starts[i]:starts[i + 1]]``, ascending."""

    starts: np.ndarray
    indices: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of_runs(cls, lengths: np.ndarray) -> "Csr":
        """Row ``i`` has the next ``lengths[i]`` columns."""
        starts = np.append(0, np.cumsum(lengths))
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    def transposed(self) -> "Csr":
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(self.rows), np.diff(self.starts))[order]
        return Csr(np.append(0, np.cumsum(np.bincount(self.indices, minlength=self.columns))), rows, self.rows)

    def times(self, other: "Csr") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and values of the product: every one in a row calls up a row of
        ``other``, and what these rows have in one column is added up."""
        sizes = np.diff(other.starts)[self.indices]
        before = np.cumsum(sizes) - sizes
        called = np.arange(sizes.sum()) + np.repeat(other.starts[self.indices] - before, sizes)
        row = np.repeat(np.repeat(np.arange(self.rows), np.diff(self.starts)), sizes)
        cell = row * other.columns + other.indices[called]
        if len(cell) and (cell[1:] < cell[:-1]).any():
            cell = np.sort(cell, kind="stable")
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        values = np.diff(np.append(first, len(cell)))
        return cell[first] // max(other.columns, 1), cell[first] % max(other.columns, 1), values


@dataclass
class Aligned:
    """Links and groups of units that stand side by side, in the order of the A tokens."""

    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]  # A token, B token, shared bytes
    links: tuple[np.ndarray, np.ndarray]  # A and B tokens that end together
    groups_a: Csr
    groups_b: Csr

    def group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B tokens of one group."""
        a, b, _ = self.groups_a.transposed().times(self.groups_b)
        return a, b


def align_tokens(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Align two token rows over the same bytes, from the number of bytes of each token."""
    a, b = Csr.of_runs(lengths_a), Csr.of_runs(lengths_b)
    i, k, shared = a.times(b.transposed())
    together = a.starts[i + 1] == b.starts[k + 1]
    li, lk = i[together], k[together]

    def groups(last: np.ndarray) -> Csr:  # both ascend, as every token has bytes
        return Csr.of_runs(np.diff(last + 1, prepend=0))

    return Aligned((i, k, shared), (li, lk), groups(li), groups(lk))


# --- the two sides ---

def _byte_alphabet() -> dict[str, int]:
    """The visible characters that a byte-level vocabulary writes for bytes: printable
    ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [bytes(alphabet[c] for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.words_a = [_words(len(self.bytes_a), end) for end in ",|"]
        self.words_b = [_words(len(self.bytes_b), end) for end in ",;"]

    def encode(self, line: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of a text that starts with a space, if both give back its bytes."""
        data = line.encode()
        a, b = self.a.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.b.encode(line[1:], num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None


def _words(n: int, end: str) -> np.ndarray:
    """The decimal ids below ``n``, each with what follows it in the text of groups."""
    out = np.empty(n, dtype=object)
    out[:] = [f"{i}{end}" for i in range(n)]
    return out


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_group_links"]


def align_units(sides: Sides, flat_a: np.ndarray, flat_b: np.ndarray, ends: np.ndarray):
    """Align units that stand side by side and end at the bytes ``ends``, as one block-diagonal
    product.  Per unit the counts and the groups as text; the linked id pairs
    (A id * 2^32 + B id) of all units, and how many each has."""
    n = len(ends)
    sizes_a, sizes_b = sides.sizes_a[flat_a], sides.sizes_b[flat_b]
    found = align_tokens(sizes_a, sizes_b)
    stops_a = np.searchsorted(np.cumsum(sizes_a), ends, side="right")  # tokens up to the end of each unit
    stops_b = np.searchsorted(np.cumsum(sizes_b), ends, side="right")
    count_a, count_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    unit_of_a = np.repeat(np.arange(n), count_a)
    links_a, links_b = found.links

    def per_unit(tokens: np.ndarray) -> np.ndarray:
        return np.bincount(unit_of_a[tokens], minlength=n)

    counts = np.stack([count_a, count_b, per_unit(found.groups_a.starts[:-1]), per_unit(links_a),
                       per_unit(found.overlaps[0]), per_unit(found.group_links()[0])], axis=1)
    # tokens in the order of the text of groups: those of A, then those of B, group by group
    in_a, in_b = np.diff(found.groups_a.starts), np.diff(found.groups_b.starts)
    last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
    last_a[found.groups_a.starts[1:] - 1] = True
    last_b[found.groups_b.starts[1:] - 1] = True
    words = np.empty(len(flat_a) + len(flat_b), dtype=object)
    words[np.arange(len(flat_a)) + np.repeat(found.groups_b.starts[:-1], in_a)] = np.where(
        last_a, sides.words_a[1][flat_a], sides.words_a[0][flat_a])
    words[np.arange(len(flat_b)) + np.repeat(found.groups_a.starts[1:], in_b)] = np.where(
        last_b, sides.words_b[1][flat_b], sides.words_b[0][flat_b])
    words, stops = words.tolist(), (stops_a + stops_b).tolist()
    texts = ["".join(words[a:b])[:-1] for a, b in zip([0, *stops], stops)]
    return counts, texts, (flat_a[links_a] << 32) | flat_b[links_b], per_unit(links_a)


class Units:
    """The table of aligned units: numbers by unit, and by number the counts, the groups as
    text and the linked id pairs.  It outlives a task."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str | None] = []  # None: does not give back its bytes
        self._new = [(np.zeros((0, len(COUNTS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self._joined: tuple[np.ndarray, ...] | None = None

    @property
    def full(self) -> bool:
        return len(self.number) >= UNITS or self.chars >= UNIT_CHARS

    def keep_frequent(self, times: np.ndarray) -> None:
        """Keep the units seen twice or more, if these leave room; else none."""
        counts, starts, _ = self.tables()
        old, kept = self.number, np.flatnonzero(times > 1)
        pairs, sizes, texts = self.pairs_of(kept), np.diff(starts)[kept], [self.texts[i] for i in kept.tolist()]
        self.clear()
        new = dict(zip(kept.tolist(), range(len(kept))))
        self.number = {u: new[i] for u, i in old.items() if i in new}
        self.chars = sum(map(len, self.number))
        self.texts, self._new = texts, [(counts[kept], sizes, pairs)]
        if 2 * len(self.number) > UNITS or 2 * self.chars > UNIT_CHARS:
            self.clear()

    def add(self, units: list[str]) -> None:
        """Align units that are not in the table; those that can follow each other, many at a time."""
        line, size = [], 0
        for u in units:
            if u[-1].isspace() or u[-1] == "\u180e":
                self._add([u])
                continue
            line.append(u)
            size += len(u)
            if size >= LINE_CHARS:
                self._add(line)
                line, size = [], 0
        if line:
            self._add(line)

    def _add(self, units: list[str]) -> None:
        found = self.sides.encode("".join(units))
        if found is None and len(units) > 1:  # some unit does not give back its bytes
            half = len(units) // 2
            self._add(units[:half])
            self._add(units[half:])
            return
        if found is None:
            self.texts.append(None)
            self._new.append((np.zeros((1, len(COUNTS)), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)))
        else:
            counts, texts, pairs, sizes = align_units(
                self.sides, *found, np.cumsum([len(u.encode()) for u in units]))
            self.texts.extend(texts)
            self._new.append((counts, sizes, pairs))
        self._joined = None
        for u in units:
            self.number[u] = len(self.number)
            self.chars += len(u)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each unit, its first place among the pairs (one more at the end), and the pairs."""
        if self._joined is None:
            counts, sizes, pairs = (np.concatenate(c) for c in zip(*self._new))
            self._new = [(counts, sizes, pairs)]
            self._joined = counts, np.append(0, np.cumsum(sizes)), pairs
        return self._joined

    def pairs_of(self, numbers: np.ndarray) -> np.ndarray:
        _, starts, pairs = self.tables()
        sizes = starts[numbers + 1] - starts[numbers]
        at = np.arange(sizes.sum()) + np.repeat(starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return pairs[at]


@lru_cache(maxsize=1)
def units_of(path_a: str, path_b: str) -> Units:
    """The tokenizers and the table, which outlive a task in its Python worker."""
    return Units(Sides(path_a, path_b))


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text after one space, in pieces of about ``size`` characters that end where a unit ends."""
    at, text = 0, " " + text
    while at < len(text):
        cut = CUT.search(text, at + size)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def _merged(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in counted]), len(keys)).astype(np.int64)


class Aligner:
    """Aligns the documents of a task by the table of units, and counts their linked id pairs."""

    def __init__(self, units: Units):
        self.units = units
        self.times = np.zeros(0, np.int64)  # how often each unit of the table was seen
        self.counted = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def _count(self) -> None:
        """Turn what was seen of the units into counts of id pairs."""
        _, starts, pairs = self.units.tables()
        times = np.repeat(np.append(self.times, np.zeros(len(starts) - 1 - len(self.times), np.int64)), np.diff(starts))
        self.counted.append(_merged([(pairs[times > 0], times[times > 0])]))
        self.counted = [_merged(self.counted)]

    def _saw(self, numbers: list[np.ndarray]) -> None:
        """Count the units of texts that are done."""
        if numbers:
            seen = np.bincount(np.concatenate(numbers), minlength=len(self.units.texts))
            seen[:len(self.times)] += self.times
            self.times = seen

    def _numbers(self, parts: list[list[str]]) -> list[np.ndarray]:
        known = self.units.number
        new = list(dict.fromkeys(u for part in parts for u in part if u not in known))
        if new:
            self.units.add(new)
            known = self.units.number
        return [np.array([known[u] for u in part], np.int64) for part in parts]

    def align(self, texts: list[str | None]) -> list[tuple[np.ndarray, str, np.ndarray]]:
        """Counts, groups as text and linked id pairs of each text."""
        nothing = np.zeros(len(COUNTS), np.int64), "", np.zeros(0, np.int64)
        if self.units.full:
            self._count()
            self.units.keep_frequent(np.append(self.times, np.zeros(len(self.units.texts) - len(self.times), np.int64)))
            self.times = np.zeros(0, np.int64)
        short = [CUT.split(" " + t) if t and len(t) < SEGMENT else None for t in texts]
        numbers = iter(self._numbers([s for s in short if s is not None]))
        out, seen = [], []
        for text, own in zip(texts, short):
            if not text:
                out.append(nothing)
                continue
            parts = [next(numbers)] if own is not None else (self._numbers([CUT.split(s)])[0] for s in segments(text))
            out.append(self._text(parts, seen) or self._whole(text) or nothing)
        self._saw(seen)
        return out

    def _text(self, parts, all_seen: list[np.ndarray]):
        """A text as the row of its units, unless one of them does not give back its bytes."""
        done, seen = [], []
        for ids in parts:
            words = list(map(self.units.texts.__getitem__, ids.tolist()))
            if None in words:
                return None
            done.append((self.units.tables()[0][ids].sum(axis=0), ";".join(words), self.units.pairs_of(ids)))
            seen.append(ids)
        all_seen.extend(seen)
        if len(done) == 1:
            return done[0]
        return np.sum([d[0] for d in done], axis=0), ";".join(d[1] for d in done), np.concatenate([d[2] for d in done])

    def _whole(self, text: str):
        """A text with such a unit, as one unit."""
        ids = self.units.sides.encode(" " + text)
        if ids is None:
            return None
        counts, (words,), pairs, _ = align_units(self.units.sides, *ids, np.array([len(text.encode()) + 1]))
        self.counted.append(np.unique(pairs, return_counts=True))
        return counts[0], words, pairs

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """All id pairs linked in the documents of this task, and how often."""
        self._count()
        return self.counted[0]


# --- on tables ---

def _align(path_a: str, path_b: str, own: T.StructType):
    def run(batches):
        aligner = Aligner(units_of(path_a, path_b))
        names = ["own", *COUNTS, "groups", "pairs", "pair", "n"]
        for part in slices(batches):
            found = aligner.align(part.column("text").to_pylist())
            nothing = [pa.nulls(len(found), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([
                part.column("own"), *(pa.array([int(f[0][c]) for f in found], pa.int64()) for c in range(len(COUNTS))),
                pa.array([f[1] for f in found], pa.string()), pa.array([_packed(f[2]) for f in found], pa.binary()),
                *nothing], names=names)
            last = part
        keys, n = aligner.finish()
        if len(keys):
            for at in range(0, len(keys), 1 << 16):
                k = keys[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(len(k), last.schema.field("own").type), *[pa.nulls(len(k), pa.int64())] * len(COUNTS),
                    pa.nulls(len(k), pa.string()), pa.nulls(len(k), pa.binary()), pa.array(k),
                    pa.array(n[at:at + (1 << 16)])], names=names)
    return run


def _packed(pairs: np.ndarray) -> bytes:
    """Two bytes an id where they hold it, else four."""
    ids = np.stack([pairs >> 32, pairs & 0xFFFFFFFF])
    return (b"\2" + ids.astype("<u2").tobytes()) if not len(pairs) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    a, b = np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).reshape(2, -1).astype(np.int64)
    return a << 32 | b


def pair_counts(counted: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many links an id pair is, and whether no other pair of its B id is in more."""
    sums = counted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return sums.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _look_up(block, own: list[str]):
    """Best links and the sum of counts of each row, as far as its pairs are in the block."""
    def run(batches):
        keys, counts, best = block.value
        for part in slices(batches):
            found = [_unpacked(p) for p in part.column("pairs").to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate(found)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            row = np.repeat(np.arange(len(found)), sizes)[hit]
            at = at[hit]
            sums, bests = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            np.add.at(sums, row, counts[at])
            np.add.at(bests, row, best[at])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(bests), pa.array(sums)],
                                             names=[*own, "n_best", "count_sum"])
    return run


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str] | None = None, digest: bool = False,
          block_pairs: int = BLOCK_PAIRS, scratch: Scratch | None = None) -> DataFrame:
    """``docs (text, ..)`` (of it the columns ``keep``, if given) with ``n_a, n_b`` (tokens), ``n_groups``,
    ``n_links`` (end links), ``n_overlaps``, ``n_group_links``, ``groups`` (as ``a1,a2|b1;a3|b2,b3``; with
    ``digest`` ``groups_sha256`` instead), ``n_best`` (links whose id pair is the most frequent of its B id in
    the corpus) and ``count_sum`` (over the links, how often their id pair is linked in the corpus)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    own = [c for c in docs.columns if c not in [*ADDED, "groups_sha256"] and (keep is None or c in keep)]
    rows = docs.select(F.struct(*own).alias("own"), "text")
    schema = T.StructType([T.StructField("own", rows.schema["own"].dataType)])
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("groups", "string").add("pairs", "binary").add("pair", "long").add("n", "long")
    aligned = rows.mapInArrow(_align(path_a, path_b, rows.schema["own"].dataType), schema)
    groups = F.col("groups")
    if digest:  # of a text without tokens the empty string stays
        groups = F.when(groups == "", "").otherwise(F.sha2(groups, 256)).alias("groups_sha256")
    linked = scratch.save(aligned.select("own", *COUNTS, groups, "pairs", "pair", "n", F.monotonically_increasing_id().alias("row")),
                          "links")
    counts = scratch.save(pair_counts(linked.filter("pair is not null").select("pair", "n")), "pair-counts")
    texts = linked.filter("pairs is not null").drop("pair", "n")
    added = [c for c in texts.columns if c not in ("own", "pairs", "row")]
    blocks = max(1, -(-counts.count() // block_pairs))

    def block(b: int):
        found = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == b).orderBy("pair").toPandas()  # a block
        return spark.sparkContext.broadcast(
            (found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)))

    sums = T.StructType().add("n_best", "long").add("count_sum", "long")
    if blocks == 1:
        carried = ["own", *added]
        return texts.select(*carried, "pairs").mapInArrow(
            _look_up(block(0), carried), T.StructType([texts.schema[c] for c in carried] + sums.fields)).select(
            "own.*", *added, "n_best", "count_sum")
    parts = None
    for b in range(blocks):
        held = block(b)
        part = scratch.save(texts.select("row", "pairs").mapInArrow(
            _look_up(held, ["row"]), T.StructType([texts.schema["row"]] + sums.fields)), "sums")
        held.destroy()
        parts = part if parts is None else parts.unionByName(part)
    both = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("pairs").join(both, "row").select("own.*", *added, "n_best", "count_sum")
