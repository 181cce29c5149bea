"""Suffixes sorted as packed arrays, against the definition."""

import random

import numpy as np
import pytest

import brute
from suffixloom.functions.symbols import prefix_code
from suffixloom.operators import packed
from suffixloom.plans import suffix_sort
from suffixloom.plans.suffix_sort import rank_suffixes


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(suffix_sort, "PACKED_FROM", 0, raising=False)


def near(seed, alphabet, size, count, rate):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(alphabet) for _ in range(size))
    docs = [brute.mutate(rnd, text, rate, alphabet + "zé😀") for _ in range(count)] + ["", text, text, text[7:]]
    rnd.shuffle(docs)
    return docs


CASES = [(1, "AC", 60, 12, 0.1), (2, "ACGT", 400, 12, 0.004), (3, "ab\n", 40, 9, 0.3), (4, "a", 80, 6, 0.05),
         (5, "ACGT", 900, 3, 0.001), (6, "".join(map(chr, range(300, 700))), 300, 5, 0.01)]


@pytest.mark.parametrize("case", CASES, ids=lambda c: str(c[0]))
@pytest.mark.parametrize("rows,passes", [(1 << 20, 1), (97, 1), (97, 3)])
def test_packed_sort(collection, small_partitions, monkeypatch, always, case, rows, passes):
    small_partitions(rows)
    monkeypatch.setattr(packed, "PASSES", passes)
    monkeypatch.setattr(packed, "PASSES_FROM", 0)
    monkeypatch.setattr(packed, "HEAVY", 10 ** 9)
    monkeypatch.setattr(packed, "CHUNK", 333)
    monkeypatch.setattr(packed, "KEY_STEP", 50)
    docs = near(*case)
    ranked = rank_suffixes(collection(docs))
    assert isinstance(ranked, packed.PackedSuffixes) and ranked.rows == sum(len(t) + 1 for t in docs)
    want = brute.bwt(docs)
    assert [r.ch for r in ranked.bwt().orderBy("bwt_idx").collect()] == want
    assert [(r.ch, r.run_len) for r in ranked.rl_bwt().orderBy("run_id").collect()] == brute.runs(want)
    every = sorted((t[i:], d, i) for d, t in enumerate(docs) for i in range(len(t) + 1))
    got = ranked.suffixes.orderBy("rank").collect()
    assert [(r.doc, r.off, r["rank"]) for r in got] == [(d, i, k) for k, (_, d, i) in enumerate(every)]
    assert [chr(r.sym) for r in got] == want


def test_packed_bytes_and_sparse_keys(spark, always):
    """Document keys need not be dense, and may be negative."""
    rnd = random.Random(7)
    docs = [bytes(rnd.choice([0, 1, 2, 127, 128, 255]) for _ in range(rnd.randrange(60))) for _ in range(20)] * 2
    keys = sorted(rnd.sample(range(-10 ** 15, 10 ** 15), len(docs)))
    table = spark.createDataFrame(list(zip(keys, docs)), "doc long, text binary").repartition(5, "text")
    ranked = rank_suffixes(table)
    assert isinstance(ranked, packed.PackedSuffixes)
    assert [bytes([r.sym]) for r in ranked.suffixes.orderBy("rank").collect()] == brute.bwt(docs)


@pytest.mark.parametrize("what,most", [("HEAVY", 1), ("LONGEST", 50)])
def test_what_does_not_fit_a_task_goes_by_rows(collection, small_partitions, monkeypatch, always, what, most):
    """A group of equal keys as large as several parts, or a long document."""
    small_partitions(50)
    monkeypatch.setattr(packed, what, most)
    docs = ["A" * 300, "A" * 299, "AC", ""]
    ranked = rank_suffixes(collection(docs))
    assert isinstance(ranked, suffix_sort.RankedSuffixes)
    assert [r.ch for r in ranked.bwt().orderBy("bwt_idx").collect()] == brute.bwt(docs)


def test_few_suffixes_go_by_rows(collection):
    assert isinstance(rank_suffixes(collection(["ACA"])), suffix_sort.RankedSuffixes)


def test_parts_by_splits():
    """A key belongs to the part whose least key is not above it, whichever of its numbers decides."""
    rnd = random.Random(3)
    rows = sorted({tuple(rnd.randrange(4) for _ in range(3)) for _ in range(25)})
    keys = [tuple(rnd.randrange(5) for _ in range(3)) for _ in range(500)]
    splits = packed._Splits(*(np.array(c) for c in zip(*rows)))
    got = splits.parts(*(np.array(c) for c in zip(*keys)))
    assert got.tolist() == [sum(r <= k for r in rows) for k in keys]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8])
def test_numbers_keep_their_bytes(width):
    rnd = random.Random(width)
    values = np.array([rnd.randrange(1 << min(8 * width, 62)) for _ in range(50)] + [0])
    n = np.array([20, 0, 31])
    column = packed._blobs(values, width, np.append(0, np.cumsum(n)))
    assert packed._unblob(column, n).tolist() == values.tolist()
    assert packed._unblob(column.slice(1), n[1:]).tolist() == values[20:].tolist()


def test_covered_symbols(collection):
    """What a key covers: all symbols whose words lie in it whole, and 0 where it has the end."""
    text = "ab" * 90 + "zyx"
    code = prefix_code({ord(c): text.count(c) for c in set(text)}, 1)
    size = dict(zip([None, *code.codes], code.sizes))
    place = code.table()[np.frombuffer(text.encode(), dtype=np.uint8)]
    chunk = packed._Chunk(np.array([5]).tobytes(), np.array([len(text)]).tobytes(), packed._narrow(place, 1).tobytes(), 1)
    *_, cov, tie = chunk.keys(0, chunk.size, code)
    for at in range(len(text) + 1):
        bits, n = 0, 0
        for c in [*map(ord, text[at:]), None]:
            if bits + size[c] > 126:
                break
            bits, n = bits + size[c], n + 1
        whole = at + n > len(text)
        assert (cov[at], tie[at]) == ((0, 5) if whole else (n, 0))


def test_tables_and_shuffles_take_few_bytes_a_suffix(spark, collection, monkeypatch):
    """Row by row, the saved ranks alone took more than 12 bytes; and the shuffle files of finished rounds go."""
    import time
    from pathlib import Path

    from suffixloom import session

    monkeypatch.setattr(session, "FREE_ROWS", 1)
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f: f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data")}

    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    shared = " ".join(rnd.choices(words, k=400))
    docs = [" ".join(rnd.choices(words, k=900)) + shared for _ in range(80)]
    table = collection(docs).repartition(4, "doc").localCheckpoint()
    before = shuffled()
    ranked = rank_suffixes(table)
    saved = sum(f.stat().st_size for f in Path(ranked.scratch.path.removeprefix("file:")).rglob("*.parquet"))
    assert saved < 12 * ranked.rows
    for _ in range(40):
        left = sum(n for f, n in shuffled().items() if f not in before)
        if left < ranked.rows:
            break
        time.sleep(0.5)
    assert left < ranked.rows


def test_planned_query_sorts_packed(spark, collection, monkeypatch, always):
    """Against a base too long for a broadcast the plan goes by suffixes, which were sorted row by row."""
    from suffixloom import queries

    made = []
    real = suffix_sort.pack_suffixes
    monkeypatch.setattr(suffix_sort, "pack_suffixes", lambda *args: made.append(real(*args)) or made[-1])
    docs = ["abcab", "", "cabca", "zabcz"]
    monkeypatch.setattr(queries, "collection", lambda *_: collection(docs))
    spark.conf.set("spark.suffixloom.maxIndexSymbols", "9")
    try:
        got = queries.planned_by_heads(spark, "").orderBy("bwt_idx").collect()
    finally:
        spark.conf.unset("spark.suffixloom.maxIndexSymbols")
    assert [r.ch for r in got] == brute.bwt(docs) and isinstance(made[0], packed.PackedSuffixes)
