"""Seeded random collections against the definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from suffixloom import queries
from suffixloom.functions.nearest import nearest_smaller
from suffixloom.functions.symbols import Alphabet
from suffixloom.operators import base_index as bi, joint_matching as jm
from suffixloom.operators.common_prefix import History, common_prefix
from suffixloom.plans import planner
from suffixloom.plans.compressed import CompressedBwt
from suffixloom.plans.suffix_sort import rank_suffixes
from suffixloom.operators.slices import with_nearest, with_neighbours
from suffixloom.operators.suffixes import suffix_rows
from suffixloom.session import Scratch


def symbols(df):
    return [r.ch for r in df.orderBy("bwt_idx").collect()]


def run_list(df):
    return [(r.ch, r.run_len) for r in df.orderBy("run_id").collect()]


def near_copies(seed, alphabet, size, count, rate):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(alphabet) for _ in range(size))
    docs = [brute.mutate(rnd, text, rate, alphabet + "zé") for _ in range(count)] + ["", text, text]
    rnd.shuffle(docs)
    return text, docs


CASES = [(1, "AC", 60, 12, 0.1), (2, "ACGT", 300, 30, 0.01), (3, "ab\n", 40, 9, 0.3), (4, "a", 80, 6, 0.05)]


@pytest.mark.parametrize("seed,alphabet,size,count,rate", CASES)
@pytest.mark.parametrize("rows", [1 << 20, 37])
def test_suffix_sort(collection, small_partitions, seed, alphabet, size, count, rate, rows):
    small_partitions(rows)
    _, docs = near_copies(seed, alphabet, size, count, rate)
    ranked = rank_suffixes(collection(docs))
    want = brute.bwt(docs)
    assert symbols(ranked.bwt()) == want
    assert run_list(ranked.rl_bwt()) == brute.runs(want)
    assert ranked.rows == sum(len(t) + 1 for t in docs)
    assert brute.invert(want, len(docs)) == docs


@pytest.mark.parametrize("seed,alphabet,size,count,rate", CASES)
def test_heads_plan(collection, base, small_partitions, seed, alphabet, size, count, rate):
    small_partitions(53)
    text, docs = near_copies(seed, alphabet, size, count, rate)
    plan = CompressedBwt(collection(docs), base(text))
    want = brute.bwt(docs)
    assert symbols(plan.bwt()) == want
    assert run_list(plan.rl_bwt()) == brute.runs(want)
    counts = plan.buckets.agg(F.sum("cnt").alias("n")).first().n
    assert counts == len(want)
    separators = plan.heads.filter("len = 0").count()
    assert separators == len(docs)
    gaps = {r.isa_pos: r.g for r in plan.gaps.join(plan.heads, ["doc", "off"]).groupBy("isa_pos")
            .agg(F.sum("gap").alias("g")).collect()}
    cnt = {r.isa_pos: r.cnt for r in plan.buckets.collect()}
    assert all(g <= cnt[k] for k, g in gaps.items())


def test_result_does_not_depend_on_the_base(collection, base):
    _, docs = near_copies(9, "ACGT", 50, 5, 0.1)
    want = brute.bwt(docs)
    for text in ("", "T", "GATTACA"):
        assert symbols(CompressedBwt(collection(docs), base(text)).bwt()) == want


def test_matching_statistics(collection, base):
    text, docs = near_copies(5, "ACGT", 40, 6, 0.2)
    plan = CompressedBwt(collection(docs), base(text))
    got = {(r.doc, r.off): (r.pos, r.len, r.smaller) for r in plan.matches.collect()}
    assert got == brute.matching_statistics(plan.base.text + "\x01", docs)


def test_matching_steps_together_and_alone(collection, base):
    """Many documents advance in lockstep until few long ones are left."""
    text, docs = near_copies(6, "ACGT", 60, 40, 0.1)
    docs = [t[:i] for i, t in enumerate(docs)] + docs[:3]
    plan = CompressedBwt(collection(docs), base(text))
    got = {(r.doc, r.off): (r.pos, r.len, r.smaller) for r in plan.matches.collect()}
    assert got == brute.matching_statistics(plan.base.text + "\x01", docs)


def test_bytes(collection):
    rnd = random.Random(7)
    docs = [bytes(rnd.choice([3, 10, 127, 128, 255]) for _ in range(rnd.randrange(40))) for _ in range(12)]
    ranked = rank_suffixes(collection(docs))
    got = [bytes([r.sym]) for r in ranked.suffixes.orderBy("rank").select("sym").collect()]
    assert got == brute.bwt(docs)


@pytest.mark.parametrize("as_bytes", [False, True])
@pytest.mark.parametrize("docs,text", [
    (["AC\x02A", "ACA", "\x02AC"], "ACA"), (["\x00", "\x01\x00", "", "\x02\x02"], "\x01"), (["A\x01", "A", "A\x00B"], "A\x01A\x02")])
def test_low_symbols_in_texts(spark, collection, docs, text, as_bytes):
    if as_bytes:
        docs, text = [t.encode() for t in docs], text.encode()
    want = [s if isinstance(s, bytes) else s.encode() for s in brute.bwt(docs)]
    one = spark.createDataFrame([(text,)], f"text {'binary' if as_bytes else 'string'}")
    for plan in (rank_suffixes(collection(docs)), CompressedBwt(collection(docs), one)):
        assert [s.encode() for s in symbols(plan.bwt())] == want


def test_repeated_keys_are_refused(spark, base):
    twice = spark.createDataFrame([(1, "AC"), (1, "AC"), (2, "A")], "doc long, text string")
    for make in (rank_suffixes, lambda docs: CompressedBwt(docs, base("A"))):
        with pytest.raises(ValueError, match="key 1"):
            make(twice)


def test_long_runs_are_expanded_in_pieces(spark, monkeypatch):
    from suffixloom.operators import runs
    monkeypatch.setattr(runs, "PIECE", 3)
    monkeypatch.setattr(runs, "PIECES", 7)
    want, rows = [], []
    for i, n in enumerate([1, 3, 4, 7, 8, 22, 100, 2]):
        rows.append((i, len(want), 65 + i, n))
        want += [chr(65 + i)] * n
    df = spark.createDataFrame(rows, "run_id long, bwt_idx long, sym int, run_len long")
    assert symbols(runs.expand_runs(df)) == want


def test_nearest_smaller():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = rng.integers(1, 40)
        values, at, bound = rng.integers(0, 6, n), rng.integers(0, n, 10), rng.integers(0, 8, 10)
        up, down = nearest_smaller(values, at, bound, 1), nearest_smaller(values, at, bound, -1)
        for a, b, u, d in zip(at, bound, up, down):
            assert u == next((j for j in range(a, n) if values[j] < b), -1)
            assert d == next((j for j in range(a, -1, -1) if values[j] < b), -1)


def test_base_index(spark, collection, base):
    text, docs = near_copies(8, "AC", 120, 3, 0.1)
    made = bi.augment(base(text), collection(docs))
    rows = bi.base_index(spark, made, Scratch(spark)).orderBy("isa").collect()
    x = made.text + "\x01"  # any symbol below all others
    order = sorted(range(len(x) + 1), key=lambda p: x[p:])
    assert [r.pos for r in rows] == order
    assert set("".join(docs)) <= set(x)

    def shared(a, b):
        return next((k for k, (c, d) in enumerate(zip(x[a:], x[b:])) if c != d), len(x) - max(a, b))

    lcp = [0] + [shared(a, b) for a, b in zip(order, order[1:])]
    assert [r.lcp for r in rows] == lcp
    assert [r.uniq_len for r in rows] == [max(a, b) for a, b in zip(lcp, lcp[1:] + [-1])]


@pytest.fixture
def short_index(spark):
    """A limit that the base of a test exceeds, so that nothing of it may be broadcast or collected."""
    spark.conf.set("spark.suffixloom.maxIndexSymbols", "100")
    yield
    spark.conf.unset("spark.suffixloom.maxIndexSymbols")


def test_too_long_a_base_falls_back(spark, collection, base):
    text, docs = near_copies(2, "ACGT", 120, 5, 0.01)
    plan = planner.choose(collection(docs), base(text))
    assert isinstance(plan, CompressedBwt) and symbols(plan.bwt()) == brute.bwt(docs)
    spark.conf.set("spark.suffixloom.maxIndexSymbols", "100")
    try:
        assert planner.choose(collection(docs), base(text)) is None
        assert symbols(planner.bwt(collection(docs), base(text)).bwt()) == brute.bwt(docs)
        with pytest.raises(bi.BaseTooLong):
            bi.augment(base(text), collection(docs)).text
    finally:
        spark.conf.unset("spark.suffixloom.maxIndexSymbols")


def test_the_driver_holds_a_short_index_only(collection, base):
    """At about 100 bytes a symbol, an index of a few million symbols is more than a driver's share."""
    docs = collection(["ACGT" * 100])
    assert planner.choose(docs, base("ACGT" * (1 << 18) + "A")) is None
    assert not CompressedBwt(docs, base("ACGT" * (1 << 18) + "A")).broadcasts


def test_matching_without_a_broadcast(spark, collection, base, short_index, small_partitions, monkeypatch):
    """Both routes give the same relations; blocks, slices and windows are shorter than the base and the documents."""
    text, docs = near_copies(5, "ACGT", 140, 5, 0.1)
    docs += ["", "A", "zzz", "ACACAC" * 10]
    spark.conf.unset("spark.suffixloom.maxIndexSymbols")
    one = CompressedBwt(collection(docs), base(text))
    wanted = [sorted(map(tuple, df.collect())) for df in (one.matches, one.heads)]
    spark.conf.set("spark.suffixloom.maxIndexSymbols", "100")
    small_partitions(100)
    monkeypatch.setattr(bi, "BLOCK", 50)
    monkeypatch.setattr(jm, "POSITIONS", 16)
    two = CompressedBwt(collection(docs), base(text))
    assert not two.broadcasts and two.matches.columns == one.matches.columns and two.heads.columns == one.heads.columns
    assert [sorted(map(tuple, df.collect())) for df in (two.matches, two.heads)] == wanted
    assert symbols(two.bwt()) == brute.bwt(docs)


@pytest.mark.parametrize("size,as_bytes,alphabet", [(7, False, "ab"), (100, True, "ACGT"), (100, False, "aé漢😀b")])
def test_base_in_blocks(spark, collection, short_index, small_partitions, monkeypatch, size, as_bytes, alphabet):
    monkeypatch.setattr(bi, "BLOCK", size)
    small_partitions(211)
    rnd = random.Random(size)
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(12)] + ["ab" * 150, ""]
    docs = ["xyz\u007f"]
    if as_bytes:
        parts, docs = [p.encode() for p in parts], [d.encode() for d in docs]
    blocks = bi.concat_base(collection(parts))
    assert all(len(r.text) == size for r in blocks.orderBy("block").collect()[:-1])
    made = bi.augment(blocks, collection(docs))
    rows = bi.base_index(spark, made, Scratch(spark)).orderBy("isa").collect()
    whole = (b"" if as_bytes else "").join(r.text for r in made.blocks.orderBy("block").collect())
    assert whole[:made.base_len] == (b"" if as_bytes else "").join(parts) and len(whole) == made.symbols
    x = whole + (b"\x01" if as_bytes else "\x01")
    order = sorted(range(len(x) + 1), key=lambda p: x[p:])
    assert [r.pos for r in rows] == order
    shared = [0] + [next((k for k, (c, d) in enumerate(zip(x[a:], x[b:])) if c != d), len(x) - max(a, b))
                    for a, b in zip(order, order[1:])]
    assert [r.lcp for r in rows] == shared
    code = (lambda p: x[p]) if as_bytes else (lambda p: ord(x[p]))
    assert [r.prev for r in rows] == [1] + [2 if p == 0 else code(p - 1) for p in order[1:]]


def test_common_prefix_of_a_long_repeat(spark, base, collection):
    """Ranks of the rounds tell prefixes of any length; nothing goes symbol by symbol."""
    n = 100_000
    made = bi.augment(base("ab" * (n // 2)), collection(["c"]))
    lcp = bi.base_index(spark, made, Scratch(spark)).filter(f"pos < {n - 3}").agg(
        F.max("lcp").alias("most"), F.sum("lcp").alias("sum")).first()
    # suffixes of one letter at the start follow each other by length
    assert lcp.most == n - 2
    assert lcp["sum"] == sum(n - p - 2 for p in range(n - 3))


@pytest.mark.parametrize("marked", [0.0, 0.1, 0.9])
def test_neighbours_in_slices(spark, small_partitions, marked):
    small_partitions(7)
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(100), rnd.random() < marked) for i in range(60)]
    df = spark.createDataFrame(rows, "r long, v long, m boolean").repartition(5)
    got = with_neighbours(df, "r", 60, {"p": "v"}, {"n": "v"}).orderBy("r").collect()
    values = [v for _, v, _ in rows]
    assert [(r.p, r.n) for r in got] == list(zip([None, *values], [*values[1:], None]))
    near = with_nearest(df, "r", 60, F.col("m"), "v").orderBy("r").collect()
    for i, r in enumerate(near):
        assert r.below == next((v for _, v, m in reversed(rows[:i]) if m), None)
        assert r.above == next((v for _, v, m in rows[i + 1:] if m), None)


def test_planned_query_falls_back(spark, collection, monkeypatch):
    docs = collection(["abcab", "", "cabca"])
    monkeypatch.setattr(queries, "collection", lambda *_: docs)
    wanted = sorted(map(tuple, rank_suffixes(docs).bwt().collect()))
    spark.conf.set("spark.suffixloom.maxIndexSymbols", "9")
    try:
        assert sorted(map(tuple, queries.planned_by_heads(spark, "").collect())) == wanted
    finally:
        spark.conf.unset("spark.suffixloom.maxIndexSymbols")


def test_long_texts_go_by_slices(collection, monkeypatch):
    from suffixloom.operators import suffixes
    monkeypatch.setattr(suffixes, "CHUNK_SYMBOLS", 16)
    _, docs = near_copies(11, "ACGT", 70, 6, 0.1)
    docs += ["", "ACGT", "A" * 16, "A" * 15, "A" * 17, "A" * 32]
    assert symbols(rank_suffixes(collection(docs)).bwt()) == brute.bwt(docs)


def test_scratch_tables_can_be_dropped(collection):
    import os
    ranked = rank_suffixes(collection(["ab", "abc"]))
    assert os.path.exists(ranked.scratch.path)
    ranked.close()
    assert not os.path.exists(ranked.scratch.path)


def test_rows_made_from_texts_are_not_collected_for_a_join(spark, collection):
    """Texts that compress well make many suffix rows, which Spark takes for as small as the texts."""
    alphabet, scratch = Alphabet((65, 67, 71, 84)), Scratch(spark)
    keys = suffix_rows(scratch.save(collection(["ACGT" * 200, "CGTA" * 30]), "texts"), alphabet).select("doc", "off", "k1", "k2")
    pairs = scratch.save(spark.createDataFrame([(0, 0, 0, 4), (0, 790, 1, 109)], "a_doc long, a_off long, b_doc long, b_off long"), "pairs")
    shared = common_prefix(pairs, History(keys, alphabet), scratch)
    assert "BroadcastExchange" not in shared._jdf.queryExecution().executedPlan().toString()
    assert {(r.a_off, r.n) for r in shared.collect()} == {(0, 42), (790, 10)}


def test_rounds_leave_no_shuffle_files(spark, collection, small_partitions, monkeypatch):
    """What a round has sorted is saved, so its shuffle files need not wait for the end of the job."""
    import time
    from pathlib import Path

    from suffixloom import session

    monkeypatch.setattr(session, "FREE_ROWS", 1, raising=False)
    small_partitions(100)
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {int(f.name.split("_")[1]) for d in folders for f in Path(d).rglob("shuffle_*.data")}

    docs = collection(["ACGT" * 200, "CGTA" * 30, "TTACG" * 40])
    docs.repartition(2, "doc").count()
    before = max(shuffles())
    ranked = rank_suffixes(docs)
    for _ in range(40):
        left = [i for i in shuffles() if i > before]
        if len(left) <= 2:  # those of the last round's small steps
            break
        time.sleep(0.5)
    assert len(left) <= 2 and ranked.rows == 800 + 120 + 200 + 3
