"""Hand-derived vectors; '.' stands for the separator symbol."""

import random

import numpy as np
import pytest

from brute import bwt as brute_bwt
from suffixloom.operators import joint_matching as jm, pieces as pc
from suffixloom.plans.compressed import CompressedBwt
from suffixloom.plans.job import run_job
from suffixloom.plans.planner import bwt
from suffixloom.plans.suffix_sort import rank_suffixes
from suffixloom.sources.collections import prefix_limit, read_base, read_collection, read_manifest
from suffixloom.sources import sinks
from suffixloom.sources.sinks import (
    SymbolTooLarge, write_bwt_file, write_bwt_parts, write_rl_bwt_file, write_rl_bwt_parts, write_table)


def symbols(df):
    return "".join(r.ch for r in df.orderBy("bwt_idx").collect()).replace("\x02", ".")


def texts(docs):
    return [r.text for r in docs.orderBy("doc").collect()]


def write(tmp_path, data, name="c.txt"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


FILES = [
    (b">a\nACGT\n>b\nACGA\n", ["", "ACGT", "ACGA"], ".TAG..AACCG"),
    (b"ACA\n\nACT\n", ["ACA", "ACT"], "ATC..AAC"),
    (b"ACA\n\nACT", ["ACA", "ACT"], "ATC..AAC"),
    (b"AC\nGT\n", ["ACGT"], "T.ACG"),
    (b">a\r\nAC\r\n", ["", "AC\r"], ".\rC.A"),
]


@pytest.mark.parametrize("data,docs,want", FILES)
def test_files(spark, tmp_path, data, docs, want):
    read = read_collection(spark, write(tmp_path, data))
    assert texts(read) == docs
    assert symbols(rank_suffixes(read).bwt()) == want


def test_unterminated_line_can_be_dropped(spark, tmp_path):
    path = write(tmp_path, b"ACA\n\nACT")
    assert texts(read_collection(spark, path, drop_unterminated=True)) == ["ACA"]
    whole = write(tmp_path, b"ACA\n\nACT\n", "whole.txt")
    assert texts(read_collection(spark, whole, drop_unterminated=True)) == ["ACA", "ACT"]


def test_leading_empty_document_is_optional(spark, tmp_path):
    path = write(tmp_path, b">a\nACGT\n\n\n>b\nACGA\n>c\n")
    assert texts(read_collection(spark, path)) == ["", "ACGT", "", "", "ACGA"]
    assert texts(read_collection(spark, path, keep_leading_empty=False)) == ["ACGT", "", "", "ACGA"]


def test_lines_keep_their_order_across_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        want = [f"{i:04d}" * (i % 5) + "x" for i in range(300)]
        data = "".join(f">{i}\n" + "\n".join(t[k:k + 7] for k in range(0, len(t), 7)) + "\n" for i, t in enumerate(want))
        assert texts(read_collection(spark, write(tmp_path, data.encode()))) == ["", *want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_collections(spark, collection):
    assert symbols(rank_suffixes(collection([""])).bwt()) == "."
    none = collection(["x"]).filter("doc < 0")
    assert rank_suffixes(none).bwt().count() == 0
    assert rank_suffixes(none).rl_bwt().count() == 0


@pytest.mark.parametrize("data,want", [
    (b">r1\nAC\n\nGT\n>r2\nTT$\n", "ACGTTT"), (b"AC\nGT\n", "AC\nGT"), (b"ACGT$\n", "ACGT"), (b"ACGT$$", "ACGT$"),
    (b"AC\n\n", "AC\n")])
def test_base(spark, tmp_path, data, want):
    assert [r.text for r in read_base(spark, write(tmp_path, data)).collect()] == [want]


def test_manifest(spark, tmp_path):
    path = write(tmp_path, b"/data/ref.fa\n/data/docs.fa \t\r\n", "m.txt")
    assert read_manifest(spark, path) == ("/data/ref.fa", "/data/docs.fa")
    for bad in (b"", b"\nx\n", b"x\n", b"x\n \n"):
        with pytest.raises(ValueError):
            read_manifest(spark, write(tmp_path, bad, "bad.txt"))


@pytest.mark.parametrize("limit", range(1, 13))
def test_prefix_at_every_offset(spark, collection, limit):
    docs = ["", "ACGT", "ACGA"]
    got = texts(prefix_limit(collection(docs), limit))
    want, left = [], limit
    for t in docs:
        if left < (2 if t else 1):
            break
        want.append(t[:left - 1])
        left -= len(want[-1]) + 1
    assert got == want


def test_prefix_bwt(collection):
    assert symbols(bwt(collection(["", "ACGT", "ACGA"]), prefix=8).bwt()) == ".TA..ACG"


@pytest.mark.parametrize("strategy", [None, "heads", "suffixes"])
def test_job(spark, tmp_path, strategy):
    base = write(tmp_path, b">r\nACGT\n", "base.fa")
    docs = write(tmp_path, b">a\nACGT\n>b\nACGA\n", "docs.fa")
    manifest = write(tmp_path, f"{base}\n{docs}\n".encode(), "manifest")
    out = run_job(spark, manifest, strategy=strategy)
    assert out == manifest + ".bwt" and symbols(spark.read.parquet(out)) == ".TAG..AACCG"
    runs = run_job(spark, manifest, str(tmp_path / "o"), prefix=8, run_length=True, strategy=strategy)
    assert runs == str(tmp_path / "o.rl_bwt")
    got = [(r.ch, r.run_len) for r in spark.read.parquet(runs).orderBy("run_id").collect()]
    assert "".join(c * n for c, n in got).replace("\x02", ".") == ".TA..ACG"


@pytest.mark.parametrize("strategy", [None, "heads"])
def test_job_with_a_base_beyond_the_broadcast_limit(spark, tmp_path, monkeypatch, strategy):
    monkeypatch.setattr("suffixloom.operators.base_index.BLOCK", 9)
    lines = ["ACGTTGCA" * 3, "GATTACA" * 4, "ACGT$"]
    base = write(tmp_path, (">r\n" + "\n".join(lines) + "\n").encode(), "base.fa")
    assert "".join(r.text for r in read_base(spark, base).orderBy("block").collect()) == "".join(lines)[:-1]
    docs = write(tmp_path, b">a\nACGT\n>b\nACGA\n", "docs.fa")
    manifest = write(tmp_path, f"{base}\n{docs}\n".encode(), "manifest")
    spark.conf.set("spark.suffixloom.maxIndexSymbols", "20")
    try:
        assert symbols(spark.read.parquet(run_job(spark, manifest, strategy=strategy))) == ".TAG..AACCG"
    finally:
        spark.conf.unset("spark.suffixloom.maxIndexSymbols")


@pytest.mark.parametrize("data", [b"ACGTACGTA$\n", b"ACGTACGT\n", b"ACGTACGTAC$$", b"ACGTACGTA\n\n", b">r\nACGT\nACGTA$\n", b"A\nC\nG\nT\nA\n"])
def test_base_that_ends_at_a_block(spark, tmp_path, monkeypatch, data):
    whole = "".join(r.text for r in read_base(spark, write(tmp_path, data)).orderBy("block").collect())
    for size in (1, 4, 9, 10):
        monkeypatch.setattr("suffixloom.operators.base_index.BLOCK", size)
        rows = read_base(spark, write(tmp_path, data)).orderBy("block").collect()
        assert "".join(r.text for r in rows) == whole
        assert all(len(r.text) == size for r in rows[:-1]) and rows[-1].text


def test_bytes_that_are_no_text(spark, tmp_path):
    docs = read_collection(spark, write(tmp_path, b">a\nA\xff\xfe\n\xc3C\n>b\nA\xff\n"), binary=True)
    assert [bytes(t) for t in texts(docs)] == [b"", b"A\xff\xfe\xc3C", b"A\xff"]
    base = read_base(spark, write(tmp_path, b"A\xff\xfe\n", "b"), binary=True)
    assert bytes(base.first().text) == b"A\xff\xfe"
    for plan in (rank_suffixes(docs), CompressedBwt(docs, base)):
        assert [ord(r.ch) for r in plan.bwt().orderBy("bwt_idx").collect()] == [
            ord(c) for c in brute_bwt([b"", b"A\xff\xfe\xc3C", b"A\xff"])]


COPIES = ["GATTACA", "GATTACA", "GACTACA"]


def test_copies_and_runs(collection):
    ranked = rank_suffixes(collection(COPIES))
    assert symbols(ranked.bwt()) == "AAACCCTTTGGGAAAA...TTCAA"
    got = [(r.run_len, r.ch.replace("\x02", ".")) for r in ranked.rl_bwt().orderBy("run_id").collect()]
    assert got == [(3, "A"), (3, "C"), (3, "T"), (3, "G"), (4, "A"), (3, "."), (2, "T"), (1, "C"), (2, "A")]


def test_binary_files(collection, tmp_path):
    ranked = rank_suffixes(collection([b"ACA", b"ACT"]))
    write_bwt_file(ranked.runs(), str(tmp_path / "o"))
    write_rl_bwt_file(ranked.runs(), str(tmp_path / "o"))
    assert (tmp_path / "o.bwt").read_bytes() == b"ATC\x02\x02AAC"
    records = (tmp_path / "o.rl_bwt").read_bytes()
    assert len(records) == 9 * 6 and records[:9] == b"\x01" + bytes(7) + b"A" and records[27:36] == b"\x02" + bytes(7) + b"\x02"


@pytest.mark.parametrize("rows", [1 << 20, 2])
def test_part_files(spark, collection, tmp_path, small_partitions, monkeypatch, rows):
    small_partitions(rows)
    docs = [b"ACA" * 9, b"ACT", b"", b"\xff\x80" * 5, b"A" * 700]
    runs = rank_suffixes(collection(docs)).runs()
    write_bwt_file(runs, str(tmp_path / "o"), binary=True)
    write_rl_bwt_file(runs, str(tmp_path / "o"), binary=True)
    write_bwt_parts(runs, str(tmp_path / "p"), binary=True)
    write_rl_bwt_parts(runs, (tmp_path / "r").as_uri(), binary=True)
    for folder, single in (("p", "o.bwt"), ("r", "o.rl_bwt")):
        parts = sorted((tmp_path / folder).iterdir())
        assert b"".join(f.read_bytes() for f in parts) == (tmp_path / single).read_bytes()
        assert [int(f.name[5:]) for f in parts] == [sum(g.stat().st_size for g in parts[:i]) for i in range(len(parts))]
        assert (rows == 2) == (len(parts) > 1)
    with pytest.raises(FileExistsError):
        write_bwt_parts(runs, str(tmp_path / "p"), binary=True)


def test_symbols_beyond_a_byte_are_refused(collection, tmp_path):
    runs = rank_suffixes(collection(["né"])).runs()
    for write_out in (write_bwt_parts, write_rl_bwt_parts, write_bwt_file, write_rl_bwt_file):
        with pytest.raises(SymbolTooLarge):
            write_out(runs, str(tmp_path / write_out.__name__))


def test_long_runs_in_chunks(monkeypatch):
    monkeypatch.setattr(sinks, "CHUNK", 10)
    sym, n = np.array([65, 66, 67, 68, 69]), np.array([3, 25, 4, 10, 1])
    assert b"".join(sinks._symbols(sym, n)) == b"AAA" + b"B" * 25 + b"CCCC" + b"D" * 10 + b"E"


def test_no_rows_no_parts(collection, tmp_path):
    write_bwt_parts(rank_suffixes(collection(["x"]).filter("doc < 0")).runs(), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_tables(spark, collection, tmp_path):
    write_table(rank_suffixes(collection(COPIES)).bwt(), str(tmp_path / "t"))
    assert symbols(spark.read.parquet(str(tmp_path / "t"))) == "AAACCCTTTGGGAAAA...TTCAA"


def test_relations_of_two_documents(collection, base):
    plan = CompressedBwt(collection(["ACA", "ACT"]), base("ACGT"))
    assert plan.base.n == 127
    got = [(r.doc, r.start, r.pos, r.len, r.smaller, r.run_len, chr(r.sym), r.next_off, r.isa_next, r["rank"])
           for r in plan.heads.join(plan.ranks, ["doc", "off"]).orderBy("doc", "off").collect()]
    assert got == [
        (0, 0, 0, 2, True, 1, "\x02", 1, 64, 3), (0, 2, 0, 1, True, 0, "C", 2, 0, 2), (0, 3, 126, 0, False, 0, "A", 2, 0, 0),
        (1, 0, 0, 2, False, 1, "\x02", 1, 83, 4), (1, 2, 3, 1, True, 0, "C", 2, 0, 5), (1, 3, 126, 0, False, 0, "T", 2, 0, 1)]
    assert sorted((r.pos, r.cnt, r.has_head) for r in plan.buckets.collect()) == [
        (0, 3, True), (1, 2, False), (3, 1, True), (126, 2, True)]
    assert symbols(plan.bwt()) == "ATC..AAC"
    assert sum(r.run_len for r in plan.rl_bwt().collect()) == 8


def whole_documents(pieces):
    """The documents of a collection in pieces, which must follow each other."""
    got = {}
    for r in pieces.orderBy("doc", "start").collect():
        assert r.start % pc.PIECE == 0 and len(r.text) <= pc.PIECE and len(got.get(r.doc, "")) == r.start
        got[r.doc] = got.get(r.doc, "") + (r.text if isinstance(r.text, str) else bytes(r.text).decode())
    return [got[d] for d in sorted(got)]


@pytest.mark.parametrize("as_bytes", [False, True])
def test_documents_in_pieces(spark, tmp_path, monkeypatch, as_bytes):
    """Records longer than a piece and than a split, empty ones and a leading header."""
    monkeypatch.setattr(pc, "PIECE", 16)
    rnd = random.Random(3)
    want = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (400, 0, 16, 33, 1, 250, 0, 32, 15)]
    data = "".join(f">{i}\n" + "".join(t[k:k + 7] + "\n" for k in range(0, len(t), 7)) for i, t in enumerate(want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        read = read_collection(spark, write(tmp_path, data.encode()), binary=as_bytes, pieces=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    docs = ["", *want]
    assert whole_documents(read) == docs
    assert symbols(rank_suffixes(read).bwt()) == brute_bwt_text(docs)
    for limit, cut in ((1, [""]), (18, ["", want[0][:16]]), (19, ["", want[0][:17]]), (402, docs[:2]), (405, [*docs[:3], want[2][:1]])):
        assert whole_documents(prefix_limit(read, limit)) == cut


def brute_bwt_text(docs):
    return "".join(brute_bwt(docs)).replace("\x02", ".")


def test_pieces_only_where_a_document_is_long(spark, tmp_path, monkeypatch):
    path = write(tmp_path, b">a\nACGT\nAC\n\n>b\nACGA\n")
    assert read_collection(spark, path, pieces=None).columns == ["doc", "text"]
    assert texts(read_collection(spark, path, pieces=None)) == texts(read_collection(spark, path))
    assert read_collection(spark, path, pieces=True).filter("text = ''").count() == 2
    assert read_collection(spark, path, keep_leading_empty=False, pieces=True).filter("doc = 0").count() == 0
    monkeypatch.setattr(pc, "PIECE", 4)
    assert read_collection(spark, path, pieces=None).columns == ["doc", "start", "text"]


@pytest.mark.parametrize("strategy", [None, "heads"])
def test_job_over_documents_in_pieces(spark, tmp_path, monkeypatch, strategy):
    """Documents that span blocks are matched and ranked as whole ones are."""
    monkeypatch.setattr(pc, "PIECE", 16)
    monkeypatch.setattr(jm, "POSITIONS", 8)
    rnd = random.Random(8)
    text = "".join(rnd.choice("ACGT") for _ in range(90))
    docs = ["", text, text[:40] + "T" + text[41:], text[5:80], text[16:32]]
    base, path = write(tmp_path, f">base\n{text}\n".encode(), "base.fa"), write(
        tmp_path, "".join(f">{i}\n{t}\n" for i, t in enumerate(docs[1:])).encode())
    out = run_job(spark, write(tmp_path, f"{base}\n{path}\n".encode(), "job"), str(tmp_path / "out"), strategy=strategy)
    assert symbols(spark.read.parquet(out)) == brute_bwt_text(docs)
