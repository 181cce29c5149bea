"""Cross-tokenizer alignment against a plain version that uses the two libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from suffixloom.llm import alignment as al
from suffixloom.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SIDES = al.Sides(BYTE_TOKENIZER, PIECE_MODEL)


def brute(text):
    """A and B ids, groups as text, links, overlaps and links of groups; None without tokens."""
    if not text:
        return None
    a, b = SIDES.a.encode(" " + text, add_special_tokens=False).ids, SIDES.b.encode(text)
    parts = [SIDES.bytes_a[i] for i in a], [SIDES.bytes_b[i] for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in p]).tolist() for p in parts)
    at_b = {e: k for k, e in enumerate(ends_b)}
    links = [(a[i], b[at_b[e]]) for i, e in enumerate(ends_a) if e in at_b]
    groups, overlaps, in_groups = [], 0, 0
    low, i, k = 0, 0, 0
    for end in [e for e in ends_a if e in at_b]:
        own_a = [j for j in range(i, len(a)) if ends_a[j] <= end]
        own_b = [j for j in range(k, len(b)) if ends_b[j] <= end]
        i, k = own_a[-1] + 1, own_b[-1] + 1
        groups.append(",".join(str(a[j]) for j in own_a) + "|" + ",".join(str(b[j]) for j in own_b))
        in_groups += len(own_a) * len(own_b)
        spans = [[(e - len(p[j]), e) for j, e in ((j, ends[j]) for j in own)]
                 for p, ends, own in ((parts[0], ends_a, own_a), (parts[1], ends_b, own_b))]
        overlaps += sum(x < v and u < y for x, y in spans[0] for u, v in spans[1])
        low = end
    return len(a), len(b), len(groups), len(links), overlaps, in_groups, ";".join(groups), links


def whole(texts):
    """What the query must return for each text."""
    found = [brute(t) for t in texts]
    n = Counter(x for f in found if f for x in f[7])
    most = Counter()
    for (_, b), c in n.items():
        most[b] = max(most[b], c)
    return [(0,) * 6 + ("", 0, 0) if f is None else (
        *f[:7], sum(n[x] == most[x[1]] for x in f[7]), sum(n[x] for x in f[7])) for f in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_group_links", "groups", "n_best", "count_sum"]


def odd_texts(n):
    draw = random.Random(7)
    parts = [*"abcXYZ  \n\t'.,!0123éß€漢字😀  ᠎▁\x00\x1c\x1f́ſ", "'s", "'ll", "  ", "\n\n ", " the",
             " <|endoftext|>", "<s>", "hello", "​", "﻿", "ﬁ", "½"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_aligner(monkeypatch, small):
    if small:
        for name, value in (("SEGMENT", 20), ("UNITS", 300), ("LINE_CHARS", 40)):
            monkeypatch.setattr(al, name, value)
    texts = odd_texts(1500)
    aligner = al.Aligner(al.Units(SIDES))
    out = [x for at in range(0, len(texts), 70) for x in aligner.align(texts[at:at + 70])]
    total = Counter()
    for text, (counts, groups, pairs) in zip(texts, out):
        want = brute(text)
        if want is None:
            assert not counts.any() and groups == "" and not len(pairs)
            continue
        assert (tuple(counts), groups) == (want[:6], want[6])
        assert [(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()] == want[7]
        total.update(want[7])
    keys, n = aligner.finish()
    assert {(k >> 32, k & 0xFFFFFFFF): c for k, c in zip(keys.tolist(), n.tolist())} == total


def test_products():
    draw = np.random.default_rng(3)
    for _ in range(30):
        a, b = draw.integers(0, 2, (5, 7)), draw.integers(0, 2, (6, 7))
        csr = [al.Csr(np.append(0, np.cumsum(m.sum(axis=1))), np.nonzero(m)[1], 7) for m in (a, b)]
        row, column, value = csr[0].times(csr[1].transposed())
        dense = np.zeros((5, 6), int)
        dense[row, column] = value
        assert (dense == a @ b.T).all() and (value > 0).all()
    shared = al.align_tokens(np.array([1, 3, 2]), np.array([2, 2, 2])).overlaps
    assert [list(map(int, x)) for x in zip(*shared)] == [[0, 0, 1], [1, 0, 1], [1, 1, 2], [2, 2, 2]]


@pytest.mark.parametrize("block_pairs", [al.BLOCK_PAIRS, 50])
def test_align(table, rows, prose, block_pairs):
    texts = [*odd_texts(60), None, "", " ", prose(1, 200), prose(1, 200), "x" * 3000, "word " * 2000, prose(2, 400) + "\n" + prose(3, 50)]
    data = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    out = al.align(table(data), BYTE_TOKENIZER, PIECE_MODEL, block_pairs=block_pairs)
    assert set(table([]).columns) <= set(out.columns)
    assert rows(out, "doc_id", *COLUMNS) == sorted(((i, *w) for (i, _), w in zip(data, whole(texts))), key=repr)


def test_align_nothing(table):
    assert al.align(table([]), BYTE_TOKENIZER, PIECE_MODEL).count() == 0
    (row,) = al.align(table([(1, None)]), BYTE_TOKENIZER, PIECE_MODEL, keep=["doc_id"], digest=True).collect()
    assert row.groups_sha256 == "" and row.n_links == row.count_sum == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, whole([d.text for d in docs]))}
    for r in QUERIES["op12_alignment"](spark, SF_DIR).collect():
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_overlaps, r.n_group_links) == w[:6]
        assert (r.n_best, r.count_sum) == w[7:]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_vocabulary_files():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_TOKENIZER
    assert SIDES.bytes_b[SIDES.b.piece_to_id("<0x0A>")] == b"\n" and b" the" in SIDES.bytes_a
