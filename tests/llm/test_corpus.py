"""Operators that relate documents, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from suffixloom.llm import ngram_join as nj, suffix_dedup as sd
from suffixloom.llm.components import components
from suffixloom.llm.line_dedup import line_dedup
from suffixloom.llm.ngram_join import ngram_join
from suffixloom.session import Scratch


def shingles(text):
    words = [w for w in (text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_links(data):
    """Class id and number of links of each row."""
    sets, up, links = [shingles(t) for _, t in data], list(range(len(data))), [0] * len(data)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(data):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted(((d, min(ids[find(i)], default=None), links[i]) for i, (d, _) in enumerate(data)), key=repr)


def near_copies(prose, seed, n, words=120, edits=2):
    draw, base = random.Random(seed), prose(seed, words).split()
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[draw.randrange(len(copy))] = f"edit{draw.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("block", [256, 7])
def test_ngram_join(table, rows, prose, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    texts = [*near_copies(prose, 1, 40), *near_copies(prose, 2, 5, edits=6), *[prose(3, 90)] * 6, "a b", "a b", "a b c", "",
             None, " ", prose(4, 3000), prose(4, 3000) + " more", *(prose(100 + i, 60) for i in range(15))]
    data = [(i + 1, t) for i, t in enumerate(texts)] + [(3, texts[2]), (None, prose(50, 40)), (None, texts[0])]
    assert rows(ngram_join(table(data)), "doc_id", "class_id", "n_links") == brute_links(data)


def test_ngram_join_of_few(table):
    assert ngram_join(table([])).count() == 0
    assert [tuple(r) for r in ngram_join(table([(1, "x")])).select("doc_id", "class_id", "n_links", "first").collect()] == [
        (1, 1, 0, True)]


def test_pruning_keeps_pairs_at_the_threshold():
    least = nj.least_matches(10, 20, 0.8, 1e-9)
    draw = np.random.default_rng(1)
    agree = draw.random((2000, 200)) < 0.8
    seen = agree.reshape(2000, 10, 20).sum(axis=2).cumsum(axis=1)
    assert (seen >= least).all()
    assert ((draw.random((2000, 200)) < 0.3).reshape(2000, 10, 20).sum(axis=2).cumsum(axis=1)[:, 5] < least[5]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def brute_dedup(data, span):
    raw = [(i, (t or "").encode()) for i, t in data]
    seen = Counter(b[k:k + span] for _, b in raw for k in range(len(b) - span + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k:k + span]] > 1:
                gone[k:k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group,block,bucket", [(2048, 1 << 20, 1 << 18), (1, 1 << 20, 1 << 18), (3, 600, 5)])
def test_suffix_dedup(table, rows, prose, monkeypatch, group, block, bucket):
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    monkeypatch.setattr(sd, "BUCKET_WINDOWS", bucket)
    span, passage = 128, prose(7, 60)[:200]
    texts = [None, "", "x" * 127, "x" * 128, "y" * 700, prose(1, 300), prose(1, 300), prose(2, 100) + passage + prose(3, 100),
             passage + prose(4, 50), prose(5, 50) + passage, passage[:128], passage[1:128], passage + "é" + passage,
             prose(8, 30) + "ab" * 200, *near_copies(prose, 11, 6, words=150)]
    data = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[8])]
    got = rows(sd.suffix_dedup(table(data), span), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert [(*r[:4], bytes(r[4])) for r in got] == brute_dedup(data, span)


def test_suffix_dedup_counts_bytes_not_words(table, rows, prose):
    """A passage of over 50 words in two documents goes if it has 400 bytes, and stays if it has fewer."""
    lines = [" ".join(f"{i:05d}" for i in range(k, k + 70)) for k in (0, 1000)]
    long, short, exact, less = prose(21, 90), " ".join(map(str, range(2000, 2060))), lines[0][:400], lines[1][:399]
    assert len(long.encode()) > 400 > len(short) and min(len(p.split()) for p in (long, short, exact, less)) > 50
    passages = [long, long, short, short, exact, exact, less, less, prose(99, 90)]
    data = [(i, f"{prose(30 + i, 40)}{chr(65 + i)}{p}{chr(75 + i)}{prose(60 + i, 40)}") for i, p in enumerate(passages)]
    got = rows(sd.suffix_dedup(table(data)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert [(*r[:4], bytes(r[4])) for r in got] == brute_dedup(data, 400)
    assert [r[2] for r in got] == [len(p.encode()) if p in (long, exact) else 0 for p in passages]


def test_suffix_dedup_of_nothing(table):
    assert sd.suffix_dedup(table([])).count() == 0
    assert [r.n_removed for r in sd.suffix_dedup(table([(1, "a")])).collect()] == [0]


def test_anchors_across_segments(monkeypatch, prose):
    data = np.frombuffer(prose(1, 3000).encode(), dtype=np.uint8)
    whole = sd.anchors(data)
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    cut = sd.anchors(data)
    assert set(whole[1]) == set(cut[1]) and int((whole[3] - whole[2] + 1).sum()) == int((cut[3] - cut[2] + 1).sum()) == len(data) - 399


@pytest.mark.parametrize("period", [4, 8, 16])
def test_cover_has_every_difference(period):
    cover = sd.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_lines(data, at_least):
    spaces = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(spaces).translate(lower) for x in (t or "").split("\n")] for _, t in data]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(data, keys):
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, ks) if n[k] < at_least]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_line_dedup(table, rows):
    texts = [None, "", "\n", "Shared line\nown 1", " shared LINE\t\nown 2\n\nown 2", "shared line", "É\né", "é\nÉ", "\u3000shared line",
             "x\n" * 300 + "Shared Line", "shared line\nshared line"]
    data = list(enumerate(texts)) + [(3, texts[3])]
    for at_least in (1, 2, 3, 4, 7):
        got = rows(line_dedup(table(data), at_least), "doc_id", "n_lines", "n_dropped", "kept")
        assert [r if r[3] is not None else r for r in got] == brute_lines(data, at_least)
    assert line_dedup(table([])).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int"


def test_pipeline(spark, prose, tmp_path):
    clean = [prose(i, 90).replace(" ", ". ", 1) + "." for i in range(20)]
    leak = prose(500, 30)
    copies = [x + "." for x in near_copies(prose, 40, 4, words=140, edits=1)]
    texts = [*clean, *copies, None, "", "too short.", prose(60, 80) + ". " + leak + " " + prose(61, 20) + ".",
             "\n".join(" | ".join(prose(i, 8).replace(".", "").split()) for i in range(12))]
    texts = [t and t + ("\nRead by everyone. Here it is." if i < 12 else "") for i, t in enumerate(texts)]
    data = [(i, t, "en", "s", len(t or ""), None) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0, None)]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).save(stage(spark, docs, str(tmp_path)), "stage")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.DOCUMENT
        if name == "line dedup":
            assert not docs.filter(F.col("text").contains("Read by everyone")).count()
    assert kept["quality rules"] == kept["line dedup"] == sorted([0, 0, *range(1, 24), 27])
    assert kept["n-gram jaccard join"] == [*range(21), 27]
    assert kept["benchmark decontamination"] == kept["sentencepiece"] == list(range(21))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == list(range(21))
    text = clean[3]
    assert out[3].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and out[3].n_tokens == len(out[3].ids)
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
