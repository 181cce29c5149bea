"""Importance resampling against a plain version."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from suffixloom.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(data, goal, sizes, buckets, percent, min_words, seed=2024):
    """(doc_id, n_features, weight, score, rank) of each row."""
    def features(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [crc32(" ".join(words[i:i + n]).encode()) % buckets
                            for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]

    own = [features(t) for _, t in data]
    s, t = Counter(b for _, f in own for b in f), Counter(b for g in goal for b in features(g)[1])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (t_all * 0 + s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))

    rows = []
    for (doc_id, _), (n, f) in zip(data, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r.append(k + 1)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3)])
def test_resample(spark, table, rows, prose, monkeypatch, sizes):
    monkeypatch.setattr(rs, "PIECE", 50)
    monkeypatch.setattr(rs, "REMEMBERED", 64)
    data = [(i, prose(i % 30, 5 + 3 * i)) for i in range(60)]  # the same words again and again
    data += [(60, None), (61, ""), (62, " \n\t"), (63, "ÄB Straße,über-A1\x7fb x" * 9), (64, "ALL CAPS " * 12), (None, prose(70, 40)),
             (None, prose(70, 40)), (65, "word"), (66, "x" * 5000), (67, " ".join(["one"] * 900)), (3, data[3][1])]
    goal = [prose(5, 60), None, "", "all caps words", prose(200, 10)]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    out = rs.resample(table(data), target, sizes, 97, 30, 20)
    assert set(table([]).columns) - {"rank", "score"} <= set(out.columns)
    assert rows(out, "doc_id", "n_features", "weight", "score", "rank") == brute(data, goal, sizes, 97, 30, 20)


def test_resample_nothing(spark, table):
    none = spark.createDataFrame([], "text string")
    assert rs.resample(table([]), none).count() == 0
    one = rs.resample(table([(1, "a b c")]), none, min_words=1, percent=100, keep=["doc_id"]).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in one] == [(1, 3, 1)]
    assert rs.resample(table([(1, "a b c")]), none, min_words=1, percent=99).filter("rank is not null").count() == 0


def test_equal_scores_go_by_id(spark, table, monkeypatch, small_partitions):
    small_partitions(7)
    monkeypatch.setattr(rs, "noise", lambda id_, seed: id_ * 0)
    out = rs.resample(table([(i, "same text of few words") for i in range(200)]), table([(0, "other")]), min_words=1)
    assert sorted((r["rank"], r.doc_id) for r in out.filter("rank is not null").collect()) == [(i + 1, i) for i in range(20)]
