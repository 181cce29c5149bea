"""Removal of repeated passages against a plain version, and the automaton by itself."""

import random

import numpy as np
import pytest

from suffixloom.llm import substring_dedup as sub

COLUMNS = ["doc_id", "n_words", "n_removed", "n_spans", "kept", "repeats"]


def brute(data, window):
    words = [(t or "").encode().split() for _, t in data]
    ids = [float("inf") if i is None else i for i, _ in data]
    places = {}
    for d, own in zip(ids, words):
        for k in range(len(own) - window + 1):
            places.setdefault(tuple(own[k:k + window]), set()).add(d)
    out = []
    for (doc_id, _), d, own in zip(data, ids, words):
        gone, repeats = [False] * len(own), False
        for k in range(len(own) - window + 1):
            where = places[tuple(own[k:k + window])]
            repeats |= len(where) > 1
            if min(where) < d:
                gone[k:k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(own), sum(gone), spans, b" ".join(w for w, g in zip(own, gone) if not g).decode(), repeats))
    return sorted(out, key=repr)


def corpus(prose, seed, window):
    """Copies, near copies, passages around the length of a window, and a passage that many texts share."""
    draw = random.Random(seed)
    common = prose(1, window + 3)
    short = prose(2, window - 1)
    data = []
    for i in range(40):
        parts = [prose(100 + i, draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            parts += [draw.choice([common, short, prose(5, window), prose(6, 3 * window)]), prose(200 + draw.randrange(1000), draw.randint(0, 40))]
        data.append((draw.randrange(10**6), " ".join(parts)))
    base = prose(7, 200).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(2):
            copy[draw.randrange(len(copy))] = f"edit{draw.randrange(99)}"
        data.append((draw.randrange(10**6), " ".join(copy)))
    data += [(7, "again " * 300), (8, "again " * 90 + prose(9, 30)), (9, "ab ba " * 100), (None, data[3][1]), (None, prose(300, 99)),
             (10, None), (11, ""), (12, " \n\t"), (13, data[30][1].replace(" ", "\n\t")), (13, data[30][1]), (13, data[31][1]),
             (14, prose(10, 90)), (14, prose(10, 90)), (-5, prose(5, window)), (15, prose(11, 6000)), (16, prose(11, 6000)[:-9])]
    draw.shuffle(data)
    return data


@pytest.mark.parametrize("window, group, shard", [(50, 512, 1 << 16), (50, 3, 200), (20, 1, 1)])
def test_substring_dedup(table, rows, prose, monkeypatch, window, group, shard):
    monkeypatch.setattr(sub, "GROUP", group)
    monkeypatch.setattr(sub, "SHARD_WORDS", shard)
    data = corpus(prose, window + group, window)
    out = sub.substring_dedup(table(data), window)
    assert set(table([]).columns) - {"n_words", "kept"} <= set(out.columns)
    got = rows(out, *COLUMNS)
    assert got == brute(data, window)
    assert sum(r[2] for r in got) > 1000


def test_long_texts_in_segments(table, rows, prose, monkeypatch):
    monkeypatch.setattr(sub, "SEGMENT", 16)
    data = corpus(prose, 3, 50)
    words = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64)
    one = sub.anchors(words, np.zeros(500, int), 50)
    windows = [k for a, n in zip(one[1].tolist(), one[2].tolist()) for k in range(a, a + n)]
    assert windows == list(range(451))
    # anchors are found in the tasks, which have the module as it is: here only the plain call is cut
    assert rows(sub.substring_dedup(table(data)), *COLUMNS) == brute(data, 50)


def test_nothing(table):
    assert sub.substring_dedup(table([])).count() == 0
    with pytest.raises(ValueError):
        sub.substring_dedup(table([]), 10)


def test_automaton():
    draw = random.Random(4)
    for _ in range(60):
        rows = [([draw.randrange(3) for _ in range(draw.randint(1, 25))], *sorted((draw.randrange(50), draw.randrange(50))))
                for _ in range(draw.randint(1, 6))]
        automaton = sub.Automaton()
        for words, low, high in rows:
            automaton.add(words, low, high)
        automaton.finish()
        probe = [draw.randrange(4) for _ in range(30)]
        inside = {}
        for words, low, high in rows:
            for a in range(len(words)):
                for b in range(a, len(words)):
                    x = inside.setdefault(tuple(words[a:b + 1]), [low, high])
                    x[0], x[1] = min(x[0], low), max(x[1], high)
        _, lengths = automaton.matching_statistics(probe)
        for end, n in enumerate(lengths):
            longest = max((k for k in range(end + 2) if k == 0 or tuple(probe[end + 1 - k:end + 1]) in inside))
            assert n == longest
        for window in (1, 2, 4):
            low, high = automaton.windows(probe, window)
            for k in range(len(low)):
                want = inside.get(tuple(probe[k:k + window]), [sub.LAST_ID, -sub.LAST_ID - 1])
                assert [low[k], high[k]] == want
        assert len(automaton.link) <= 2 * sum(len(w) for w, _, _ in rows) + 1


def test_only_stretches_with_others_of_their_anchor_are_cut(table, rows, prose, monkeypatch):
    saved = {}

    class Kept(sub.Scratch):
        def save(self, df, name):
            saved[name] = super().save(df, name)
            return saved[name]

    copied, near = prose(21, 400), prose(22, 400).split()
    data = [(1, copied), (2, copied), (3, copied), (4, " ".join(near)), (5, " ".join([*near[:200], "other", *near[201:]]))]
    docs = table(data)
    assert rows(sub.substring_dedup(docs, scratch=Kept(docs.sparkSession)), *COLUMNS) == brute(data, 50)
    cut = saved["words"].groupBy("h").count().collect()
    assert cut and all(r["count"] > 1 for r in cut)
