"""Text keys by a prefix code, and look-ahead by asking, against the definition and the plain way."""

import random

import numpy as np
import pytest

import brute
from suffixloom.functions.symbols import KEY_BITS, pack_words, prefix_code
from suffixloom.operators import ranking, suffixes
from suffixloom.plans.suffix_sort import rank_suffixes


@pytest.mark.parametrize("size", [1, 2, 40, 300])
def test_keys_are_the_first_bits_of_each_suffix(size):
    rnd = random.Random(size)
    symbols = rnd.sample(range(1000), size)
    code = prefix_code({c: rnd.choice([1, 1000, 10 ** 9]) for c in symbols}, 3)
    words = [format(w, f"0{n}b") for w, n in zip(code.words, code.sizes)]
    assert words == sorted(words) and not any(b.startswith(a) for a, b in zip(words, words[1:]))
    texts = [[rnd.choice(symbols) for _ in range(n)] for n in (0, 1, 70, 200)]
    place = code.table()
    dense = np.concatenate([np.append(place[t].astype(np.int64) if t else np.empty(0, np.int64), 0) for t in texts])
    end = np.concatenate([np.full(len(t) + 1, e) for t, e in zip(texts, np.flatnonzero(dense == 0))])
    (k1, k2), ended = pack_words(dense, np.arange(len(dense)), end, code)
    for at, (first, second, whole) in enumerate(zip(k1, k2, ended)):
        bits = "".join(words[d] for d in dense[at:end[at] + 1])
        assert whole == (len(bits) <= KEY_BITS)
        assert format(first, "063b") + format(second, "063b") == bits[:KEY_BITS].ljust(KEY_BITS, "0")


def test_a_key_covers_more_of_frequent_symbols(spark, collection):
    """A fixed width gave every suffix of a text of 77 symbols 18 of them, however rare most are."""
    text = "ab" * 300 + "".join(map(chr, range(200, 275)))
    keys = suffixes.coded_suffix_rows(collection([text]), prefix_code({ord(c): text.count(c) for c in set(text)}, 1))
    rows = {r.off: (r.k1, r.k2) for r in keys.filter("off in (0, 530, 562)").collect()}
    assert rows[0] == rows[530] and rows[530] != rows[562]


def test_texts_are_coded_in_slices(collection, monkeypatch):
    """Slices of 16 symbols with those behind them; a worker holds the rows of one slice."""
    monkeypatch.setattr(suffixes, "CODED_SYMBOLS", 16)
    rnd = random.Random(5)
    docs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (15, 16, 17, 32, 200)]
    docs += ["", docs[4], docs[4][3:], "A" * 160, "A" * 16]
    got = rank_suffixes(collection(docs)).bwt().orderBy("bwt_idx").collect()
    assert [r.ch for r in got] == brute.bwt(docs)


@pytest.mark.parametrize("few", [1, 10 ** 9])
def test_few_open_elements_ask_for_ranks(collection, monkeypatch, few):
    """The same rows by a join, where few elements are open, and by windows over all."""
    asked = []
    real = ranking._ask_ahead

    def ask(ranks, depth, parts):
        rows = real(ranks, depth, parts)
        plain = ranking._look_ahead(ranks, depth, parts)
        given = ["doc", "off", "rk", "was_open", *ranking.NEXTS]
        asked.append(sorted(map(tuple, rows.select(given).collect())) == sorted(map(tuple, plain.select(given).collect())))
        return rows

    monkeypatch.setattr(ranking, "_ask_ahead", ask)
    monkeypatch.setattr(ranking, "FEW", few)
    rnd = random.Random(9)
    text = "".join(rnd.choice("ACGT") for _ in range(300))
    docs = [text, "".join(rnd.choice("ACGT") for _ in range(500)), text[20:] + "A", ""]
    got = rank_suffixes(collection(docs)).bwt().orderBy("bwt_idx").collect()
    assert [r.ch for r in got] == brute.bwt(docs)
    assert all(asked) and bool(asked) == (few == 1)
