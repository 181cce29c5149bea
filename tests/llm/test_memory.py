"""What a task holds depends on bytes, not on rows."""

import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor

from suffixloom.llm import ngram_join as nj, pieces, resampling as rs, rolling
from suffixloom.llm.arrow import slices

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_slices_cover_the_batch():
    sizes = np.random.default_rng(1).integers(0, 100, 60).tolist()
    batch = pa.RecordBatch.from_pydict({
        "t": ["x" * n for n in sizes], "b": pa.array([b"y"] * 59 + [None]), "s": pa.array([{"a": "y", "l": [1, 2]}] * 59 + [None])})
    for rows, size in ((3, 1 << 20), (256, 150), (256, 1)):
        parts = list(slices([batch], rows, size))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        assert all(p.num_rows <= rows and (p.num_rows == 1 or len("".join(p.column("t").to_pylist())) <= size) for p in parts)


def test_words_do_not_depend_on_pieces(monkeypatch):
    draw = np.random.default_rng(2)
    texts = [bytes(draw.choice(list(b"abc \n"), int(n)).astype(np.uint8)) for n in draw.integers(0, 60, 200)]
    whole = rolling.word_hashes(texts)
    monkeypatch.setattr(rolling, "PIECE", 7)
    cut = rolling.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert cut[1].tolist() == [len(t.split()) for t in texts]


def test_many_long_texts_in_one_batch():
    text = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({
        "t1": [1] * 256, "t2": [1] * 256, "doc_id": list(range(256)), "text": [f"{text} {i}" for i in range(256)]})
    list(nj._sign([batch.slice(0, 2)]))  # what is kept for good
    tracemalloc.start()
    assert sum(p.num_rows for p in nj._sign([batch])) == 256
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_features_of_more_words_than_are_remembered():
    n, words = 64, 20_000
    assert n * words > 2 * rs.REMEMBERED
    batch = pa.RecordBatch.from_pydict({
        "own": [None] * n, "id": list(range(n)),
        "text": [" ".join(f"w{i}" for i in range(k * words, (k + 1) * words)) for k in range(n)]})
    run = rs._features((1, 1), rs.BUCKETS, ["own", "id"])
    list(run([batch.slice(0, 1)]))  # what is kept for good
    tracemalloc.start()
    assert sum(sum(p.column("n_words").to_pylist()) for p in run([batch])) == n * words
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_units_are_encoded_without_an_object_for_each(prose, monkeypatch):
    monkeypatch.setattr(pieces, "add_columns", lambda docs, schema, make, *rest: make())
    work = pieces.sentencepiece(None, MODEL, ("n_tokens", "ids_text", "spans_sha256"), 100_000)
    texts = [prose(seed, 400) for seed in range(100)]
    new = len({u for text in texts for u in pieces.cache_of(MODEL, 100_000).model.units(text)})
    calls = 0

    def count(frame, event, what):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = work(texts)
    finally:
        sys.setprofile(None)
    exact = SentencePieceProcessor(model_file=MODEL)
    assert [str(t) for t in out["ids_text"]] == [",".join(map(str, exact.encode(text))) for text in texts]
    assert calls < 6 * new


def test_texts_side_by_side_align_as_one_by_one():
    texts = ["", " a  b ", "é▁日 😀", "", "▁", "  ", "x▁▁", "▁y", ""]
    model = pieces.PieceModel.load(MODEL)
    for prefix, squeeze in ((True, False), (False, False), (True, True)):
        own = pieces.Normalizer(None, prefix, squeeze, True)
        whole, begin, units = own.align_texts(texts), 0, []
        for text, stop in zip(texts, whole.stops.tolist()):
            normal, starts, ends = own.align(text)
            assert whole.normal[begin:stop] == normal
            assert whole.first[whole.of[begin:stop]].tolist() == starts and whole.after[whole.of[begin:stop]].tolist() == ends
            units += model.units_of(normal)
            begin = stop
        at = pieces.unit_starts(whole.normal, whole.stops).tolist()
        assert [whole.normal[a:b].decode() for a, b in zip(at, [*at[1:], len(whole.normal)])] == units
