"""Heads ordered by the first bits of their texts."""

import brute
from suffixloom.operators import ranking
from suffixloom.plans.compressed import CompressedBwt


def test_heads_of_short_texts_need_no_round(collection, base, monkeypatch):
    """The first bits of a text, up to its end, order its heads at once; by classes alone, equal texts took rounds."""
    from suffixloom.operators import heads

    rounds = []
    real = ranking.rank_sequences

    def rank(*args):
        rounds.append([])
        return real(*args, rounds=rounds[-1])

    monkeypatch.setattr(heads, "rank_sequences", rank)
    docs = [f'{{"k": {i % 7}{i % 3}}}' for i in range(60)]
    plan = CompressedBwt(collection(docs), base(docs[0]))
    assert [r.ch for r in plan.bwt().orderBy("bwt_idx").collect()] == brute.bwt(docs)
    assert rounds == [[]]
