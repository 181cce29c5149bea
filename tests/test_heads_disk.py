"""What the heads plan leaves in its scratch folder."""

import os
import random

import brute
from suffixloom.operators import buckets as bk
from suffixloom.plans import compressed
from suffixloom.plans.compressed import CompressedBwt


def test_tables_of_the_ranking_go_once_heads_are_ranked(spark, collection, base, monkeypatch):
    """The first bits of the heads and the rounds' ranks were kept to the end of the plan."""
    monkeypatch.setattr(compressed, "LINK_PASSES", 3, raising=False)
    rnd = random.Random(4)
    text = "".join(rnd.choice("ACGT") for _ in range(200))
    docs = [brute.mutate(rnd, text, 0.05, "ACGTN") for _ in range(12)] + ["", text, text, "ACA", text[50:]]
    plan = CompressedBwt(collection(docs), base(text))
    assert [r.ch for r in plan.bwt().orderBy("bwt_idx").collect()] == brute.bwt(docs)
    ranking = [n for n in os.listdir(plan.scratch.path.removeprefix("file:")) if n.partition("-")[2] in ("ranks", "keyed-heads")]
    index = CompressedBwt(collection(docs), base(text))
    index.index.count()
    assert len(ranking) == sum(n.endswith("-ranks") and not n.endswith("base-ranks")
                               for n in os.listdir(index.scratch.path.removeprefix("file:")))  # those of the base's index
    files = [n for n in os.listdir(plan.scratch.path.removeprefix("file:")) if n.endswith("-heads") and "linked" not in n]
    saved = spark.read.parquet(f"{plan.scratch.path}/{files[0]}")
    assert len(files) == 1 and not {"k1", "k2", "tie"} & set(saved.columns)
    assert plan.heads.count() == plan.linked.count() == plan.ranks.count() == plan.n_heads


def test_only_heads_of_runs_are_members(spark):
    """A head that no position follows has no non-heads, so it is not dealt out to be joined with any."""
    heads = spark.createDataFrame(
        [(0, 0, 3, 4, True, 2, 7, 1, 9, 5), (1, 0, 3, 4, True, 2, 7, 1, 9, 6), (2, 0, 3, 4, True, 0, 7, 1, 9, 8)],
        "doc long, off long, pos long, len long, smaller boolean, run_len long, isa_pos long, isa_next long, sym int, next_rank long")
    met = spark.createDataFrame([(4, 8, 9, 0, 3, 1, 3, 4, True, 2, 2, True), (5, 6, 9, 0, 2, 1, 3, 4, True, 2, 2, False)],
                                "pos long, isa_pos long, sym int, above long, reach long, isa_next long, r_pos long, r_len long, "
                                "r_smaller boolean, r_run long, cnt long, tied boolean")
    got = sorted((r.pos, r.next_rank, r.weight) for r in bk.placed_nonheads(heads, met).collect())
    assert got == [(4, 5, 1), (4, 6, 1), (5, -1, 2)]
