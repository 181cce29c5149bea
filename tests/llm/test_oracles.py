"""The registered queries of the subpackage on the smallest tables: against their SQL, or by what must hold."""

import hashlib

import pytest
import sentencepiece

from compare import compare, connect
from suffixloom.llm.pieces import PieceModel
from suffixloom.llm.queries import ORACLES, PIECE_MODEL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    verdict, _, _ = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_pieces_of_all_documents(spark):
    exact = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    out = QUERIES["op4_sentencepiece"](spark, SF_DIR).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = exact.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(exact.decode(ids).encode()).hexdigest()


def test_spans_of_all_documents(spark):
    model = PieceModel.load(PIECE_MODEL)
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op4_sentencepiece"](spark, SF_DIR).collect():
        data, at, begins, ends = texts[r.doc_id].encode(), 0, [], []
        for i in exact_ids(texts[r.doc_id]):
            # each piece is the source bytes after the one before; the word mark that leads a text has none
            own = model.surface[i]
            size = 1 if isinstance(own, int) else len(own.encode()) - (not begins and own.startswith(" "))
            begins.append(at)
            ends.append(at + size)
            if not isinstance(own, int):
                assert data[at:at + size].decode() == (own[1:] if not at and own.startswith(" ") else own)
            at += size
        assert at == len(data)
        for k, i in enumerate(exact_ids(texts[r.doc_id])):
            if isinstance(model.surface[i], int):  # a byte piece spans its whole character
                a = begins[k]
                while data[a] & 0xC0 == 0x80:
                    a -= 1
                b = ends[k]
                while b < len(data) and data[b] & 0xC0 == 0x80:
                    b += 1
                begins[k], ends[k] = a, b
        wanted = b"".join(x.to_bytes(8, "little") for x in begins + ends)
        assert r.spans_sha256 == hashlib.sha256(wanted).hexdigest()


def exact_ids(text):
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL).encode(text)


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = QUERIES["op1_toxicity"](spark, sf_dir).filter("held_out")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r.predicted, r.toxic) for r in out.join(labels, "doc_id").select("predicted", "toxic").collect()]
    hit = sum(p and t for p, t in rows)
    assert hit >= 0.6 * sum(t for _, t in rows) and hit >= 0.6 * sum(p for p, _ in rows)
