"""The ids of op 10 against the SentencePiece library."""

import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from retrospect.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_are_the_models_own_encoding(spark, tmp_path):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["the world of information", "", None, " a  b\n c ", "▁x ▁ y", "e日 \0▁ 😀", "information " * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = {r["doc_id"]: r for r in pieces.op10_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(own) == len(texts)
    for k, text in enumerate(texts):
        want = np.array(lib.encode(text or ""), "<u4")
        assert (own[k]["n_pieces"], own[k]["ids_crc32"], own[k]["round_trip"]) == (len(want), zlib.crc32(want.tobytes()), True)
    assert own[0]["n_pieces"] == 4
    out = pieces.segment(spark.read.parquet(f"{tmp_path}/documents.parquet"), MODEL).where("doc_id = 0").first()
    assert out["ids"] == lib.encode(texts[0]) and out["best_ids"] != out["ids"]


def test_encoding_by_chunks_equals_the_library(monkeypatch):
    """Runs of blanks, the blank's own sign, control strings, bytes, and chunks forgotten between batches."""
    import random

    monkeypatch.setattr(pieces, "REMEMBERED", 400)
    rng = random.Random(12)
    letters = list("abcdetho  ,.\n\t1é中ßİ́ \xa0") + [pieces.BLANK, "   ", "</s>", "<0x0A>", "the ", " of", "[INST]", "\U0001f600", "\0"]
    own = pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 2)
    for _ in range(12):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", " ", "  ", " a", "a "]
        want = own.vocabulary.library.encode(texts)
        assert [x.tolist() for x in own.encode_many(texts)] == want
        assert [x.tolist() for x, _ in own.work(texts)] == want
