from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import piece_encode, residual_packing

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "é", "日", "▁", "e", "th", "0", "\t", "<s>", "\U0001f600", "ing", "     ", "ß", "́", "<|endoftext|>", "'s", "½", " ", "\x00"]


def texts(n: int, seed: int = 3) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library():
    tool, library = piece_encode.Encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [*texts(3000), "", " " * 999, "ab" * 3000, "日本" * 999, "x" * 5000]:
        assert tool.encode(t) == library.encode(t), t[:80]


def test_piece_rows(spark):
    rows = spark.createDataFrame([(1, "The cat"), (2, None), (2, ""), (None, "The cat")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = piece_encode.encode(rows, PIECES).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [r.ids for r in got] == [library.encode("The cat"), [], [], library.encode("The cat")]
    assert got[0].ids_sha256 == hashlib.sha256(",".join(map(str, got[0].ids)).encode()).hexdigest()
    assert got[0].decoded_sha256 == hashlib.sha256(b"The cat").hexdigest() and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert piece_encode.encode(rows.limit(0), PIECES).count() == 0


def test_ids_equal_the_library():
    memo, library = residual_packing.Words(RANKS), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts(3000, 4):
        assert np.frombuffer(memo.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_best_fit():
    sizes = np.array([5, 7, 3, 5, 10, 1])
    bins, offsets, fill = residual_packing.best_fit(sizes, 10)
    assert len(fill) == 4 and fill.max() == 10
    assert sorted(zip(bins[sizes == 5], offsets[sizes == 5], strict=True)) == [(bins[0], 0), (bins[0], 5)]


def test_packing(spark):
    said = [(i, "word " * (37 * i % 400)) for i in range(300)] + [(7, None), (None, "x"), (5000, "long " * 5000)]
    docs = spark.createDataFrame(said, "doc_id long, text string").withColumn("bin", F.lit(1))
    pieces = residual_packing.pieces(docs, RANKS)
    got = residual_packing.pack(pieces, 300, items_per_task=40, fan_in=2).toPandas()
    assert len(got) == pieces.count() and got.length.between(1, 1024).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.03 + 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*library.encode("long " * 5000, add_special_tokens=False).ids, 2]
    for r in got[got.doc_id == 5000].itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and (r.piece == 0 or r.length == 1024)
    assert residual_packing.pack(residual_packing.pieces(docs.limit(0), RANKS), 0).count() == 0
