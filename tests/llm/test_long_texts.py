"""Ids of texts beyond what the library's own split takes."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from docloom.llm import residual_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read(blob: bytes) -> list[int]:
    return np.frombuffer(blob, "<u4").tolist()


def test_long_white_space():
    """White space is split off but for its last sign, whatever its length; longer runs are cut from the same pieces."""
    words = residual_packing.Words(RANKS)
    for sign in " \n":
        n = 1_100_000
        got = read(words.ids("one" + sign * n + "two"))
        assert got[:1] == read(words.ids("one")) and words.encoding.decode(got) == "one" + sign * n + "two"


@pytest.mark.parametrize("said", ["It's 12 words,\n\n  l'été\t\u00a0 <|endoftext|> x<|endoftext|><|endoftext|>\n", "", "<|endoftext|>", " \n ", "\u3000a 漢字 🙂!?"])
def test_long_texts_as_short_ones(monkeypatch, said):
    words = residual_packing.Words(RANKS)
    whole = words.ids(said)
    monkeypatch.setattr(residual_packing, "LONG", 0)
    assert words.ids(said) == whole
