"""Words of many texts at once, as Arrow arrays, and hashes of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_hash(word: bytes) -> int:
    """64 bits of a cryptographic hash: no texts are known that make it collide."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z in lower case, one after another, and how many each text has. Null texts have none."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    fresh = pa.concat_arrays([whole, pa.array([""], pa.large_string())])[:-1]  # ascii_lower misreads an array whose text starts inside its buffer
    lowered = pc.ascii_lower(fresh)
    lists = pc.ascii_split_whitespace(lowered)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    return words.filter(there), np.bincount(rows.filter(there).to_numpy(zero_copy_only=False), minlength=len(texts))


def hashed(words: pa.Array) -> np.ndarray:
    """word_hash of each word, once for each distinct one."""
    coded = words.dictionary_encode()
    each = np.array([word_hash(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.int64).view(np.uint64)
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(each) else np.zeros(0, np.uint64)
