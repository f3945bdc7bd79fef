"""SentencePiece encoding and decoding of merge-type models by backtracking.

A text is cut before every run of the space sign, as no piece of such a model crosses that border,
and each distinct part is encoded once for each worker's memo. In a part, one Aho-Corasick pass finds
every piece at every place. The encoder takes the longest piece at the current place that is
compatible with the piece before it, else a shorter one; where none is left it steps back. A bit
field holds the places from which no way leads on, so none is tried twice. Two adjacent pieces are
compatible when merging their joint characters again gives just these two. The result is the one
that the merges in order of score give.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
PART = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Entries after which a worker's memo starts anew; results don't depend on it.
MEMO = 600_000


class Encoder:
    """Encodes and decodes with the vocabulary of one model file."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.finder = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.finder.add_word(p, i)
        self.finder.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.parts: dict[str, str] = {}
        self.compatible: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of text by merging the best-scored pair again and again, leftmost first."""
        chars = list(text)
        n = len(chars)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        scores = self.scores
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := chars[i] + chars[i + 1]) in scores]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            j = right[i]
            if chars[i] is None or j < 0 or chars[i] + chars[j] != p:
                continue
            chars[i], chars[j], right[i] = p, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (q := chars[a] + chars[b]) in scores:
                    heappush(heap, (-scores[q], a, q))
        return [c for c in chars if c is not None]

    def fits(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > 4 * MEMO:
                self.compatible.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self.compatible[a, b] = self.merged(x + y) == [x, y]
        return known

    def covered(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n, sizes, compatible = len(text), self.sizes, self.compatible
        at: list[list[int]] = [[] for _ in text]
        for end, i in self.finder.iter(text):
            at[end + 1 - sizes[i]].append(i)  # shorter ones end, and so come, earlier
        at.append([])
        failed = bytearray(n // 8 + 1)
        ids: list[int] = []
        tried: list[int] = []  # for each piece taken, which of the pieces at its place it is
        place, last, here = 0, -1, at[0]
        k = len(here)
        while place < n:
            while k:
                k -= 1
                i = here[k]
                to = place + sizes[i]
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                if last < 0 or (f := compatible.get((last, i))) or (f is None and self.fits(last, i)):
                    ids.append(i)
                    tried.append(k)
                    place, last, here = to, i, at[to]
                    k = len(here)
                    break
            else:  # no way on from here after the pieces so far: take the last one back
                failed[place >> 3] |= 1 << (place & 7)
                place -= sizes[ids.pop()]
                k, here = tried.pop(), at[place]
                last = ids[-1] if ids else -1
        return ids

    def part(self, text: str) -> list[int]:
        """Ids of a part that holds space signs at its start only."""
        if text.startswith(SPACE * 2):
            # Pieces of several space signs share one score, so pairs of them do not fix the order of merges.
            out: list[int] = []
            for p in self.merged(text):
                out += [self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
            return out
        if self.known.issuperset(text):
            return self.covered(text)
        out, start = [], 0
        for i, ch in enumerate(text):
            if ch not in self.ids:  # never part of a piece: its bytes stand for it
                out += self.covered(text[start:i]) if i > start else []
                out += [self.byte_ids[b] for b in ch.encode("utf-8", "replace")]
                start = i + 1
        return out + (self.covered(text[start:]) if start < len(text) else [])

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        memo, out = self.parts, []
        for p in PART.findall(SPACE + text.replace(" ", SPACE)) if text else ():
            got = memo.get(p)
            if got is None:
                got = ",".join(map(str, self.part(p)))
                if len(p) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = got
            out.append(got)
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and model."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids, ids_sha256, decoded_sha256: one row for each row of docs.

    A null text is an empty one: no ids. Texts of any length are encoded whole. Repeated rows stay;
    other columns are not read. ids is left out unless with_ids. model is the path of the model file,
    on every machine; its model must be of merge type with byte fallback.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for batch in batches:
            counts, lists, shas, decoded = [], [], [], []
            for t in batch.column(1).to_pylist():
                joined = tool.encode_text(t or "")
                ids = list(map(int, joined.split(","))) if joined else []
                counts.append(len(ids))
                if with_ids:
                    lists.append(ids)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            columns = {key: batch.column(0), "n_tokens": pa.array(counts, pa.int64())}
            columns |= {"ids": pa.array(lists, pa.list_(pa.int32()))} if with_ids else {}
            yield pa.RecordBatch.from_pydict(columns | {"ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    rows = docs.select(key, text)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")
