"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own pieces by best fit in order of falling length and emits the bins that
are nearly full. Underfull bins become items of their fill; a tree of rounds, each over a fraction of
the partitions before, packs these again by best fit, until one partition is left or a round no
longer makes them fewer. Only (bin, fill) pairs move between rounds, never tokens.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import attach, cut, slices

#: Fixed value: the public pattern that splits text before the merges of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The text and id of the vocabulary's only special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters from which on a text is split into words first: the library's own split fails on a million white-space signs in a row.
LONG = 500_000


class Words:
    """The ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).finditer
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def ids(self, text: str) -> bytes:
        if len(text) < LONG:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        one = lambda w: np.array(self.encoding._encode_single_piece(w), "<u4").tobytes()
        between = np.array([SPECIAL_ID], dtype="<u4").tobytes()
        return between.join([b"".join([one(m[0]) for m in self.split(part)]) for part in text.split(SPECIAL)])


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One for each worker and vocabulary."""
    return Words(path)


def pieces(docs: DataFrame, ranks: str, size: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids and an end id, cut where longer than size.

    All pieces but the first hold size ids, so that what is left to pack is one short piece for each
    document. ranks is the path of the vocabulary's rank file. A null text is an empty one and gives
    one piece of the end id alone. Texts of any length are encoded whole; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = words(ranks), np.array([end_id], dtype="<u4").tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            row, nth, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(t or "") + last
                n = len(ids) // 4
                a, i = 0, 0
                while a < n:
                    b = a + ((n - a) % size or size)
                    row.append(k)
                    nth.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, i = b, i + 1
            yield pa.RecordBatch.from_pydict({key: batch.column(0).take(pa.array(row, pa.int32())), "piece": pa.array(nth, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = docs.select(key, text)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin, by best fit in order of falling size."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set while some bin has s places left
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = spaces >> s
        if above:
            space = s + (above & -above).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            b, space = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if space > s:
            by_space[space - s].append(b)
            spaces |= 1 << (space - s)
    return bins, offsets, np.array(fill, np.int64)


def _packed(capacity: int, nearly: int, round_: int):
    """Adds bin, offset and done to the rows of a partition; size is the last column but for these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # a partition of one round: sizes and keys, no texts
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got).combine_chunks()
        bins, offsets, fill = best_fit(table.column("length").to_numpy(), capacity)
        ids = bins + ((round_ << 56) | (TaskContext.get().partitionId() << 32))
        table = table.append_column("bin", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("done", pa.array(fill[bins] >= nearly))
        yield from table.to_batches(max_chunksize=10_000)

    return run


def pack(items: DataFrame, rows: int, capacity: int = 1024, nearly: float = 0.98, items_per_task: int = 32_768, fan_in: int = 8) -> DataFrame:
    """The columns of items, which have a length from 1 to capacity, with sequence_id and offset.

    rows is about the number of items; a partition gets about items_per_task of them. Bins filled to
    nearly of the capacity are emitted at once. Repeated rows are packed as often as they occur;
    equal lengths go in order of arrival, so sequence ids may differ between runs, but each result is
    whole and gapless. No items give no rows. A column of items named bin or done is replaced.
    """
    spark = items.sparkSession
    items = items.drop("bin", "done", "offset", "sequence_id")
    full = int(capacity * nearly)
    parts = max(1, -(-rows // items_per_task))
    added = "bin long, offset long, done boolean"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    packed = cut(items.repartition(parts).mapInArrow(_packed(capacity, full, 0), f"{fields}, {added}"))
    left = cut(packed.where(~F.col("done")).groupBy("bin").agg(F.sum("length").alias("length")))
    # For each bin that was packed again: the bin it ended in, and its place there.
    moved, open_, round_ = None, left.count(), 0
    while open_ > 1:
        parts = max(1, min(parts // fan_in, -(-open_ // items_per_task)))
        round_ += 1
        again = cut(left.select(F.col("bin").alias("from"), "length").repartition(parts).mapInArrow(_packed(capacity, full, round_), f"from long, length long, {added}"))
        step = again.select(F.col("from"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("from").alias("to"), F.col("to").alias("next"), F.col("by").alias("more"))
            moved = cut(attach(moved, later, ["to"], open_, "left").select("from", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by")))
        left = cut(again.where(~F.col("done")).groupBy("bin").agg(F.sum("length").alias("length")))
        before, open_ = open_, left.count()
        if parts == 1 or open_ > 0.99 * before:
            break
    if moved is None:
        moved = spark.createDataFrame([], "from long, to long, by long")
    placed = attach(packed, moved.withColumnRenamed("from", "bin"), ["bin"], moved.count(), "left")
    return placed.select(
        *items.columns,
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"),
    )
