"""Removal of long repeated byte strings by prefix-free parsing.

Every string of ``length`` bytes has one trigger: the place in it whose ``gram`` bytes have the least
rolling hash (the first of equals). It depends on the string alone, so equal strings have equal
triggers at equal places. The triggers cut a text into phrases. The strings of one trigger start at
neighbouring places within the phrase before it, and the bytes that they cover are the trigger's
context: a suffix of that phrase, then the parse from the trigger on. The corpus becomes a parse (a
row for each trigger of each text) over a dictionary (the distinct contexts):

1. a trigger whose gram stands nowhere else in the corpus ends here: its strings are unique;
2. a context that occurs twice or more is settled: all of its strings are repeated;
3. contexts that occur once but share their gram go through suffix arrays, one copy of each distinct
   context. The parse's suffixes (the bytes from the trigger on) are sorted, and so are the
   dictionary's (the bytes before it, from the trigger backwards), each with the common prefixes of
   neighbours. For every distance from the trigger the ranks in both arrays combine into the order of
   the corpus; strings are equal where both ranks are. So these are compared byte by byte.

The two arrays of a trigger are sorted in one task up to ``CHUNK`` contexts. More are dealt over
several; what stands once in its part is then counted over all parts by its digest. Contexts are told
by two independent 64-bit hashes, digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_NUMBERS, Tables, attach, slices
from docloom.llm.rolling import OTHER_BYTES, blocks, mixed, powers, prefix, runs

GRAM = 40
CHUNK = 4096  # contexts of one trigger in a task
BATCH = 4096  # contexts of several triggers that are sorted together, about


def parse(texts: list[bytes], length: int = 200, gram: int = GRAM, told: bool = True) -> dict[str, np.ndarray]:
    """One row for each trigger: doc (index), gram, context and check hashes, start, n strings, trigger less start.

    Without told, doc and gram only.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "gram", "context", "check", "start", "n", "trigger")}
    if len(data) < length:
        return empty
    sums = prefix(data)
    hashed = mixed((sums[gram:] - sums[:-gram]) * powers(len(sums), "down")[: len(data) - gram + 1])
    bits = np.uint64(max(20, len(data).bit_length()))
    packed = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
    width = length - gram + 1
    # The least of each run of width values: running minima from both sides within blocks of width.
    padded = np.full(-(-len(packed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))
    # Only strings within one text: starts up to its end less length.
    open_ = np.zeros(n + 1, np.int64)
    long_ = np.flatnonzero(sizes >= length)
    np.add.at(open_, ends[long_] - sizes[long_], 1)
    np.add.at(open_, ends[long_] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
    if not len(at):
        return empty
    trigger = least[at].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(trigger) != 0)])
    low, high, trigger = at[new], at[np.r_[new[1:] - 1, len(at) - 1]], trigger[new]
    doc = np.searchsorted(ends, low, side="right")
    if not told:
        return {"doc": doc, "gram": hashed[trigger].view(np.int64)}
    count, off = high - low + 1, trigger - low
    form = (count.astype(np.uint64) << np.uint64(40)) ^ (off.astype(np.uint64) << np.uint64(20))
    context, check = (mixed(runs(x, low, high + length) ^ form).view(np.int64) for x in (sums, prefix(data, OTHER_BYTES)))
    return {"doc": doc, "gram": hashed[trigger].view(np.int64), "context": context, "check": check, "start": low - (ends - sizes)[doc], "n": count, "trigger": off}


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in parts whose texts are of bounded size together, or of one row."""
    for batch in (part for whole in batches for part in slices(whole)):
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(column).to_pylist()]
        for a, b in blocks([len(t) for t in texts], 1 << 18):
            yield batch.slice(a, b - a), texts[a:b]


def grams(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """gram of each trigger. rows: key, mark, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(parse(texts, length, gram, told=False)["gram"])})

    return rows.select("text").mapInArrow(run, "gram long")


def parsed(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """key, mark, gram, context, check, place of each trigger. rows: key, mark, text.

    place holds start * 2**16 + n * 2**8 + (trigger less start). A null text has no triggers, nor has
    one shorter than length. Repeated rows give repeated rows; no rows none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 2):
            made = parse(texts, length, gram)
            take = pa.array(made["doc"], pa.int64())
            place = (made["start"] << 16) | (made["n"] << 8) | made["trigger"]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(take), "mark": batch.column(1).take(take), "gram": pa.array(made["gram"]), "context": pa.array(made["context"]), "check": pa.array(made["check"]), "place": pa.array(place)})

    return rows.select("key", "mark", "text").mapInArrow(run, "key long, mark long, gram long, context long, check long, place long")


COPY = "key long, mark long, gram long, context long, once boolean, place long, bytes binary"


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted context with the place where they were read. rows: key, mark, text, wanted."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in COPY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[tuple] = []
            for key, mark, t, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "mark", "text", "wanted")), strict=True):
                data = (t or "").encode("utf-8", "replace")
                for w in wanted:
                    start, n = w["place"] >> 16, w["place"] >> 8 & 255
                    out.append((key, mark, w["gram"], w["context"], w["once"], w["place"], data[start : start + n - 1 + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return rows.mapInArrow(run, COPY)


def _sorted(group: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array: the order of parts within their groups, and what each has in common with the one before it (less than 0 across groups)."""
    table = np.zeros((len(parts), width + 4), np.uint8)
    table[:, :4] = group.astype(">u4")[:, None].view(np.uint8)
    table[:, 4:] = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)
    order = np.argsort(table.view(f"S{width + 4}").ravel(), kind="stable")
    differ = table[order[1:]] != table[order[:-1]]
    return order, np.where(differ.any(1), differ.argmax(1), width + 4) - 4


def combined(group: np.ndarray, place: np.ndarray, data: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context (row) and distance from the trigger (column): whether its string has an equal one in its group, and whether it is the first of its kind.

    Distances at which a context has no string are False in both. Contexts of a group have one trigger.
    """
    n, far = place >> 8 & 255, place & 255
    near, most = far - n + 1, length - gram + 1
    right, right_common = _sorted(group, [d[f:] for d, f in zip(data, far.tolist(), strict=True)], length)
    left, left_common = _sorted(group, [d[:f][::-1] for d, f in zip(data, far.tolist(), strict=True)], most)
    again, first = (np.zeros((len(data), most), bool) for _ in range(2))
    rank = np.zeros((2, len(data)), np.int64)
    for d in range(most):
        # Neighbours that share the bytes of such a string on a side have one rank there.
        rank[0][right[1:]] = np.cumsum(right_common < length - d)
        rank[1][left[1:]] = np.cumsum(left_common < d)
        has = np.flatnonzero((near <= d) & (d <= far))
        _, at, kind, count = np.unique(rank[0][has] * len(data) + rank[1][has], return_index=True, return_inverse=True, return_counts=True)
        again[has, d] = count[kind] > 1
        first[has[at], d] = True
    return again, first


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of True."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1] - 1


FOUND = "key long, mark long, a long, b long, digest binary, once boolean"


def _compared(copies: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (a, b) of the texts of contexts that occur once. copies: COPY with parts, the number of parts of their trigger.

    Of triggers in several parts also a digest of each string, once for each part: with a place if it
    is of a context that occurs once and stands once in its part.
    """
    part = F.pmod(F.xxhash64("context"), F.col("parts"))
    sorted_ = copies.withColumn("part", part).repartition("gram", "part").sortWithinPartitions("gram", "part")

    def made(held: list[tuple]) -> pa.RecordBatch:
        key, mark, gram_, _, once, place, data, parts, part_ = zip(*held, strict=True)
        group = np.cumsum([0, *(a != b for a, b in zip(zip(gram_[1:], part_[1:], strict=True), zip(gram_, part_, strict=False), strict=False))])
        place, once, several = np.array(place, np.int64), np.array(once, bool), np.array(parts) > 1
        again, first = combined(group, place, list(data), length, gram)
        row, near, far = _runs(again & once[:, None])
        start, trigger = place >> 16, place & 255
        out = [([key[r] for r in row.tolist()], [mark[r] for r in row.tolist()], start[row] + trigger[row] - far, start[row] + trigger[row] - near + length, [None] * len(row), [True] * len(row))]
        row, d = np.nonzero(first & several[:, None])
        if len(row):
            at = trigger[row] - d
            digest = [hashlib.blake2b(data[r][x : x + length], digest_size=16).digest() for r, x in zip(row.tolist(), at.tolist(), strict=True)]
            alone = once[row] & ~again[row, d]
            out.append(([key[r] for r in row.tolist()], [mark[r] for r in row.tolist()], start[row] + at, start[row] + at + length, digest, alone.tolist()))
        columns = [[x for o in out for x in o[k]] for k in range(6)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in (part for whole in batches for part in slices(whole)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH and (row[2], row[8]) != (held[-1][2], held[-1][8]):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    return sorted_.mapInArrow(run, FOUND)


def repeated_spans(rows: DataFrame, length: int = 200, gram: int = GRAM, say=None) -> DataFrame:
    """key, mark, spans: for each text with repeated strings the maximal byte ranges (a, b) they cover, in order.

    rows: key, mark, text; a text is told by key and mark together. All is counted on rows as given.
    Null keys are keys of their own; no rows give none.
    """
    if not 0 < length - gram < 255:
        raise ValueError("length must be above gram by 1 to 254")
    t = Tables(rows.sparkSession)
    # Written apart from its sums, so that both sides of the join are dealt for it and a frequent gram can be split.
    twice = t.keep("grams", grams(rows, length, gram).groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"))
    shared = t.keep("shared", parsed(rows, length, gram).join(twice.hint("merge"), "gram"))
    # One row for each context. Where it occurs once that is its only row, so no join has to find it again.
    one = [F.first(c).alias(c) for c in ("key", "mark", "gram", "place")]
    each = t.keep("contexts", shared.groupBy("context", "check").agg((F.count("*") == 1).alias("once"), *one))
    own = t.keep("own", each.where("once").select("gram").distinct())
    columns = ("key", "mark", "gram", "context", "once", "place")
    beside = each.where("NOT once").join(own.hint("merge"), "gram", "left_semi")
    compared = t.keep("compared", each.where("once").select(*columns).unionByName(beside.select(*columns)))
    if say:
        say("once", each.where("once").count(), "compared", compared.count())
    asked = compared.groupBy("key", "mark").agg(F.collect_list(F.struct("place", "context", "gram", "once")).alias("wanted"))
    parts = t.keep("parts", compared.groupBy("gram").agg(F.ceil(F.count("*") / CHUNK).alias("parts")).where("parts > 1"))
    several = parts.count()
    copies = _copies(_with(rows, asked, "inner"), length)
    sized = attach(copies, parts, ["gram"], several, "left", most=BROADCAST_NUMBERS).select("key", "mark", "gram", "context", "once", "place", "bytes", F.coalesce("parts", F.lit(1)).alias("parts"))
    found = t.keep("found", _compared(sized, length, gram))
    open_ = found.where("digest IS NULL").select("key", "mark", "a", "b")
    if several:
        again = found.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
        open_ = open_.unionByName(found.where("once").join(again, "digest").select("key", "mark", "a", "b"))
    # Told as a place whose last byte is its kind. A set holds what copies of a row repeat only once.
    kind = lambda df, k: df.select("key", "mark", (F.shiftleft(F.shiftright("place", 8), 8) + F.lit(k)).alias("s"))
    place = F.shiftleft(F.col("a"), 16) + F.shiftleft(F.col("b") - F.col("a") - length + 1, 8)
    every = kind(shared, READ).unionByName(kind(each.where("once"), ONCE)).unionByName(kind(open_.withColumn("place", place), EQUAL))
    lists = every.groupBy("key", "mark").agg(F.collect_set("s").alias("spans"))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            made = [merged(_settled(s, length)) for s in batch.column(2).to_pylist()]
            spans = pa.array([[{"a": a, "b": b} for a, b in m] for m in made], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], ["key", "mark", "spans"]).filter(pa.array([bool(m) for m in made]))

    spans = t.keep("spans", lists.mapInArrow(covered, "key long, mark long, spans array<struct<a:long,b:long>>"))
    t.drop(*(name for name in list(t.paths) if name != "spans"))
    return spans


#: Kinds of places: all contexts as read, those that occur once, strings of these that have an equal one.
READ, ONCE, EQUAL = 0, 1, 2


def _settled(places: list[int], length: int) -> list[tuple[int, int]]:
    """The ranges of places that are repeated: all that were read but those that occur once, and strings with an equal one."""
    once = {p >> 8 for p in places if p & 255 == ONCE}
    return [(p >> 16, (p >> 16) + (p >> 8 & 255) - 1 + length) for p in places if p & 255 == EQUAL or p & 255 == READ and p >> 8 not in once]


def _with(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """rows with the lists of their texts, by shuffle at every size: the lists grow with the corpus."""
    on = [rows["key"].eqNullSafe(lists["key"]), rows["mark"].eqNullSafe(lists["mark"])]
    return rows.join(lists.hint("merge"), on[0] & on[1], how).select(*(rows[c] for c in rows.columns), *(lists[c] for c in lists.columns if c not in ("key", "mark")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = GRAM, say=None) -> DataFrame:
    """The columns of docs with n_bytes, removed (ranges of bytes) and kept (the bytes left, joined).

    Each byte goes that is covered by a ``length``-byte string of its own text that also starts
    elsewhere in any text, the same one included; strings never cross texts and are judged on the
    input. A null or empty text has no bytes. Repeated rows repeat each other, so all of their bytes
    go if they have length or more. Rows are told by key and text, so keys may be null or repeated.
    No rows give none. Columns of docs with these names are replaced. Texts of any length are
    treated whole.
    """
    docs = docs.drop("n_bytes", "removed", "kept")
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias("key"), mark.alias("mark"), F.col(text).alias("text"))
    spans = repeated_spans(rows, length, gram, say)
    wide = docs.withColumns({"key_": F.col(key).cast("long"), "mark_": mark})
    side = spans.select(F.col("key").alias("k_"), F.col("mark").alias("m_"), "spans")
    joined = wide.join(side.hint("merge"), F.col("key_").eqNullSafe(F.col("k_")) & F.col("mark_").eqNullSafe(F.col("m_")), "left").drop("key_", "mark_", "k_", "m_")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, gone, left = [], [], []
            for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "replace")
                ranges = [(x["a"], x["b"]) for x in s or ()]
                parts, last = [], 0
                for a, b in ranges:
                    parts.append(data[last:a])
                    last = b
                sizes.append(len(data))
                gone.append([{"a": a, "b": b} for a, b in ranges])
                left.append(b"".join([*parts, data[last:]]))
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(left, pa.binary())], [*names, "n_bytes", "removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{fields}, n_bytes long, removed array<struct<a:long,b:long>>, kept binary")


