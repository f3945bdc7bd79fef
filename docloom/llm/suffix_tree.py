"""Language-model scoring by a probabilistic suffix tree over words.

A state is a context of one or two words before a token; the root is the empty context. A state stays
in the tree if it occurs often enough, its suffix stays, and its next-symbol distribution diverges
from its suffix's: the count-weighted divergence must reach `gain` nats. Distributions are smoothed
by absolute discounting towards the suffix's, the root's by adding one. A token is scored in the
state of its longest context in the tree.

The work is done on packed blocks of whole documents, with local word codes. Words get their numbers
and counts by one exchange by word. Then every occurrence of two or three words goes, packed and
without repeats inside a document, to the bucket of the context's last word, where the whole subtree
of that word is built, tested, and used at once for the documents' own scores; only sums by document
come back. So no table of all n-grams is ever stored or broadcast. A word that alone would outgrow a
bucket is hot: its occurrences are dealt by the word before it, for a hot pair also by the word
behind it, and the hot contexts' own distributions, summed before, are sent to each of those buckets.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import Tables
from docloom.llm.words import tokens, word_hash

#: Tokens of a block of documents, occurrences that a bucket should hold, and buckets that a task goes through one after another.
BLOCK, BUCKET, TURNS = 1_000_000, 800_000, 3
#: A word with more occurrences than so many buckets should hold is hot.
HOT = 1.2
#: Sums by bucket and document are rounded to this, far below what a score is read to, so that they pack well.
GRAIN = 2.0**-26
#: A block names the pairs of words that make up more than this share of it.
SHARE = 1 / 4096


@dataclass(frozen=True)
class Tree:
    """Occurrences and nats that a state needs, occurrences that a next symbol of its own needs, and the discount."""

    least: int = 8
    gain: float = 10.0
    symbol: int = 2
    discount: float = 0.75


def held_out(key: Column) -> Column:
    """Whether a document is kept out of training; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def packed(*arrays: np.ndarray) -> bytes:
    """Whole-number or float arrays as one string: compressed by place of their bytes."""
    out = []
    for x in arrays:
        data = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
        small = pa.compress(data, codec="zstd", asbytes=True) if data else b""
        out.append(struct.pack("<4sIQ", x.dtype.str.encode().ljust(4), len(x), len(small)) + small)
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n, size = struct.unpack_from("<4sIQ", blob, at)
        at += 16
        dtype = np.dtype(kind.decode().strip())
        data = pa.decompress(blob[at : at + size], n * dtype.itemsize, codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += size
    return out


BLOCKS = "block long, keys array<{kind}>, docs binary, codes binary, words binary, hot array<struct<a:long,b:long,n:long>>, n_tokens long, n_words long"


def _blocks(kind: pa.DataType, most: int):
    def closed(number: int, keys: list, texts: list, sizes: list, train: list) -> pa.RecordBatch:
        every = pa.chunked_array(texts, pa.large_string()).combine_chunks()
        coded = every.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        n = np.concatenate(sizes)
        ends = np.cumsum(n)
        codes = np.insert(codes.astype(np.int64), ends, len(words))  # the end of each document is a symbol too
        n = n + 1
        used = np.bincount(codes, minlength=len(words) + 1)
        order = np.argsort(-used, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[codes]
        hashes = np.array([word_hash(w) for w in words.cast(pa.large_binary()).to_pylist()] + [word_hash(b"")], np.int64)[order]
        limit = max(8, len(codes) * SHARE)
        often = np.zeros(len(order), bool)
        often[: int((used[order] > limit).sum())] = True
        last = np.zeros(len(codes), bool)
        last[np.cumsum(n) - 1] = True
        both = np.flatnonzero(often[codes[:-1]] & often[codes[1:]] & ~last[:-1] & ~last[1:])
        pairs, count = np.unique(codes[both] * len(order) + codes[both + 1], return_counts=True)
        hot = [{"a": int(hashes[p // len(order)]), "b": int(hashes[p % len(order)]), "n": int(c)} for p, c in zip(pairs[count > limit].tolist(), count[count > limit], strict=True)]
        row = {
            "block": pa.array([number], pa.int64()),
            "keys": pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(kind)),
            "docs": pa.array([packed(n.astype(np.uint32), np.concatenate(train).astype(np.uint8))], pa.binary()),
            "codes": pa.array([packed(codes.astype(np.uint32))], pa.binary()),
            "words": pa.array([hashes.tobytes()], pa.binary()),
            "hot": pa.array([hot], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))),
            "n_tokens": pa.array([len(codes)], pa.int64()),
            "n_words": pa.array([len(order)], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, sizes = tokens(part.column(1))
                for to, x in zip(parts, (part.column(0), words, sizes, part.column(2).to_numpy(zero_copy_only=False)), strict=True):
                    to.append(x)
                held += len(words) + part.num_rows
                if held >= most:
                    yield closed(number, *parts)
                    number, held, parts = number + 1, 0, ([], [], [], [])
        if held:
            yield closed(number, *parts)

    return run


def _word_parts(buckets: int):
    """For each block and bucket of words: hashes, local codes, and counts in training and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, codes, words in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "codes", "words")), strict=True):
                (n, train), (code,), hashes = unpacked(docs), unpacked(codes), np.frombuffer(words, np.int64)
                every = np.bincount(code, minlength=len(hashes))
                trained = np.bincount(code[np.repeat(train, n) > 0], minlength=len(hashes))
                bucket = hashes % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                blobs = [packed(hashes[p], p.astype(np.uint32), trained[p], every[p]) for k in range(buckets) if len(p := order[cuts[k] : cuts[k + 1]])]
                there = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(there, pa.int32()), "block": pa.array(np.full(len(there), block), pa.int64()), "payload": pa.array(blobs, pa.binary())})

    return run


#: Rows for blocks have payload (local codes, ids, training counts); block -1 is for totals, -2 for hot words and words of hot pairs.
IDS = "block long, payload binary, n long, v long, id long, hash long"


def _word_ids(buckets: int, limit: float, asked: frozenset[int]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        parts = [unpacked(x) for x in rows["payload"].to_pylist()]
        hashes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        trained, every = (np.bincount(inverse, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (2, 3))
        ids = np.empty(len(hashes), np.int64)
        ids[np.argsort(-every, kind="stable")] = np.arange(len(hashes)) * buckets + number  # frequent words get small numbers
        out, at = [], 0
        for block, p in zip(rows["block"].to_pylist(), parts, strict=True):
            own = inverse[at : at + len(p[0])]
            at += len(p[0])
            out.append((block, packed(p[1], ids[own], trained[own]), None, None, None, None))
        out.append((-1, None, int(trained.sum()), int((trained > 0).sum()), None, None))
        end = word_hash(b"")
        for k in np.flatnonzero((every > limit) | np.isin(hashes, list(asked))).tolist():
            if hashes[k] != end:
                out.append((-2, None, int(every[k]), None, int(ids[k]), int(hashes[k])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=["block", "payload", "n", "v", "id", "hash"])

    return run


@dataclass(frozen=True)
class Hot:
    """Hot words with their number of buckets, hot pairs, and (occurrences, weight of the suffix, stays) of each as a state."""

    words: dict[int, int]
    pairs: frozenset[tuple[int, int]]
    states: dict[tuple[int, int], tuple[int, float, bool]]


def _mixed(x: np.ndarray) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1)


def _hot_pairs(a: np.ndarray, b: np.ndarray, hot: Hot) -> np.ndarray:
    """Which of the pairs of ids are hot ones."""
    words = np.array(sorted(hot.words) or [-2], np.int64)
    at = lambda x: np.searchsorted(words, x).clip(max=len(words) - 1)
    number = lambda x, y: np.where((words[at(x)] == x) & (words[at(y)] == y), at(x) * len(words) + at(y), -1)
    pairs = np.array(sorted(hot.pairs), np.int64).reshape(-1, 2)
    n = number(a, b)
    return (n >= 0) & np.isin(n, number(pairs[:, 0], pairs[:, 1]))


def dealt(b: np.ndarray, a: np.ndarray, w: np.ndarray, hot: Hot, buckets: int) -> np.ndarray:
    """The bucket of each occurrence of w behind a and b: that of b; a hot b has several, told by a, for a hot pair also by w."""
    own = _mixed(b)
    words = np.array(sorted(hot.words), np.int64)
    at = np.flatnonzero(np.isin(b, words))
    if len(at):
        wide = np.array([hot.words[x] for x in words.tolist()], np.uint64)[np.searchsorted(words, b[at])]
        spread = _mixed(a[at] + 1) + np.where(_hot_pairs(a[at], b[at], hot), _mixed(w[at] + 7), np.uint64(0))
        own[at] += spread % wide
    return (own % np.uint64(buckets)).astype(np.int64)


def _each(made):
    """made(block) for each row of blocks with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from made(batch.slice(k, 1).to_pylist()[0]).to_batches()

    return run


def _read(row: dict) -> tuple[np.ndarray, ...]:
    """Lengths and training flags of a block's documents, local codes of its tokens, and id and training count of its codes."""
    (n, train), (code,) = unpacked(row["docs"]), unpacked(row["codes"])
    table, counts = (np.zeros(row["n_words"], np.int64) for _ in range(2))
    for blob in row["ids"]:
        at, its, c = unpacked(blob)
        table[at], counts[at] = its, c
    return n.astype(np.int64), train, code.astype(np.int32), table, counts


def _history(n: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, place in it, and the one and two codes before (-1: none) of each token."""
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    b, a = np.full(len(code), -1, np.int32), np.full(len(code), -1, np.int32)
    b[1:], a[2:] = code[:-1], code[:-2]
    b[place < 1], a[place < 2] = -1, -1
    return doc, place, b, a


def _hot_counts(hot: Hot):
    """Training counts of the next symbols of hot contexts in a block; a is -1 for a context of one word."""

    def run(row: dict) -> pa.Table:
        n, train, code, table, counts = _read(row)
        doc, _, b, a = _history(n, code)
        is_hot = np.append(np.isin(table, list(hot.words)), False)  # the last place is for none
        at = np.flatnonzero(is_hot[b] & (train[doc] > 0))
        before, own, code = np.where(a[at] >= 0, table[a[at]], -1), table[b[at]], code[at]
        twice = np.flatnonzero(_hot_pairs(before, own, hot))
        a = np.concatenate([np.full(len(at), -1), before[twice]])
        b, code = np.append(own, own[twice]), np.append(code, code[twice])
        group, first = _groups(a, b, code)
        made = {"a": a[first], "b": b[first], "w": table[code[first]], "c": np.bincount(group, minlength=len(first)), "cw": counts[code[first]]}
        return pa.table({k: pa.array(x.astype(np.int64)) for k, x in made.items()})

    return run


#: kind 0: occurrences; 1: distribution of a hot context; 2: what a block's documents have without contexts.
EVENTS = "bucket int, kind int, block long, payload binary, keys array<{kind}>"


def _events(kind: pa.DataType, hot: Hot, buckets: int, n_train: int, n_kinds: int, tree: Tree):
    def run(row: dict) -> pa.Table:
        block = row["block"]
        n, train, code, table, counts = _read(row)
        doc, _, b, a = _history(n, code)
        root = np.log10((counts + 1) / (n_train + n_kinds + 1))
        deep = (b >= 0) & (counts[b] >= tree.least)  # else the root scores the token
        sums = lambda x: np.bincount(doc, x, minlength=len(n))
        base, alone = sums(root[code]), sums(np.where(deep, 0.0, root[code]))
        out = [(block % -(-buckets // TURNS), 2, block, packed(n, train, sums(counts[code] > 0).astype(np.int64), base, alone), row["keys"])]
        # By number, so that equal occurrences lie together in each bucket and codes grow with them.
        order = np.argsort(table, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        often = counts >= tree.least
        table, counts = table[order], counts[order]
        at = np.flatnonzero(deep)
        b, w, doc = rank[b[at]], rank[code[at]], doc[at]
        a = np.where((a[at] >= 0) & (often[a[at]]), rank[a[at]], -1)  # a rarer word makes no state with b
        size = len(table) + 1
        sort = np.lexsort((w.astype(np.int64) * len(n) + doc, b.astype(np.int64) * size + a + 1))
        b, a, w, doc = b[sort], a[sort], w[sort], doc[sort]
        new = np.ones(len(b), bool)
        new[1:] = (np.diff(b) != 0) | (np.diff(a) != 0) | (np.diff(w) != 0) | (np.diff(doc) != 0)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(b)))
        b, a, w, doc = b[first], a[first], w[first], doc[first]
        bucket = dealt(table[b], np.where(a >= 0, table[a], -1), table[w], hot, buckets)
        to = np.argsort(bucket, kind="stable")
        bucket = bucket[to]
        place = np.zeros(size, np.int64)
        for k in range(-(-buckets // TURNS)):
            cuts = np.searchsorted(bucket, np.arange(k * TURNS, (k + 1) * TURNS + 1))
            p = to[cuts[0] : cuts[-1]]
            if not len(p):
                continue
            there = np.zeros(size, bool)
            there[b[p]] = there[w[p]] = there[a[p]] = True  # -1, for none, is the last place
            there[-1] = False
            used = np.flatnonzero(there)
            place[used] = np.arange(1, len(used) + 1)
            u = lambda x: x.astype(np.uint32)
            out.append((k, 0, block, packed(np.diff(table[used], prepend=0), counts[used], u(place[b[p]]), u(np.where(a[p] >= 0, place[a[p]], 0)), u(place[w[p]]), u(2 * doc[p] + train[doc[p]]), u(times[p]), cuts - cuts[0]), None))
        return _event_table(out, kind)

    return run


def _event_table(out: list[tuple], kind: pa.DataType) -> pa.Table:
    columns = list(zip(*out, strict=True)) or [[]] * 5
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(kind))
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["bucket", "kind", "block", "payload", "keys"])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of equal keys, groups in order of the keys, and a row of each."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    group = np.empty(len(order), np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    return group, order[new]


def _states(group: np.ndarray, c: np.ndarray, parent: np.ndarray, tree: Tree, fixed: dict[int, tuple[int, float, bool]], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each symbol in its state, and whether the state stays. fixed: states known from elsewhere."""
    n = len(allowed)
    own = np.where(c >= tree.symbol, c, 0)
    cut = np.where(c >= tree.symbol, c - tree.discount, 0.0)
    total, kept, seen = (np.bincount(group, x, minlength=n) for x in (c, cut, own))
    suffix = np.where(total > 0, (total - kept) / np.maximum(total, 1), 1.0)
    for k, (t, s, _) in fixed.items():
        total[k], suffix[k] = t, s
    p = cut / np.maximum(total[group], 1) + suffix[group] * parent
    nats = np.bincount(group, own * np.log(p / parent), minlength=n) + (total - seen) * np.log(suffix)
    stays = allowed & (total >= tree.least) & (nats >= tree.gain)
    for k, (_, _, s) in fixed.items():
        stays[k] = s
    return p, stays


SCORES = "block long, kind int, payload binary, keys array<{kind}>"


def _bucket_gains(parts: list[list[np.ndarray]], turn: int, known: dict, hot: Hot, n_train: int, n_kinds: int, tree: Tree) -> list[tuple[np.ndarray, np.ndarray]]:
    """Builds the subtrees of one bucket's contexts; for each part the documents of its occurrences and what these add to their scores."""
    cut = [slice(int(p[7][turn]), int(p[7][turn + 1])) for p in parts]
    ids = [np.concatenate([[-1], np.cumsum(p[0])]) for p in parts]
    if max(int(i[-1]) for i in ids) < 1 << 31:
        ids = [i.astype(np.int32) for i in ids]
    column = lambda k: np.concatenate([i[p[k][c]] for i, p, c in zip(ids, parts, cut, strict=True)])
    b, a, w = column(2), column(3), column(4)
    docs = [p[5][c].astype(np.int32) for p, c in zip(parts, cut, strict=True)]
    if not len(b):
        return [(d, np.zeros(0)) for d in docs]
    cw = np.concatenate([p[1][p[4][c].astype(np.int64) - 1] for p, c in zip(parts, cut, strict=True)])
    times = np.concatenate([p[6][c].astype(np.int32) for p, c in zip(parts, cut, strict=True)])
    tri, first = _groups(b, a, w)
    cw, tb, ta, tw = cw[first], b[first], a[first], w[first]
    c3 = np.bincount(tri, times * (np.concatenate(docs) & 1)).astype(np.int64)
    b = a = w = None
    pair, one = _groups(tb, tw)
    c2 = np.bincount(pair, c3).astype(np.int64)
    pb, pw = tb[one], tw[one]
    root = (cw[one] + 1) / (n_train + n_kinds + 1)

    def whole(c: np.ndarray, symbols: np.ndarray, at: np.ndarray, context: tuple[int, int]) -> None:
        """Counts of a hot context's symbols, which lie in several buckets."""
        its, count = known.get(context, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        there = np.isin(symbols[at], its)
        c[at] = 0
        c[at[there]] = count[np.searchsorted(its, symbols[at[there]])]

    word, w1 = _groups(pb)
    fixed = {}
    for k in np.flatnonzero(np.isin(pb[w1], list(hot.words))).tolist():
        x = int(pb[w1[k]])
        fixed[k] = hot.states[-1, x]
        whole(c2, pw, np.flatnonzero(word == k), (-1, x))
    p1, stays1 = _states(word, c2, root, tree, fixed, np.ones(len(w1), bool))
    p1 = np.where(stays1[word], p1, root)
    two, t1 = _groups(tb, ta)
    fixed = {}
    for k in np.flatnonzero(_hot_pairs(ta[t1], tb[t1], hot)).tolist():
        x = int(ta[t1[k]]), int(tb[t1[k]])
        fixed[k] = hot.states[x]
        whole(c3, tw, np.flatnonzero(two == k), x)
    p2, stays2 = _states(two, c3, p1[pair], tree, fixed, (ta[t1] >= 0) & stays1[word][pair][t1])
    gain = times * np.log10(np.where(stays2[two], p2, p1[pair]))[tri]
    return [(d >> 1, g) for d, g in zip(docs, np.split(gain, np.cumsum([len(d) for d in docs])[:-1]), strict=True)]


def _scores(kind: pa.DataType, hot: Hot, n_train: int, n_kinds: int, tree: Tree):
    """Goes through a task's buckets in turn, and sums what their occurrences add to each document's score."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_numpy()
        of = lambda kind: rows.filter(pa.array(kinds == kind))
        out = [(r["block"], 2, r["payload"], r["keys"]) for r in of(2).to_pylist()]
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for blob in of(1)["payload"]:
            context, w, c = unpacked(blob.as_py())
            known[int(context[0]), int(context[1])] = w, c  # sorted by w
        mine = of(0)
        if mine.num_rows:
            # One by one, so that the packed strings are not held beside the arrays as Python objects.
            parts, blocks = [unpacked(x.as_py()) for x in mine["payload"]], mine["block"].to_pylist()
            sums = [np.zeros(int(p[5].max() >> 1) + 1) for p in parts]
            for turn in range(TURNS):
                for total, (doc, gain) in zip(sums, _bucket_gains(parts, turn, known, hot, n_train, n_kinds, tree), strict=True):
                    total += np.bincount(doc, gain, minlength=len(total))
            for block, total in zip(blocks, sums, strict=True):
                docs = np.flatnonzero(total)
                out.append((block, 0, packed(docs.astype(np.uint32), np.round(total[docs] / GRAIN) * GRAIN), None))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.list_(kind)), strict=True)], names=["block", "kind", "payload", "keys"])

    return run


def _totals(kind: pa.DataType, key: str, n_train: int):
    def run(rows: pa.Table) -> pa.Table:
        whole = rows["kind"].to_pylist().index(2)
        n, train, n_known, base, score = unpacked(rows["payload"][whole].as_py())
        score = score.copy()
        for k, blob in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
            if k == 0:
                docs, total = unpacked(blob)
                score[docs] += total
        return pa.table({key: pa.array(rows["keys"][whole].as_py(), kind), "held_out": pa.array(train == 0), "n_tokens": pa.array(n), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(n), n_train)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _hot_states(counts: DataFrame, n_train: int, n_kinds: int, tree: Tree) -> dict[tuple[int, int], tuple[int, float, bool]]:
    """(occurrences, weight of the suffix, stays) of each hot context; there are at most a few for each bucket.

    counts: a (-1: none), b, w, c, cw: whole training counts of the contexts' symbols.
    """
    own = F.when(F.col("c") >= tree.symbol, F.col("c")).otherwise(0)
    cut = F.when(F.col("c") >= tree.symbol, F.col("c") - tree.discount).otherwise(0.0)
    sums = counts.groupBy("a", "b").agg(F.sum("c").alias("total"), F.sum(cut).alias("kept"), F.sum(own).alias("seen"))
    weighed = sums.withColumn("suffix", (F.col("total") - F.col("kept")) / F.col("total"))
    root = (F.col("cw") + 1) / F.lit(float(n_train + n_kinds + 1))

    def judged(rows: DataFrame, parent: Column) -> list:
        p = cut / F.col("total") + F.col("suffix") * parent
        return rows.groupBy("a", "b").agg(F.first("total").alias("total"), F.first("suffix").alias("suffix"), F.first("seen").alias("seen"), F.sum(own * F.log(p / parent)).alias("nats")).collect()

    stays = lambda r, allowed: bool(allowed and r.total >= tree.least and r.nats + (r.total - r.seen) * math.log(r.suffix) >= tree.gain)
    few = F.broadcast(weighed)  # a row for each hot context
    words = {(r.a, r.b): (r.total, r.suffix, stays(r, True)) for r in judged(counts.where("a = -1").join(few, ["a", "b"]), root)}
    inner = counts.where("a = -1").join(few, ["a", "b"]).select("b", "w", (cut / F.col("total") + F.col("suffix") * root).alias("parent"))
    lasting = [b for (_, b), s in words.items() if s[2]]
    parent = F.when(F.col("b").isin(lasting), F.col("parent")).otherwise(root) if lasting else root
    pairs = counts.where("a <> -1").join(few, ["a", "b"]).join(inner, ["b", "w"])
    return words | {(r.a, r.b): (r.total, r.suffix, stays(r, words[-1, r.b][2])) for r in judged(pairs, parent)}


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", tree: Tree = Tree(), block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Tokens are the words of the lower-cased (A-Z) text and one end. The model learns from the rows that
    are not held_out and scores all; score is its log10 probability of the whole text, base_score that
    of single words with one added to each count. A null or empty text is the end alone. Repeated rows
    count and are scored each; other columns are not read; an empty table gives an empty one. Without
    any row to learn from every token is unknown.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = docs.select(docs[key], docs[text], (~held_out(docs[key])).alias("train"))
    kind = rows.schema[0].dataType.simpleString()
    arrow = to_arrow_type(rows.schema[0].dataType)
    blocks = tables.keep("blocks", rows.mapInArrow(_blocks(arrow, block), BLOCKS.format(kind=kind)))
    held = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    if not held.tokens:
        return spark.createDataFrame([], f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    buckets, word_buckets = -(-held.tokens // bucket), -(-held.words // bucket)
    limit = HOT * held.tokens / buckets if buckets > HOT else held.tokens
    pairs = blocks.select(F.explode("hot").alias("h")).groupBy("h.a", "h.b").agg(F.sum("h.n").alias("n")).where(F.col("n") > limit).select("a", "b").collect()
    asked = frozenset(x for p in pairs for x in p)
    parts = blocks.select("block", "docs", "codes", "words").mapInArrow(_word_parts(word_buckets), "bucket int, block long, payload binary")
    ids = tables.keep("ids", parts.groupBy("bucket").applyInArrow(_word_ids(word_buckets, limit, asked), IDS))
    seen = ids.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    named = {r.hash: (r.id, r.n) for r in ids.where("block = -2").select("hash", "id", "n").collect()}
    words = {i: -(-n // bucket) for i, n in named.values() if n > limit}
    hot = Hot(words, frozenset((named[a][0], named[b][0]) for a, b in pairs if named[a][0] in words and named[b][0] in words), {})
    answers = ids.where("block >= 0").groupBy("block").agg(F.collect_list("payload").alias("ids"))  # one for each bucket of words
    lines = tables.keep("lines", blocks.select("block", "keys", "docs", "codes", "n_words").join(answers, "block"))
    tables.drop("blocks", "ids")
    more = None
    if hot.words:
        found = lines.mapInArrow(_each(_hot_counts(hot)), "a long, b long, w long, c long, cw long")
        counts = tables.keep("hot", found.groupBy("a", "b", "w").agg(F.sum("c").alias("c"), F.first("cw").alias("cw")))
        hot = Hot(words, hot.pairs, _hot_states(counts, seen.n, seen.v, tree))
        more = _distributions(counts.where(F.col("c") >= tree.symbol), hot, buckets, kind)
    events = lines.mapInArrow(_each(_events(arrow, hot, buckets, seen.n, seen.v, tree)), EVENTS.format(kind=kind))
    events = events if more is None else events.unionByName(more)
    scores = events.groupBy("bucket").applyInArrow(_scores(arrow, hot, seen.n, seen.v, tree), SCORES.format(kind=kind))
    return scores.groupBy("block").applyInArrow(_totals(arrow, key, seen.n), f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _distributions(entries: DataFrame, hot: Hot, buckets: int, kind: str) -> DataFrame:
    """The symbols of each hot context with their counts, packed once for each bucket that may ask for them."""
    spread = F.create_map(*(F.lit(x) for word, wide in hot.words.items() for x in (word, min(wide, buckets))))
    at = {word: int(_mixed(np.array([word]))[0] % np.uint64(buckets)) for word in hot.words}
    start = F.create_map(*(F.lit(x) for word, first in at.items() for x in (word, first)))
    places = F.transform(F.sequence(F.lit(0), F.element_at(spread, F.col("b")) - 1), lambda k: F.floor((F.element_at(start, F.col("b")) + k) % buckets / TURNS).cast("int"))
    dealt_ = entries.withColumn("bucket", F.explode(F.array_distinct(places)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, a, b = (k.as_py() for k in key)
        w, c = rows["w"].to_numpy(), rows["c"].to_numpy()
        order = np.argsort(w)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([1], pa.int32()), "block": pa.array([-1], pa.int64()), "payload": pa.array([packed(np.array([a, b]), w[order], c[order])], pa.binary())})

    made = dealt_.groupBy("bucket", "a", "b").applyInArrow(run, "bucket int, kind int, block long, payload binary")
    return made.withColumn("keys", F.lit(None).cast(f"array<{kind}>"))
