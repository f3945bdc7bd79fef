"""Hard-negative mining by bit-sliced integer products.

Vectors are whole numbers in two's complement. The inner products of a block of anchors and a block
of rows are taken bit-plane by bit-plane of the rows' components, the most significant first. What
the planes still to come can add is bounded by the anchor's positive and negative parts, so after
each plane a score lies in an interval; rows whose interval can't qualify any more are dropped. While
many are left a plane is one matrix product, then only the pairs left are summed. Scores of rows that
come through are exact. Anchors are a stated set of queries, held against all rows in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import Tables

#: Rows and anchors of one block, and anchors of one step in it.
ROWS, ANCHORS, STEP = 16_384, 4096, 128
#: A plane is a matrix product while more than this share of the pairs is left.
DENSE = 0.1
PAIRS = 1 << 16


def planes(low: int, high: int) -> int:
    """Bits below the sign that hold all numbers from low to high."""
    return max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0)


def bit_sliced(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, bits: int, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that come through, with exact scores.

    alive: which pairs take part. keep(anchor, row, low, high) says which of these pairs may still
    qualify when their scores lie from low to high; it is asked after each plane.
    """
    more, less = np.maximum(anchors, 0).sum(1), np.maximum(-anchors, 0).sum(1)
    score = np.zeros(alive.shape, np.float64)
    a, r = np.nonzero(alive)
    s = None  # scores of the pairs left, once these are few
    for k in range(bits, -1, -1):  # the sign is plane number bits
        plane = ((rows >> k) & 1).astype(np.float64)
        weight = -float(1 << k) if k == bits else float(1 << k)
        if s is None and len(a) <= DENSE * alive.size:
            s = score[a, r]
            score = np.zeros((0, 0))
        if s is None:
            score += weight * (anchors @ plane.T)
            now = score[a, r]
        else:
            for at in range(0, len(a), PAIRS):
                part = slice(at, at + PAIRS)
                s[part] += weight * np.einsum("ij,ij->i", anchors[a[part]], plane[r[part]])
            now = s
        rest = float((1 << k) - 1)
        stay = keep(a, r, now - rest * less[a], now + rest * more[a])
        a, r = a[stay], r[stay]
        s = s[stay] if s is not None else None
    return a, r, (score[a, r] if s is None else s).astype(np.int64)


def _kth(a: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n anchors the k-th largest value of its pairs; minus infinity where there are fewer."""
    order = np.lexsort((-value, a))
    starts = np.searchsorted(a[order], np.arange(n + 1))
    out = np.full(n, -np.inf)
    enough = np.diff(starts) >= k
    out[enough] = value[order[starts[:-1][enough] + k - 1]]
    return out


def _first(a: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's first k pairs by falling score, then id, then row."""
    order = np.lexsort((row, ids, -score, a))
    group = a[order]
    begun = np.searchsorted(group, group)  # where the anchor's pairs begin
    return order[np.arange(len(order)) - begun < k]


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(c.flatten(), np.int64) for c in column.chunks)]).reshape(len(column), size)


def _positives(size: int, bits: int, count: int):
    """Of each anchor, the first rows of its label in the block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        x, q = _matrix(rows["q"], size), _matrix(anchors["q"], size)
        ids, row, label = (rows[c].to_numpy() for c in ("vec_id", "r", "label"))
        own, its = anchors["r"].to_numpy(), anchors["label"].to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q), STEP):
            qs, n = q[at : at + STEP], min(STEP, len(q) - at)
            alive = (its[at : at + STEP, None] == label) & (own[at : at + STEP, None] != row)

            def keep(a, r, low, high, n=n):
                return high >= _kth(a, low, count, n)[a]

            a, r, s = bit_sliced(qs.astype(np.float64), x, alive, bits, keep)
            best = _first(a, s, ids[r], row[r], count)
            found.append((own[at + a[best]], s[best], ids[r[best]], row[r[best]]))
        return _table(("anchor", "score", "vec_id", "r"), found)

    return run


def _negatives(size: int, bits: int, count: int, low: int, high: int):
    """Of each anchor and positive, the first rows of other labels in the block whose score lies within its share."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        x, q = _matrix(rows["q"], size), _matrix(anchors["q"], size)
        ids, row, label = (rows[c].to_numpy() for c in ("vec_id", "r", "label"))
        own, its, place, wanted = (anchors[c].to_numpy() for c in ("r", "label", "place", "score"))
        least, most = -((-low * wanted) // 100), high * wanted // 100  # whole scores, so both ends are exact
        found: list[tuple[np.ndarray, ...]] = []
        each = np.unique(own, return_index=True)[1]  # an anchor's rows differ in their positives alone
        for at in range(0, len(each), STEP):
            firsts = each[at : at + STEP]
            n, asked = len(firsts), [[p for p in np.flatnonzero(own == own[f]) if least[p] <= most[p]] for f in firsts]
            width = max(map(len, asked))
            if not width:
                continue
            lo, hi = np.full((width, n), np.inf), np.full((width, n), -np.inf)
            for i, ps in enumerate(asked):
                lo[: len(ps), i], hi[: len(ps), i] = least[ps], most[ps]
            alive = (its[firsts, None] != label) & np.isfinite(lo[0])[:, None]

            def keep(a, r, below, above, n=n, lo=lo, hi=hi):
                stay = np.zeros(len(a), bool)
                for least_, most_ in zip(lo, hi, strict=True):
                    sure = (below >= least_[a]) & (above <= most_[a])
                    floor = np.maximum(least_, _kth(a[sure], below[sure], count, n))
                    stay |= (above >= floor[a]) & (below <= most_[a])
                return stay

            a, r, s = bit_sliced(q[firsts].astype(np.float64), x, alive, bits, keep)
            for k in range(width):
                fits = np.flatnonzero((s >= lo[k][a]) & (s <= hi[k][a]))
                best = fits[_first(a[fits], s[fits], ids[r[fits]], row[r[fits]], count)]
                its_place = np.array([place[ps[k]] if k < len(ps) else -1 for ps in asked])
                found.append((own[firsts[a[best]]], its_place[a[best]], s[best], ids[r[best]], row[r[best]]))
        return _table(("anchor", "place", "score", "vec_id", "r"), found)

    return run


def _table(names: tuple[str, ...], parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64)) for i, n in enumerate(names)})


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: int = 256, block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding. A component x counts as floor(scale * x). Anchors are the rows
    whose vec_id is divisible by every; a positive is one of an anchor's first other rows of its label,
    a negative one of the first rows of other labels whose score is from low to high hundredths of the
    positive's. Higher scores come first, ties by smaller vec_id, then by row.

    Rows with a null vec_id or label, a null vector or a component that is null or not finite take no
    part. Shorter vectors count as filled up with zeros, empty ones score 0. Each of several rows with
    one vec_id is a row of its own, also as anchor. Other columns are not read; an empty table, or one
    without anchors, gives no rows. Components whose products could pass 2**53 are refused.

    Blocks of anchors meet blocks of rows, so a task holds one of each whatever the table's size, and
    gives back a few rows for each anchor; hot labels or vectors make no block larger.
    """
    spark = rows.sparkSession
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    tables = Tables(spark)
    used = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(fine)
    base = tables.keep("vectors", used.select("vec_id", "label", whole.alias("q"), F.monotonically_increasing_id().alias("r")))
    is_anchor = F.col("vec_id") % every == 0
    seen = base.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("q")).alias("size"), F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high")).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not seen.anchors:
        return spark.createDataFrame([], shape)
    size, least, most = max(1, seen.size), seen.low or 0, seen.high or 0
    if size * max(-least, most, 1) ** 2 >= 1 << 53:
        raise ValueError("components are too large for exact products")
    bits = planes(least, most)
    chunks, blocks = -(-seen.n // block), -(-seen.anchors // ANCHORS)
    padded = base.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("q"))))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = padded.withColumn("chunk", F.pmod(F.xxhash64("r"), F.lit(chunks)).cast("int")).withColumn("block", numbers(blocks)).groupBy("chunk", "block")
    asked = padded.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int"))

    def against(queries: DataFrame, run, names: str) -> DataFrame:
        return dealt.cogroup(queries.withColumn("chunk", numbers(chunks)).groupBy("chunk", "block")).applyInArrow(run, names)

    order = (F.col("score").desc(), "vec_id", "r")
    near = against(asked, _positives(size, bits, positives), "anchor long, score long, vec_id long, r long")
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    chosen = tables.keep("positives", ranked.select("anchor", F.col("place").cast("long").alias("place"), "score", F.col("vec_id").alias("positive_id")))
    told = chosen.select(F.col("anchor").alias("r"), "place", "score").join(asked.select(*(F.col(c).alias(c) for c in ("r", "label", "q", "block"))), "r")
    hard = against(told, _negatives(size, bits, negatives, low, high), "anchor long, place long, score long, vec_id long, r long")
    best = hard.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    named = best.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = base.where(is_anchor).select(F.col("r").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = chosen.withColumnRenamed("score", "positive_score").join(ids, "anchor")
    return named.join(pairs, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
