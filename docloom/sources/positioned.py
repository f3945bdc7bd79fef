"""Positioned runs of text, as page layouts give them, to lines and paragraphs.

runs: doc_id, page, seq, str, x, y, angle (degrees), size, width, rtl, has_eol. A page stays in one
task, many pages are worked through at once; distances between lines are judged over the whole document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.shared import kept, whole

SAME_BASELINE, MISSING_SPACE = 0.5, 0.15
BREAK_PITCH, BREAK_EM, SHORT_LINE, BIN = 1.3, 3.5, 0.7, 0.05
NUMBERED = r"^(?:\d+(?:\.\d+)*\.?|[A-Z]\.|\([a-z0-9]+\))\s"
LINE = "doc_id long, page int, line int, angle int, base double, size double, left double, width double, text string"


def place(transform: Column) -> tuple[Column, Column, Column]:
    """(angle in whole degrees, size, baseline) of a run's six-number matrix."""
    a, b, _, _, x, y = (F.element_at(transform, i) for i in range(1, 7))
    turn = F.atan2(b, a)
    return F.floor(F.degrees(turn) + 0.5).cast("int"), F.hypot(a, b), y * F.cos(turn) - x * F.sin(turn)


def _lined(rows: pa.Table, pages: np.ndarray) -> pa.RecordBatch:
    """The lines of whole pages, which begin at these rows."""
    n = rows.num_rows
    angle, x, y, size, width = (rows.column(c).to_numpy() for c in ("angle", "x", "y", "size", "width"))
    rtl, eol = (rows.column(c).to_numpy().astype(bool) for c in ("rtl", "has_eol"))
    said = rows.column("str").combine_chunks()
    start = np.zeros(n, bool)
    start[pages] = True
    start[1:] |= eol[:-1] | (angle[1:] != angle[:-1])
    first = np.flatnonzero(start)
    own = np.repeat(first, np.diff(np.append(first, n)))
    far = np.abs(y[own] - y) > SAME_BASELINE * size[own]
    for a in np.unique(own[far]).tolist():  # the run that opens a line may be smaller than a later one: such stretches are told run by run
        top, most = a, size[a]
        for k in range(a + 1, int(first[np.searchsorted(first, a) + 1]) if a != first[-1] else n):
            if abs(y[top] - y[k]) > SAME_BASELINE * most:
                start[k], top, most = True, k, size[k]
            most = max(most, size[k])
    first = np.flatnonzero(start)
    line = np.cumsum(start) - 1
    back = (np.add.reduceat(rtl.astype(int), first) * 2 > np.diff(np.append(first, n)))[line]
    order = np.lexsort((np.where(back, -x, x), line))
    ox, ow, most = x[order], width[order], np.maximum.reduceat(size, first)
    gap = np.zeros(n)
    gap[1:] = np.where(back[1:], ox[:-1] - ox[1:] - ow[1:], ox[1:] - ox[:-1] - ow[:-1])
    said = said.take(pa.array(order))
    wide = (gap > MISSING_SPACE * most[line]) & ~start & ~pc.starts_with(said, " ").to_numpy(zero_copy_only=False)
    blank, empty = (v.to_numpy(zero_copy_only=False) for v in (pc.ends_with(said, " "), pc.equal(pc.binary_length(said), 0)))
    ends = np.zeros(n, bool)  # whether the line ends in a blank before this run
    ends[1:] = blank[:-1] & ~start[1:]
    for k in (np.flatnonzero(empty[:-1] & ~start[1:]) + 1).tolist():
        ends[k] = ends[k - 1] or (wide[k - 1] and not ends[k - 1])
    pieces = pc.binary_join_element_wise(pa.array(np.where(wide & ~ends, " ", "").tolist(), pa.string()), said, "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, n).astype(np.int32)), pieces), "")
    left = np.minimum.reduceat(x, first)
    at = line[pages]  # the first line of each page
    nth = np.arange(len(first)) - np.repeat(at, np.diff(np.append(at, len(first))))
    heads = pa.array(first)
    return pa.RecordBatch.from_arrays([
        rows.column("doc_id").combine_chunks().take(heads), rows.column("page").combine_chunks().take(heads), pa.array(nth.astype(np.int32)), pa.array(angle[first].astype(np.int32)), pa.array(y[first]),
        pa.array(most), pa.array(left), pa.array(np.maximum.reduceat(x + width, first) - left), text,
    ], names=[c.split()[0] for c in LINE.split(", ")])


def lines(runs: DataFrame) -> DataFrame:
    """Lines of runs that share an angle and a baseline, joined from left to right (or right to left where most runs are so)."""
    number = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    flag = lambda *names: [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in names]
    used = runs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "seq", "str", *number("x", "y", "angle", "size", "width"), *flag("rtl", "has_eol"))
    dealt = used.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq").drop("seq")
    return dealt.mapInArrow(whole(("doc_id", "page"), _lined), LINE)


def pitch(made: DataFrame) -> DataFrame:
    """doc_id, pitch: the usual distance of lines in ems, as the fullest three neighbouring bins' mean; ties to the tighter."""
    over = W.partitionBy("doc_id", "page", "angle").orderBy("line")
    gaps = made.repartition("doc_id").select("doc_id", ((F.lag("base").over(over) - F.col("base")) / F.col("size")).alias("g")).where("g > 0.5 AND g < 3.5").withColumn("bin", F.floor(F.col("g") / BIN).cast("int"))
    bins = gaps.groupBy("doc_id", "bin").agg(F.count("*").alias("n"), F.sum("g").alias("s"))
    spread = bins.select("doc_id", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("at"), "bin", "n", "s")
    smooth = spread.groupBy("doc_id", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = W.partitionBy("doc_id").orderBy(F.desc("n"), "at")
    return smooth.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("doc_id", (F.col("s") / F.col("n")).alias("pitch"))


def paragraphs(made: DataFrame) -> DataFrame:
    """doc_id, page, paragraph_index, text: lines joined until a wide gap, a jump upwards or a numbered start after a short line. The lines are written to the shared folder once, as three steps read them."""
    made = kept(made)
    order = W.partitionBy("doc_id", "page", "angle").orderBy("line")
    widths = made.groupBy("doc_id").agg(F.sort_array(F.collect_list("width")).alias("w")).select("doc_id", F.element_at("w", F.least(F.floor(F.size("w") * 0.9).cast("int") + 1, F.size("w"))).alias("usual"))
    rows = made.join(pitch(made), "doc_id", "left").join(widths, "doc_id")
    gap = (F.lag("base").over(order) - F.col("base")) / F.col("size")
    starts = gap.isNull() | (gap > BREAK_PITCH * F.coalesce("pitch", F.lit(1.2))) | (gap > BREAK_EM) | (gap < -1) | (F.col("text").rlike(NUMBERED) & (F.lag("width").over(order) < SHORT_LINE * F.col("usual")))
    run = rows.withColumn("start", F.when(starts, 1).otherwise(0)).withColumn("n", F.sum("start").over(order))
    joined = run.groupBy("doc_id", "page", "angle", "n").agg(F.min("line").alias("first"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    place_ = W.partitionBy("doc_id").orderBy("page", "angle", "first")
    return joined.select("doc_id", "page", F.row_number().over(place_).alias("paragraph_index"), F.array_join(F.transform("l", lambda x: F.trim(x["text"])), " ").alias("text"))
