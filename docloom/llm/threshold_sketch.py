"""Document fingerprints by a threshold-scaled sketch, in DataFrame operations only.

Every shingle hash below a fixed fraction of the hash range is retained, so a sketch grows with its
document, the sketch of a union is made from the union of sketches, and the share of one sketch that
another holds estimates containment however unequal the documents are. A document none of whose
hashes is below the threshold keeps its smallest hash alone; a merge drops it once another hash is
below the threshold, else keeps the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import let

SHINGLE = 5
FRACTION = 1 / 8
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words, in order; of the whole sequence where there are fewer words."""
    hashed = F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: _runs(h, n))


def _runs(hashed: Column, n: int) -> Column:
    """Combine each hash with its followers by doubling: runs of 1, 2, 4, ... words, then of n."""

    def joined(made: Column, shift: int) -> Column:
        width = F.greatest(F.size(made) - shift, F.lit(0))
        return F.zip_with(F.slice(made, F.lit(1), width), F.slice(made, F.lit(shift + 1), width), lambda x, y: F.xxhash64(x, y))

    def grown(made: Column, length: int) -> Column:
        step = min(length, n - length)
        return made if length == n else let(joined(made, step), lambda m: grown(m, length + step))

    whole = F.array(F.aggregate(hashed, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    return F.when(F.size(hashed) >= n, grown(hashed, 1)).when(F.size(hashed) > 0, whole).otherwise(F.array().cast("array<long>"))


def retain(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch of an array of hashes: those below the threshold, else the smallest; sorted, without repeats."""
    bound = int(-(2**63) + 2**64 * fraction)
    none = F.array().cast("array<long>")

    def chosen(every: Column) -> Column:
        below = F.array_sort(F.array_distinct(F.filter(every, lambda h: h < F.lit(bound))))
        return let(below, lambda b: F.when(F.size(b) > 0, b).when(F.size(every) > 0, F.array(F.array_min(every))).otherwise(none))

    return let(hashes, chosen)


def sketch(text: Column, n: int = SHINGLE, fraction: float = FRACTION) -> Column:
    return retain(shingle_hashes(text, n), fraction)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both documents' shingles together, from their sketches alone."""
    return retain(F.array_union(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: shared over all retained hashes; two empty sketches are alike."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; an empty a is held wholly."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ",")


def with_next(docs: DataFrame, key: str, buckets: int) -> DataFrame:
    """docs with each row's successor in ascending order of key; the last row's is the first row.

    Adds next_text. Rows are dealt to ranges of the key between its quantiles, so no task gets
    more than its share; each range also gets a copy of the first row of the next one. Rows with
    equal keys are put in order of their text; null keys come first.
    """
    ids = docs.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    cuts = ids.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).collect()[0]["q"] if buckets > 1 else []
    bounds = sorted(set(cuts or []))
    width = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[width - 1 :: width]
    fine = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]

    def at_most(values: list, k: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, values)).cast("array<long>"), lambda b: b <= k))

    nested = F.array(*(F.array(*map(F.lit, part)).cast("array<long>") for part in fine))
    k = F.col(key)
    skipped = at_most(coarse, k)
    bucket = F.coalesce(skipped * width + F.size(F.filter(F.coalesce(F.get(nested, skipped), F.array().cast("array<long>")), lambda b: b <= k)), F.lit(0))
    dealt = docs.withColumn("_b", bucket)
    firsts = {r["_b"]: r["k"] for r in dealt.select("_b", F.col(key).alias("k")).groupBy("_b").agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("n")).select("_b", F.when(F.col("n") == 0, F.col("k")).alias("k")).collect()}
    filled = sorted(firsts)
    if not filled:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    before = {b: filled[i - 1] for i, b in enumerate(filled)}  # the first range follows the last
    first_of = F.create_map(*(F.lit(x) for b in filled for x in (b, firsts[b]))) if any(firsts[b] is not None for b in filled) else F.create_map(F.lit(-1), F.lit(None).cast("long"))
    goes_to = F.create_map(*(F.lit(x) for b in filled for x in (b, before[b])))
    own = F.struct(F.lit(0).alias("copy"), F.col("_b").alias("b"))
    copied = F.when(k.eqNullSafe(F.element_at(first_of, F.col("_b"))), F.array(own, F.struct(F.lit(1).alias("copy"), F.element_at(goes_to, F.col("_b")).alias("b")))).otherwise(F.array(own))
    rows = dealt.withColumn("_to", F.explode(copied)).drop("_b")
    order = W.partitionBy("_to.b").orderBy(F.col("_to.copy"), k.asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.withColumn("next_text", F.lead(F.coalesce(F.col("text"), F.lit(""))).over(order)).where(F.col("_to.copy") == 0).drop("_to")


def fingerprint(docs: DataFrame, key: str = "doc_id", n: int = SHINGLE, fraction: float = FRACTION, rows_per_task: int = 2000) -> DataFrame:
    """key, n_chars, text, edited, sketch, edited_sketch, next_sketch for every row.

    edited is the text whose last quarter (floor of n_chars / 4 code points) is replaced by as many
    code points from the start of the next document's text, or by all of it if it is shorter. A null
    text is an empty one, and its sketch is empty. Repeated rows stay. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.count()
    followed = with_next(rows, key, max(1, min(4096, total // rows_per_task + 1)))
    n_chars = F.length("text")
    tail = F.floor(n_chars / 4).cast("int")
    cut = followed.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - tail), F.substring("next_text", F.lit(1), tail)))
    return cut.select(
        key,
        n_chars.cast("long").alias("n_chars"),
        "text",
        "edited",
        sketch(F.col("text"), n, fraction).alias("sketch"),
        sketch(F.col("edited"), n, fraction).alias("edited_sketch"),
        sketch(F.col("next_text"), n, fraction).alias("next_sketch"),
    )
