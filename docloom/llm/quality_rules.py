"""Quality rules with robust multivariate outliers.

Each document gets a vector of transformed statistics. For every language and source, the
minimum-covariance-determinant estimate of centre and scatter is found by concentration steps over
all of its documents, from two fixed starts of which the one with the smaller determinant goes on. A
document is rejected when its Mahalanobis distance from the centre of its own group is too large.

Groups are never collected. A concentration step sums the moments of the documents by group and bin
of distance, with sums made before the shuffle, and keeps the bins up to the one that the wanted
share of the group reaches. All documents count; results don't depend on how rows are dealt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import attach, cut, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile(r"[A-Z\u00C0-\u00D6\u00D8-\u00DE\u0391-\u03A9\u0410-\u042F]")
SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_lines")

#: Name, numerator, denominator and pseudo-count of each statistic. Pseudo-counts pull the ratios of
#: short texts, which vary much, to small values.
STATISTICS = (
    ("symbols", "n_symbols", "word_chars", 50.0),
    ("upper", "n_upper", "word_chars", 100.0),
    ("bangs", "n_bangs", "n_words", 20.0),
    ("dup_lines", "n_dup_lines", "n_lines", 5.0),
    ("repeats", "n_repeat_words", "n_words", 20.0),
)
P = len(STATISTICS) + 1
#: Standard deviations, in the transformed units, that each statistic has at least; the last is mean word length.
FLOORS = (0.3, 0.3, 0.3, 0.6, 0.5, 0.1)
#: Squared distance above which a document goes: with 6 statistics a normal one is next to never beyond it.
CUTOFF = 60.0
SHARE = 0.75
BINS = 64  # of squared distance for each doubling


def repeated_words(words: list[str], n: int = 5) -> int:
    """Words in windows of n words that occur twice or more, the first included."""
    if len(words) <= n:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key, have = ids, 1
    while have < n:  # the windows' exact ranks: pairs of ranks of shorter windows
        step = min(have, n - have)
        pair = key[:-step] * np.int64(len(words) + 1) + key[step:]
        key, have = np.unique(pair, return_inverse=True)[1], have + step
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def counted(text: str) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(UPPER.findall(text)),
        text.count("!"),
        len(lines),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with the COUNTS of each whole text; a null text has none of anything."""
    docs = docs.drop(*COUNTS)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            made = np.array([counted(t or "") for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, k]) for k in range(len(COUNTS)))], [*batch.schema.names, *COUNTS])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> list[Column]:
    """The transformed statistics, from the counts."""
    ratios = [F.log1p(100.0 * F.col(a) / (F.col(b) + F.lit(c))) for _, a, b, c in STATISTICS]
    return [*ratios, F.log((F.col("word_chars") + 100.0) / (F.col("n_words") + 20.0))]


def group_key() -> Column:
    """One string for each language and source; null is a value of its own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return F.concat_ws("\u0001", part("lang"), part("source"))


def chi2_quantile(q_normal: float, p: int) -> float:
    """The chi-squared quantile with p degrees of freedom, from that of the normal, by Wilson and Hilferty."""
    return p * (1 - 2 / (9 * p) + q_normal * (2 / (9 * p)) ** 0.5) ** 3


#: Standard normal quantile of SHARE.
NORMAL_SHARE = 0.6745


def _distance() -> Column:
    """Squared distance of x from the centre m, by the inverse scatter v."""
    off = [F.element_at("x", i + 1) - F.element_at("m", i + 1) for i in range(P)]
    terms = [off[i] * off[j] * F.element_at("v", i * P + j + 1) * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _bin(d: Column) -> Column:
    return F.floor(F.log2(d + 1e-9) * BINS).cast("int")


def _moments() -> list[Column]:
    x = [F.element_at("x", i + 1) for i in range(P)]
    return [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]


def _named() -> list[str]:
    return [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i in range(P) for j in range(i, P)]


def _from_moments(scale: bool):
    """mapInPandas: centre, inverse scatter and log determinant of each row of sums."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                n = float(row.n)
                m = np.array([getattr(row, f"s{i}") for i in range(P)]) / n
                cov = np.zeros((P, P))
                for i in range(P):
                    for j in range(i, P):
                        cov[i, j] = cov[j, i] = getattr(row, f"s{i}_{j}") / n - m[i] * m[j]
                if scale:  # so that the share that the scatter was made from is the share of a normal within its distance
                    cov *= chi2_quantile(NORMAL_SHARE, P) / P
                cov += np.diag(np.square(FLOORS))
                out.append((row.g, row.s, m.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["g", "s", "m", "v", "logdet"])

    return run


ESTIMATE = "g string, s int, m array<double>, v array<double>, logdet double"


def concentrate(vectors: DataFrame, estimates: DataFrame, n: int, last: bool = False) -> DataFrame:
    """A concentration step for each group and start: new estimates from the nearest SHARE of each group.

    The nearest share is rounded up to a whole bin of distance, ties included.
    """
    near = attach(vectors, estimates.select("g", "s", "m", "v"), ["g"], n)
    binned = near.withColumn("b", _bin(_distance())).groupBy("g", "s", "b").agg(F.count("*").alias("n"), *_moments())
    over = W.partitionBy("g", "s")
    upto = binned.withColumn("before", F.coalesce(F.sum("n").over(over.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(over))
    kept = upto.where(F.col("before") < F.ceil(F.col("all") * SHARE))
    sums = kept.groupBy("g", "s").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _named()))
    return cut(sums.mapInPandas(_from_moments(last), ESTIMATE))


def starts(vectors: DataFrame) -> DataFrame:
    """Two estimates for each group: medians with quartile ranges, and the scatter of squashed values around the medians."""
    each = vectors.select("g", F.posexplode("x").alias("k", "a")).withColumn("b", F.floor(F.col("a") * 256).cast("int"))
    counts = each.groupBy("g", "k", "b").agg(F.count("*").alias("n"))
    over = W.partitionBy("g", "k")
    ranked = counts.withColumn("to", F.sum("n").over(over.orderBy("b"))).withColumn("all", F.sum("n").over(over))
    at = lambda q: F.min(F.when(F.col("to") >= F.col("all") * q, F.col("b"))) / 256.0
    by_dim = ranked.groupBy("g", "k").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    mid = cut(by_dim.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "q2", ((F.col("q3") - F.col("q1")) / 1.349).alias("d")))).alias("q")))
    floors = F.array(*map(F.lit, FLOORS))
    mid = mid.select("g", F.transform("q", lambda q: q["q2"]).alias("c"), F.transform("q", lambda q, i: F.greatest(q["d"], F.get(floors, i))).alias("d"))
    n = mid.count()
    plain = mid.select("g", F.lit(0).alias("s"), "c", "d").mapInPandas(_diagonal, ESTIMATE)
    squashed = attach(vectors, mid, ["g"], n).withColumn("x", F.transform("x", lambda a, i: F.get("c", i) + F.get("d", i) * F.tanh((a - F.get("c", i)) / F.get("d", i))))
    tanh = squashed.groupBy("g").agg(F.count("*").alias("n"), *_moments()).withColumn("s", F.lit(1)).mapInPandas(_from_moments(False), ESTIMATE)
    return cut(plain.unionByName(tanh))


def _diagonal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(g, 0, list(c), np.diag(1 / np.square(d)).ravel().tolist(), float(2 * np.log(d).sum())) for g, c, d in zip(f.g, f.c, f.d, strict=True)]
        yield pd.DataFrame(rows, columns=["g", "s", "m", "v", "logdet"])


def estimates(vectors: DataFrame, first_steps: int = 2, more_steps: int = 4) -> tuple[DataFrame, int]:
    """g, m, v of each group, and the number of groups. vectors: g, x."""
    now = starts(vectors)
    n = now.count()
    for _ in range(first_steps):
        now = concentrate(vectors, now, n)
    now = cut(now.groupBy("g").agg(F.min_by(F.struct("s", "m", "v", "logdet"), F.struct("logdet", "s")).alias("e")).select("g", "e.*"))
    for k in range(more_steps):
        now = concentrate(vectors, now, n // 2, last=k == more_steps - 1)
    return now.select("g", "m", "v"), n // 2


def judge(docs: DataFrame, text: str = "text", cutoff: float = CUTOFF, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """The columns of docs with COUNTS, distance2, base_failed and kept; one row for each row of docs.

    base_failed: fewer than min_words words, or over repeat_percent of the words are in repeated
    windows. kept: not base_failed, and distance2 at most cutoff. A null or empty text has no words
    and fails the base. Null languages and sources form groups of their own; a group of one document
    or of equal ones is at its own centre, so only the base rejects there. Repeated rows and ties
    are judged alike; no rows give none. Columns of docs with these names are replaced.
    """
    docs = docs.drop("distance2", "base_failed", "kept")
    every = statistics(docs, text).withColumn("g", group_key())
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    every = every.withColumn("x", F.array(*vector())).withColumn("base_failed", failed)
    vectors = cut(every.select("g", "x"))
    made, n = estimates(vectors)
    judged = attach(every, made, ["g"], n, "left").withColumn("distance2", F.coalesce(_distance(), F.lit(0.0)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= cutoff)).drop("g", "x", "m", "v")
