"""Near-duplicate documents: many universal hash minima, banding, signature verification, components.

Documents with equal shingle sets are one class from the start. Classes whose signatures agree in a
band meet in a bucket. Pairs that meet are filtered by the share of equal minima, then confirmed on
the full sets, and components grow by alternating large-star and small-star steps.

The pairs of a bucket are never written out. First each class is held against hubs: every bucket has
one, drawn in one of a few orders, and the class's most alike hub is confirmed. After this linear
pass only pairs of a bucket that still lie in different components are left. Such buckets are dealt
out as cells of bounded blocks that carry signatures only. A cell emits a spanning forest of its
untested pairs, the most alike first, and they are confirmed by a join with the texts. Buckets whose
cells withhold further pairs go on to rounds that carry the sets too (the least hashes of very large
ones), so that a cell itself tells nearly all pairs that are no links; rounds go on, with four times
as many forests each, until no pair is withheld. So no bucket has a cap and no link is lost to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_NUMBERS, Tables, attach, few, slices
from docloom.llm.rolling import blocks, mixed
from docloom.llm.words import hashed, tokens

BANDS, ROWS = 32, 5
BLOCK = 4096  # rows of a cell's side
HUB_ROWS = 2048  # texts that a task holds against one hub, about
SKETCH = 512  # hashes of a set that a cell carries at most
DEVIATIONS = 4.5
_draw = np.random.default_rng(20).integers
#: Universal hashing by multiply and shift: odd factors and any offsets.
FACTORS = _draw(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw(0, 2**63, BANDS * ROWS, dtype=np.uint64)
#: A bucket's hub has the smallest id under one of these masks, by the number of its band.
MASKS = tuple(int(m) for m in _draw(0, 2**62, 4))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def alike_share(percent: int, drawn: int = BANDS * ROWS) -> float:
    """A pair goes on to the full sets when at least this share of what is drawn agrees: 4.5 deviations below the similarity, three pairs in a million at it."""
    p = percent / 100
    return p - DEVIATIONS * (p * (1 - p) / drawn) ** 0.5


def sets_fit(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, percent: int) -> bool:
    """Whether sets of n_x and n_y hashes, given by their least SKETCH ones, can be similar enough; exact where both are whole."""
    if n_x == len(x) and n_y == len(y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (n_x + n_y - both)
    least = np.union1d(x, y)[:SKETCH]
    shared = np.intersect1d(x, y, assume_unique=True)
    return np.isin(least, shared, assume_unique=True).mean() >= alike_share(percent, len(least))


def sets_of(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct runs of n words; of its whole sequence where there are fewer.

    Only A-Z are lower-cased.
    """
    for first, last in blocks([len(t or "") for t in texts], 1 << 19):
        words, sizes = tokens(pa.array(texts[first:last], pa.large_string()))
        word = hashed(words)
        edge = np.cumsum([0, *sizes])
        # Runs over all words at once; those that cross from one text to the next are not taken below.
        run = mixed(word)
        upto = [run]
        for k in range(1, min(n, len(word))):
            run = mixed(run[:-1] * GOLDEN + word[k:])
            upto.append(run)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            width = min(n, b - a)
            yield np.unique(upto[width - 1][a : b - width + 1]) if width else np.zeros(0, np.uint64)


def exact_set(text: str | None, n: int) -> frozenset[tuple[str, ...]]:
    """The distinct runs of n words themselves; the whole sequence where there are fewer."""
    words = tokens(pa.array([text], pa.large_string()))[0].to_pylist()
    return frozenset(zip(*(words[k:] for k in range(min(n, len(words)))), strict=False))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over a set; 16 of its upper 32 bits."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[a : a + 1024, None] * FACTORS + OFFSETS).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u2")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature, with the band's number in its last five bits."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mixed(key * GOLDEN + rows[:, :, k])
    return ((key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


def described(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, n_shingles, same (equal for equal sets) and minima of each row; the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = list(sets_of(batch.column(1).to_pylist(), n))
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            least = [minima(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_shingles": pa.array(map(len, sets), pa.int64()), "same": pa.array(same, pa.binary()), "minima": pa.array(least, pa.binary())})

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text))
    return rows.mapInArrow(run, "id long, n_shingles long, same binary, minima binary")


def _placed(classes: DataFrame) -> DataFrame:
    """band, id: the bands of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4096)):
            keys = band_keys(_signatures(batch.column(1)))
            yield pa.RecordBatch.from_pydict({"band": pa.array(keys.ravel()), "id": pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))})

    return classes.select("id", "minima").mapInArrow(run, "band long, id long")


def _mask(band: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MASKS)), (band.bitwiseAND(F.lit(BANDS - 1)) % len(MASKS) + 1).cast("int"))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _best_hubs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with the most alike of its buckets' hubs, if any hub's size and minima allow the similarity."""
    least, rows = alike_share(percent), members.count()
    asked = members.where("id <> hub").groupBy("id").agg(F.collect_set("hub").alias("hubs"))  # at most one for each band
    own = classes.select("id", F.col("n_shingles").alias("n_a"), F.col("minima").alias("m_a"))
    pairs = asked.join(own, "id").select(F.col("id").alias("a"), F.explode("hubs").alias("b"), "n_a", "m_a")
    hubs = members.select(F.col("hub").alias("id")).distinct()
    count = hubs.count()
    facts = attach(classes, hubs, ["id"], count, "left_semi", most=BROADCAST_NUMBERS) if count <= BROADCAST_NUMBERS else classes.join(hubs, "id", "left_semi")
    facts = facts.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("minima").alias("m_b"))
    met = attach(pairs, facts, ["b"], count, salts=4).where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4096)):
            share = (_signatures(batch.column("m_a")) == _signatures(batch.column("m_b"))).mean(1)
            near = pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "share": pa.array(share)})
            yield near.filter(pa.array(share >= least))

    shares = few(met.select("a", "b", "m_a", "m_b"), rows, 50_000).mapInArrow(run, "a long, b long, share double")
    return shares.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))


def confirmed(pairs: DataFrame, count: int, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. pairs holds count rows; texts: id, text.

    The texts of all a go to the text of their b, in as many parts as b has pairs for. Where several
    texts have one id, any pair of them counts.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    split = attach(pairs, parts, ["b"], count, most=BROADCAST_NUMBERS)
    sides = split.select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"))
    own = parts.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    asked = sides.unionByName(own)
    asked = F.broadcast(asked) if 2 * count <= BROADCAST_NUMBERS else asked
    met = texts.join(asked, "id").select("hub", "part", "side", "id", "text")
    dealt = few(met.repartition("hub", "part"), 2 * count, 1000).sortWithinPartitions("hub", "part", "side", "id")

    def enough(both: int, x: int, y: int) -> bool:
        return 100 * both >= percent * (x + y - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[tuple[int, int]] = []
            said = batch.column(4).to_pylist()
            for hub, part, side, id_, text, made in zip(*(c.to_pylist() for c in batch.columns[:4]), said, sets_of(said, n), strict=True):
                if (hub, part) != at:
                    at, held = (hub, part), {}
                if side == 0:
                    held.setdefault(made.tobytes(), (made, exact_set(text, n)))
                    continue
                for other, words in held.values():
                    if enough(len(np.intersect1d(made, other, assume_unique=True)), len(made), len(other)):
                        own = exact_set(text, n)  # hashes may collide, so the words themselves confirm a link
                        if enough(len(own & words), len(own), len(words)):
                            out.append((id_, hub))
                            break
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


class _Tree:
    """Sets of numbers that grow together."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def forests(found: list[tuple[float, int, int, int, int]], most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (a, b) of up to most spanning forests of found (share, component, component, a, b), and whether any pair is left."""
    out: list[tuple[int, int]] = []
    found = sorted(found, key=lambda f: (-f[0], f[3], f[4]))
    for _ in range(most):
        tree, left = _Tree(), []
        for f in found:
            if tree.join(f[1], f[2]):
                out.append((f[3], f[4]))
            else:
                left.append(f)
        found = left
        if not found:
            break
    return out, bool(found)


def _across(rows: DataFrame, count: int, most: int, percent: int) -> DataFrame:
    """Pairs (a, b) across components within buckets, each in the first band that it shares; (null, band) from a cell that withholds some.

    rows, about count: band, id, component, rest, wide, high, n_shingles, minima, least (hashes of the set, or null).
    A bucket is a grid of cells, high blocks of its rest beside wide blocks of all its members; a row of
    the rest goes to the cells of its line, and each member to the cells of its column.
    """
    least = alike_share(percent)
    column = F.pmod(F.xxhash64("id"), F.col("wide")).cast("int")
    line = F.pmod(F.xxhash64("id", F.lit(1)), F.col("high")).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: cell(i, column, 1))
    as_rest = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: cell(line, j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    dealt = rows.withColumn("c", F.explode(F.concat(as_member, as_rest))).select("band", "c.i", "c.j", "c.side", "id", "component", "rest", "n_shingles", "minima", "least")
    sorted_ = few(dealt.repartition("band", "i", "j"), count, 20_000).sortWithinPartitions("band", "i", "j", "side", "id")

    def pairs(band: int, held: list[tuple]) -> tuple[list[tuple[int, int]], bool]:
        """held: side, id, component, rest, n_shingles, minima, least of a cell's rows."""
        some, every = [h for h in held if h[0] == 0], [h for h in held if h[0] == 1]
        if not some or len(every) < 2 and some[0][1] == (every[0][1] if every else some[0][1]):
            return [], False
        ids, parts, rest, sizes = (np.array([h[k] for h in every]) for k in (1, 2, 3, 4))
        table = np.frombuffer(b"".join(h[5] for h in every), "<u2").reshape(len(every), -1)
        sets = [None if h[6] is None else np.frombuffer(h[6], np.uint64) for h in every]
        found: list[tuple[float, int, int, int, int]] = []
        for _, id_, part, _, size, own, own_set in some:
            mine = None if own_set is None else np.frombuffer(own_set, np.uint64)
            fit = (parts != part) & ~(rest & (ids < id_)) & (sizes * 100 >= size * percent) & (size * 100 >= sizes * percent)
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            same = table[at] == np.frombuffer(own, "<u2")
            share = same.mean(1)
            near = np.flatnonzero(share >= least)
            first = same[near].reshape(len(near), BANDS, ROWS).all(2).argmax(1)
            for k in near[first == (band & (BANDS - 1))].tolist():
                other = sets[at[k]]
                if mine is None or other is None or sets_fit(mine, other, size, int(sizes[at[k]]), percent):
                    found.append((float(share[k]), part, int(parts[at[k]]), id_, int(ids[at[k]])))
        return forests(found, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def said() -> Iterator[pa.RecordBatch]:
            out, more = pairs(at[0], held) if held else ([], False)
            if out or more:
                a, b = [x for x, _ in out] + [None] * more, [x for _, x in out] + [at[0]] * more
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in (part for whole in batches for part in slices(whole, 2048)):
            for band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != at:
                    yield from said()
                    at, held = (band, i, j), []
                held.append(tuple(row))
        yield from said()

    return sorted_.mapInArrow(run, "a long, b long")


def _least(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, least: the least SKETCH hashes of the sets of some ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            least = [s[:SKETCH].tobytes() for s in sets_of(batch.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "least": pa.array(least, pa.binary())})

    return texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, least binary")


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end, without loops."""
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def components(edges: DataFrame, count: int, tables: Tables | None = None) -> tuple[DataFrame, int]:
    """id, component (smallest id reachable) of each id in edges (a, b), count rows, but the smallest of each component; and their number.

    Large-star: a node's larger neighbours point to the smallest of its neighbours and itself.
    Small-star: its smaller neighbours, and the node itself, point to the smallest of them. Both
    alternate until the edges are stars. Loops are passed over.
    """
    t = tables or Tables(edges.sparkSession)
    now = t.keep("edges", few(_pairs(edges.select("a", "b")), count))
    while True:
        lows = t.keep("lows", few(now.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), count))
        nodes, rows = lows.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        of_b = lows.select(F.col("a").alias("b"), "m")
        if nodes == rows and attach(now, of_b, ["b"], nodes, most=BROADCAST_NUMBERS).isEmpty():
            break
        large = attach(now, of_b, ["b"], nodes, "left", most=BROADCAST_NUMBERS).select("a", F.coalesce("m", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = attach(large, least, ["a"], nodes, most=BROADCAST_NUMBERS).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = t.keep("edges", few(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), count))
    t.drop("lows")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")), nodes


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 80, hubs: bool = True, say=None) -> DataFrame:
    """key, n_shingles, component_id, kept: one row for each row of docs.

    Rows with 100 * intersection >= percent * union of their sets of n-word shingles are linked;
    component_id is the smallest key reachable and kept says that it is the row's own. A null or
    empty text has an empty set and is linked with nothing; so is a row whose key is null, which
    has a null component_id and is kept. Rows of equal keys are in one component. Pairs at a
    similarity of 0.8 itself miss each other in all bands three times in a million; all pairs found
    are confirmed on full sets. No rows give none; other columns are not read, whatever their names.
    hubs=False leaves the linear pass out, and say is told of sizes on the way; both are for tests.
    """
    t = Tables(docs.sparkSession)
    base = t.keep("base", described(docs, key, text, n))
    usable = base.where(F.col("id").isNotNull() & F.col("same").isNotNull())
    classes = t.keep("classes", usable.groupBy("same").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima")))
    placed = _placed(classes)
    masked = F.col("id").bitwiseXOR(_mask(F.col("band")))
    shared = placed.groupBy("band").agg(F.count("*").alias("n"), F.min(masked).alias("x")).where("n > 1")
    hub = F.col("x").bitwiseXOR(_mask(F.col("band"))).alias("hub")
    members = t.keep("members", placed.join(shared.select("band", "x"), "band").select("band", "id", hub))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    found = t.keep("found", members.select("id", F.col("id").alias("component")).limit(0))
    count = 0

    def tested(pairs: DataFrame) -> int:
        """Confirm pairs and let the components grow by the links; how many links there were."""
        nonlocal found, count
        asked = pairs.count()
        if not asked:
            return 0
        links = t.keep("links", confirmed(pairs, asked, texts, n, percent))
        new = links.count()
        if say:
            say("pairs", asked, "links", new)
        if not new:
            return 0
        of = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"{side}_"))
        ends = links
        if count:
            for side in ("a", "b"):
                ends = attach(ends, of(side), [side], count, "left", most=BROADCAST_NUMBERS)
            ends = ends.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
        moved, changed = components(ends, new, t)
        if count:
            to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
            grown = attach(found, to, ["component"], changed, "left", most=BROADCAST_NUMBERS).select("id", F.coalesce("to", "component").alias("component"))
            moved = grown.unionByName(moved)
        found = t.keep("found", moved)
        count += changed
        return new

    if hubs:
        tested(t.keep("pairs", _best_hubs(members, classes, percent)))
    # What is left: pairs of a bucket across components, of which one is not in the bucket's largest.
    facts = classes.select("id", "n_shingles", "minima")
    held, most = members.select("band", "id"), 1
    while True:
        now = attach(held, found, ["id"], count, "left", most=BROADCAST_NUMBERS).select("band", "id", F.coalesce("component", "id").alias("component"))
        parts = now.groupBy("band", "component").agg(F.count("*").alias("m"))
        open_ = parts.groupBy("band").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("k"), F.sum("m").alias("m")).where("k > 1")
        sized = t.keep("open", open_.select("band", "m", F.col("top.component").alias("top"), F.ceil(F.col("m") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int").alias("high")))
        buckets, places = sized.agg(F.count("*"), F.sum(F.col("m") * F.col("high"))).first()
        if not buckets:
            break
        rows = attach(now, sized.drop("m"), ["band"], buckets, most=BROADCAST_NUMBERS).withColumn("rest", F.col("component") != F.col("top")).join(facts, "id")
        if most == 1:
            rows = rows.withColumn("least", F.lit(None).cast("binary"))
        else:
            ids = held.select("id").distinct()
            rows = rows.join(t.keep("least", _least(texts, ids, n)), "id")
        made = t.keep("pairs", _across(rows, places, most, percent))
        bands = t.keep("withheld", few(made.where("a IS NULL").select(F.col("b").alias("band")).distinct(), buckets))
        more = bands.count()
        if say:
            say("open buckets", buckets, "forests", most, "withheld by", more)
        tested(t.keep("asked", few(_pairs(made.where("a IS NOT NULL")), places)))
        if not more:
            break
        held = t.keep(f"held{most}", attach(members.select("band", "id"), bands, ["band"], more, most=BROADCAST_NUMBERS))
        most *= 4
    of_class = attach(classes.select("same", "id"), found, ["id"], count, "left", most=BROADCAST_NUMBERS).select("same", F.coalesce("component", "id").alias("component"))
    joined = t.keep("of_class", of_class)
    t.drop(*(name for name in list(t.paths) if name not in ("base", "of_class")))
    out = attach(base.select("id", "n_shingles", "same"), joined, ["same"], joined.count(), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
