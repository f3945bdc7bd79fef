"""Timelines, parties, evidence under caps, the document map and review prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.dates import find_dates
from docloom.functions.text import clause_label, is_heading, pattern, squeeze
from docloom.operators.rules import FAMILIES, Rule, prompts
from docloom.plans.registry import FIELDS, PARTY_CUES, PARTY_HEADINGS


def dates(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, paragraph_index, seq, at, written, date, kinds, alternative of every explicit date."""
    # Outer, as before an inner one Spark tests for empty arrays, and finds the dates of each text twice.
    each = paragraphs.select(key, "paragraph_index", F.posexplode_outer(find_dates(F.col("text"))).alias("seq", "m")).where("seq IS NOT NULL")
    return each.select(key, "paragraph_index", "seq", "m.*")


def timeline(paragraphs: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dates with the titles of the rules that fire in their paragraph (but for plain dates), in order of date and place."""
    topics = hits.where("category != 'date'").groupBy(key, "paragraph_index").agg(F.array_sort(F.collect_set(F.struct("rule_order", "title"))).alias("t"))
    found = dates(paragraphs, key).join(topics, [key, "paragraph_index"], "left")
    order = W.partitionBy(key).orderBy("date", "paragraph_index", "seq")
    return found.select(key, F.row_number().over(order).alias("n"), "date", "written", "paragraph_index", "kinds", "alternative", F.coalesce(F.transform("t", lambda x: x["title"]), F.array().cast("array<string>")).alias("topics"))


def timeline_days(line: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, date, day (as "5 May 2026"), entries (n, written, paragraph_index): the rows of a timeline under one heading for each day."""
    entry = F.struct("n", "written", "paragraph_index")
    return line.groupBy(key, "date").agg(F.date_format("date", "d MMMM yyyy").alias("day"), F.array_sort(F.collect_list(entry)).alias("entries"))


def doubt(kinds: Column, alternative: Column) -> Column:
    """What is uncertain about a date, in one text; null where nothing is."""
    order = F.concat(F.lit("Day and month may be the other way round: "), F.coalesce(F.date_format(alternative, "d MMMM yyyy"), F.lit("another date")), F.lit("."))
    said = F.transform(kinds, lambda k: F.when(k == "day-month-order", order).otherwise("The year has two digits."))
    return F.when(F.size(kinds) > 0, F.concat_ws(" ", said, F.lit("Check it in the document.")))


def parties(paragraphs: DataFrame, key: str = "doc_id", most: int | None = 4, cues: Sequence[tuple[int, str]] = PARTY_CUES) -> DataFrame:
    """key, paragraph_index, text, weight, matched: paragraphs that name a party, the strongest cues first; all of them where most is None."""
    text, before = F.col("text"), F.lag("text").over(W.partitionBy(key).orderBy("paragraph_index"))
    title = F.rtrim(F.lower(F.regexp_replace(squeeze(before), ":$", "")))
    led = F.coalesce(is_heading(before) & title.isin(*PARTY_HEADINGS), F.lit(False))
    weigh = F.greatest(*(F.when(text.rlike(pattern(p)), F.lit(n)) for n, p in cues), F.when(F.col("led"), F.lit(2)), F.lit(0))
    strongest = [F.when(text.rlike(pattern(p)) & (F.col("weight") == n), F.regexp_extract(text, pattern(p), 0)) for n, p in cues]
    opening = F.array_join(F.slice(F.split(text, r"\s+"), 1, 8), " ")
    found = paragraphs.withColumn("led", led).where(~is_heading(text) & (F.trim(text) != "")).withColumn("weight", weigh).where("weight > 0")
    found = found.withColumn("matched", F.coalesce(*strongest, opening))
    order = W.partitionBy(key).orderBy(F.desc("weight"), "paragraph_index")
    ranked = found.withColumn("n", F.row_number().over(order))
    return (ranked if most is None else ranked.where(F.col("n") <= most)).select(key, "paragraph_index", "text", "weight", "matched", "n")


def capped(items: Column, most: int, chars: int) -> Column:
    """The items of an array (structs with a field len) that fit: one that is too long is skipped, later ones may fit; the first always does."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < most) & ((acc["n"] == 0) | (acc["sum"] + x["len"] <= chars))
        taken = F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + x["len"]).cast("long").alias("sum"), F.concat(acc["out"], F.array(x["paragraph_index"].cast("int"))).alias("out"))
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: F.array_sort(acc["out"]))


def evidence(paragraphs: DataFrame, hits: DataFrame, key: str = "doc_id", fields: Mapping[str, Sequence[str]] = FIELDS, most: int | None = 6, chars: int = 7000, excerpt: int = 4000) -> DataFrame:
    """key, field, places: the paragraphs that are a field's evidence, under the caps, in document order; where most is None, all of them."""
    wanted = F.create_map(*(x for f, rules in fields.items() for r in rules for x in (F.lit(r), F.lit(f))))
    # Each source reads its paragraphs' lengths with their texts, so nothing is joined with the paragraphs again. o orders by source (hits behind the others) and place in it, as one number.
    size, behind = F.least(F.length("text"), F.lit(excerpt)).alias("len"), 1 << 32
    from_hits = hits.select(key, "paragraph_index", F.element_at(wanted, F.col("rule_id")).alias("field"), (F.col("hit_order") + F.lit(behind)).alias("o"), size).where("field IS NOT NULL")
    from_dates = paragraphs.where(F.size(find_dates(F.col("text"))) > 0).select(key, "paragraph_index", F.lit("dates").alias("field"), F.col("paragraph_index").cast("long").alias("o"), size)
    from_parties = (parties(paragraphs, key, None) if most is None else parties(paragraphs, key)).select(key, "paragraph_index", F.lit("parties").alias("field"), F.col("n").cast("long").alias("o"), size)
    every = from_hits.unionByName(from_dates).unionByName(from_parties)
    if most is None:
        return every.groupBy(key, "field").agg(F.sort_array(F.collect_set(F.col("paragraph_index").cast("int"))).alias("places"))
    first = every.groupBy(key, "field", "paragraph_index", "len").agg(F.min("o").alias("o"))
    listed = first.groupBy(key, "field").agg(F.array_sort(F.collect_list(F.struct("o", "paragraph_index", "len"))).alias("items"))
    return listed.select(key, "field", capped(F.col("items"), most, chars).alias("places"))


def document_map(documents: DataFrame, found: DataFrame, key: str = "doc_id", fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """Each document beside each field: wording-only with its places, or not-found."""
    each = documents.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, fields))).alias("field_order", "field"))
    return each.join(found, [key, "field"], "left").select(key, "field", "field_order", F.when(F.col("places").isNull(), "not-found").otherwise("wording-only").alias("status"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))


def review_prompts(hits: DataFrame, key: str = "doc_id", batch: int = 8, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row for each rule that fired: its places in order, its first prompt, and the batch it would be asked in.

    With the rules, hits need no prompt: it is made from the first place's text alone, and its clause is read there.
    """
    family = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    rank = F.when(F.col("relevance") == "primary", 0).when(F.col("relevance") == "secondary", 1).otherwise(2)
    said = "prompt" if rules is None else "text"
    one = hits.groupBy(key, "rule_id", "family", "rule_order", "relevance").agg(F.sort_array(F.collect_set("paragraph_index")).alias("places"), F.min_by(said, "paragraph_index").alias(said))
    if rules is not None:
        one = one.withColumn("clause", clause_label(F.col("text"))).withColumn("prompt", prompts(rules, F.col("rule_order"), F.col("text"), F.col("clause"))).drop("text", "clause")
    order = W.partitionBy(key).orderBy(rank, family, "rule_order")
    batches = W.partitionBy(key).orderBy(family, rank, "rule_order")
    return one.withColumns({"n": F.row_number().over(order), "batch": F.floor((F.row_number().over(batches) - 1) / batch).cast("int")})


def round_robin(hits: DataFrame, key: str = "doc_id", most: int = 8, chars: int = 10_000, excerpt: int = 4000) -> DataFrame:
    """key, places: excerpts picked in turns, each rule's first place, then each one's second, under the caps."""
    turn = F.row_number().over(W.partitionBy(key, "rule_id").orderBy("paragraph_index"))
    first = hits.withColumn("turn", turn).groupBy(key, "paragraph_index").agg(F.min(F.struct("turn", "rule_order")).alias("o"), F.first(F.least(F.length("text"), F.lit(excerpt))).alias("len"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "paragraph_index", "len"))).alias("items"))
    return listed.select(key, capped(F.col("items"), most, chars).alias("places"))


def place_claims(claims: DataFrame, credits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """response_id, rule_id, claim_index of the best claim for each rule; other claims are dropped.

    claims: response_id, claim_index, category, chunk_id, confidence. credits: response_id, chunk_id, rule_id. A
    claim belongs to the credited rule of its category, else to the only rule its chunk is credited to.
    """
    category = F.create_map(*(F.lit(x) for r in rules for x in (r.id, r.category)))
    both = claims.join(credits, ["response_id", "chunk_id"]).withColumn("own", F.element_at(category, F.col("rule_id")) == F.col("category"))
    w = W.partitionBy("response_id", "claim_index")
    fit = both.withColumns({"sole": F.count("*").over(w) == 1, "any_own": F.max("own").over(w)}).where("own OR (NOT any_own AND sole)")
    best = W.partitionBy("response_id", "rule_id").orderBy(F.desc("confidence"), "claim_index")
    return fit.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("response_id", "rule_id", "claim_index", "confidence")
